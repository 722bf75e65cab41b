"""Substring deduplication over words, by fixed-block anchors.

*Index.* Every text is cut into non-overlapping blocks of ``(window + 1) // 2`` words; any window of ``window`` words
holds at least one whole block of its text. *Probe.* Every rolling window of block length is looked up among the blocks;
what occurs at a second place is a hit. *Extend.* A hit is extended by its neighbours on both sides: every full window
through it is compared with all other windows through hits, by 128-bit content fingerprints less the 32 bits that the
key range already holds (96 bits and the range). Runs of windows that have a twin are the maximal exact repeats. No
pairs of places are ever listed, so a passage with a million copies costs a million windows, not their square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .packed import PACKED, chunks, joined, key_partitions, match, pack, places_of, uids, with_uid
from .shared import documents, materialize
from .textops import U64, Chunk, Hasher, covered, ranges

WINDOW = 35
KEY_BYTES = 5  # with the key range: 40 bits and log2(partitions); a false hit only costs a comparison


def _probes(window: int, parts: int):
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(1)
        for table, texts in chunks(batches):
            chunk = Chunk(texts)
            at = chunk.window_starts(block)
            doc = chunk.doc_of_word()[at]
            place = at - chunk.word_start[doc]
            key = hasher.windows(hasher.words(chunk), block)[at]
            long_enough = chunk.n_words[doc] >= window
            yield from pack(key[long_enough], None, doc[long_enough], place[long_enough], (place % block == 0)[long_enough], *uids(table), parts, KEY_BYTES, False)

    return run


def _windows(window: int, parts: int):
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Hasher(1), Hasher(2)
        for table, texts in chunks(batches):
            hits = table.column("hits").to_pylist()
            chunk = Chunk(texts)
            at, doc = [], []
            for i, h in enumerate(hits):
                n = chunk.n_words[i]
                if h and n >= window:
                    r = places_of(h)
                    first = np.maximum(r - (window - block), 0)
                    mask = np.bincount(first, minlength=n + 2)[: n + 2] - np.bincount(r + 1, minlength=n + 2)[: n + 2]
                    s = np.flatnonzero(np.cumsum(mask)[: n - window + 1] > 0)
                    at.append(s + chunk.word_start[i])
                    doc.append(np.full(len(s), i, np.int32))
            if not at:
                continue
            at, doc = np.concatenate(at), np.concatenate(doc)
            key = one.windows(one.words(chunk), window)[at]
            low = two.windows(two.words(chunk), window)[at] & U64(0xFFFFFFFF)
            yield from pack(key, low, doc, at - chunk.word_start[doc], np.zeros(len(at), bool), *uids(table), parts, 8, True)

    return run


OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:int,words:int>>, kept_text string"


def _removed(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            chunk = Chunk(texts)
            hits = table.column("hits").to_pylist()
            words, removed, digests, spans, kept = chunk.n_words.tolist(), [], [], [], []
            for i, text in enumerate(texts):
                split = text.split()  # of bytes: it has the same separators as a word
                gone = covered(places_of(hits[i]), window, len(split)) if hits[i] else np.zeros(len(split), bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": int(a), "words": int(b - a)} for a, b in zip(edge[0::2], edge[1::2], strict=True)])
                left = b" ".join([w for w, g in zip(split, gone.tolist(), strict=True) if not g] if len(edge) else split)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    return run


def repeated_words(docs: DataFrame, *, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``n_words, n_removed, kept_sha256``, removed ``spans`` and ``kept_text``.

    A word goes if a window of ``window`` words over it occurs at another place of the table, the same text included.
    Null, empty and shorter texts lose nothing. Repeated rows count as two places, so their windows go. Null ids are
    allowed. An empty table gives an empty one. Other columns of ``docs`` are ignored.
    """
    texts = with_uid(docs.select("doc_id", "text"))
    parts = key_partitions(docs)
    probes = texts.select("uid_a", "uid_b", "text").mapInArrow(_probes(window, parts), PACKED)
    hits = materialize(match(probes, parts, width=KEY_BYTES, need_flag=True))
    # Both joins below deal the same columns of the texts by the same key, so Spark shuffles the texts once.
    candidates = joined(texts, hits).select("doc_id", "uid_a", "uid_b", "text", "hits").mapInArrow(_windows(window, parts), PACKED)
    twins = match(candidates, parts, width=8, with_low=True)
    return joined(texts, twins).select("doc_id", "text", "hits").mapInArrow(_removed(window, keep_text), OUT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(documents(spark, sf_dir), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS k FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
twin AS (SELECT doc_id, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, j FROM twin, unnest(range(i, i + 35)) AS t(j)),
word AS (SELECT doc_id, j, ws[j] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
