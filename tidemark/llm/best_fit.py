"""Packing token pieces into sequences of fixed size by bulk-synchronous best fit.

In a superstep, pieces and gaps are range-sorted by size, a gap by the length of its successor: the largest piece that is left and fits.
Each task sweeps its range from the largest piece down; a piece takes the smallest gap of the task that holds it, and of pieces
that want one gap the higher rank (longer, then first in the range) has it. Gaps are updated, a gap that still holds a piece of
the range stays in the sweep, and all others go into the next superstep with their new width. A size that a third of all
pieces have is cut by a hash, of pieces and gaps alike, and each superstep cuts anew.

Pieces over half a sequence open one. When a superstep places little, the largest pieces left open as many sequences as what is left needs. Once
the rest is small enough for a single task, its sweep ends the packing. The driver sees counts by length and width alone.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, materialize, spread

CAPACITY, END_ID = 1024, 2
#: Pieces and gaps that one task sweeps.
ROWS_A_TASK = 100_000
#: A superstep that places less than this part of the pieces makes new sequences open.
PROGRESS = 0.05
#: Distinct words whose ids a worker remembers.
REMEMBERED = 1_000_000


def tokenizer_path() -> str:
    """Merge ranks of ``byte_bpe_50k.json``, which lies beside; both give the same ids for texts without added tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids of texts as packed 32-bit numbers. Texts with an added token of ``contract`` (the JSON file of the
    tokenizer) go through ``tokenizers`` itself; without ``contract``, the strings of such tokens are ordinary text.

    The pre-tokenizer of byte-level BPE takes at most one blank in front of a word, so a text may be cut before each single
    blank and each distinct word is encoded once. New words are encoded together, joined by blanks: a token that begins
    with a blank begins a word. A text with two blanks in a row, or with an added token, is encoded whole.
    """

    def __init__(self, path: str, contract: str | None = None):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.raw = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.blank = np.zeros(max(ranks.values()) + 1, bool)
        self.blank[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True
        self.words: dict[str, bytes] = {}
        self.added, self.contract = [], None
        if contract:
            from tokenizers import Tokenizer

            self.added = [t["content"] for t in json.loads(Path(contract).read_text())["added_tokens"]]
            self.contract = Tokenizer.from_file(contract)

    def one(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.contract.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.raw(text), "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.raw(" " + " ".join(words)), "<u4")
        cut = np.flatnonzero(self.blank[ids])
        if len(cut) == len(words):
            data, at = ids.tobytes(), [*(4 * cut).tolist(), 4 * len(ids)]
            self.words.update(zip(words, [data[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        else:
            self.words.update((w, self.one(" " + w)) for w in words)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for begin in range(0, len(texts), 64):
            split = [None if "  " in t or t[:1] == " " or t[-1:] == " " or any(a in t for a in self.added) else t.split(" ") for t in texts[begin : begin + 64]]
            if len(self.words) > REMEMBERED:
                self.words.clear()
            new: set[str] = set()
            for s in split:
                new.update(s[1:] if s else ())
            if unknown := [w for w in new if w not in self.words]:
                self.learn(unknown)
            for t, s in zip(texts[begin : begin + 64], split, strict=True):
                out.append(self.one(t) if s is None else self.one(s[0]) + b"".join(map(self.words.__getitem__, s[1:])))
        return out


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, size bigint"


def _pieces(path: str, contract: str | None, capacity: int, end_id: int, carry: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(path, contract), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            texts = batch.column("text")
            kept = batch.column(carry).to_pylist() if carry else ids
            for begin in range(0, len(ids), 256):
                part = [t or "" for t in texts.slice(begin, 256).to_pylist()]
                cols: list[list] = [[] for _ in range(7)]
                for doc, data, own in zip(ids[begin : begin + 256], encode(part), kept[begin : begin + 256], strict=True):
                    data += end
                    n = len(data) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for col, x in zip(cols, (doc, i, a, b - a, zlib.crc32(data[4 * a : 4 * b]), n, own), strict=True):
                            col.append(x)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "size", *([carry] if carry else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols[: len(names)])], names=names)

    return run


def token_pieces(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, carry: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, size``: texts as token ids and an end id; longer ones in pieces, the first short.

    A null or empty text is its end id alone; null ids and repeated rows give pieces of their own. A text of any length is encoded
    whole, in one task, so it has to fit in a worker's memory several times. Other columns are ignored, but for ``carry``, a column of whole numbers; an empty table gives an empty one.
    """
    path = path or tokenizer_path()
    twin = Path(path).with_suffix(".json")
    more = [F.col(carry).cast("long").alias(carry)] if carry else []
    return docs.select("doc_id", "text", *more).mapInArrow(_pieces(path, str(twin) if twin.exists() else None, capacity, end_id, carry), PIECES + (f", `{carry}` bigint" if carry else ""))


SWEPT = "what int, id bigint, sequence_id bigint, offset bigint, length bigint"
PLACED, LEFT, GAP = 0, 1, 2


def sweep(rows: Iterator[tuple[bool, int, int]], capacity: int, last: bool) -> Iterator[tuple[int, int, int | None, int | None, int]]:
    """Best fit over ``(is a piece, id, length or width)``; rows come by falling size, gaps before pieces.

    Gives ``(what, id, sequence, offset, length)``. With ``last``, a piece without a gap opens a sequence, else it is left.
    """
    widths: list[int] = []  # with a gap, ascending
    gaps: dict[int, list[int]] = {}

    def add(width: int, sequence: int) -> None:
        if width not in gaps:
            gaps[width] = []
            bisect.insort(widths, width)
        gaps[width].append(sequence)

    for piece, ident, size in rows:
        if not piece:
            add(size, ident)
            continue
        at = bisect.bisect_left(widths, size)
        if at < len(widths):
            width = widths[at]
            sequence = gaps[width].pop()
            if not gaps[width]:
                del gaps[width], widths[at]
        elif last:
            width, sequence = capacity, ident
        else:
            yield LEFT, ident, None, None, size
            continue
        yield PLACED, ident, sequence, capacity - width, size
        if width > size:
            add(width - size, sequence)
    for width in widths:
        for sequence in gaps[width]:
            yield GAP, sequence, None, None, width


def _swept(capacity: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, i, n) for b in batches for p, i, n in zip(b.column("piece").to_pylist(), b.column("id").to_pylist(), b.column("length").to_pylist(), strict=True))
        out = sweep(rows, capacity, last)
        while part := list(itertools.islice(out, 1 << 14)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.int32()) for i, c in enumerate(zip(*part, strict=True))], names=["what", "id", "sequence_id", "offset", "length"])

    return run


def _opening(counts: dict[int, int], capacity: int, wanted: int) -> tuple[int, float]:
    """``(length, part)``: longer pieces open sequences, and of those with just this length the part, ``wanted`` in all."""
    for n in sorted(counts, reverse=True):
        if counts[n] >= wanted:
            return n, wanted / counts[n]
        wanted -= counts[n]
    return 0, 0.0


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, length`` (1 to ``capacity``).

    Null ids and repeated rows are pieces of their own, an empty table stays empty; further columns are carried, columns
    of the two names are replaced. Which of equally long pieces goes where is open. ``pieces`` is read twice: pass a written table.
    """
    spark = pieces.sparkSession
    named = materialize(pieces.drop("sequence_id", "offset").withColumn("_pid", F.monotonically_increasing_id()))
    left = named.select(F.col("_pid").alias("id"), "length")
    gaps = left.limit(0)
    placed = spark.createDataFrame([], "id bigint, sequence_id bigint, offset bigint")
    tally = lambda rows: {int(n): int(c) for n, c in rows.groupBy("length").count().collect()}  # noqa: E731  capacity rows at most
    counts, widths, step = tally(left), {}, 0
    stalled = True
    while counts:
        total = sum(counts.values())
        tasks = max(1, -(-(total + sum(widths.values())) // rows_a_task))
        if tasks > 1 and stalled:
            need = -(-sum(n * c for n, c in counts.items()) // capacity)
            halves = sum(c for n, c in counts.items() if 2 * n > capacity)
            edge, part = _opening(counts, capacity, max(need, halves))
            opens = (F.col("length") > edge) | ((F.col("length") == edge) & (spread("id", seed=step) < F.lit(int(part * 2**31))))
            first = left.filter(opens)
            placed = placed.unionByName(first.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
            gaps = gaps.unionByName(first.select("id", (capacity - F.col("length")).alias("length")).filter("length > 0"))
            left = left.filter(~opens)
        # The successor of a gap: the largest piece that is left and fits. One row a width.
        sizes = sorted(counts)
        fits = [(w, sizes[bisect.bisect_right(sizes, w) - 1]) for w in range(sizes[0], capacity + 1)]
        near = F.broadcast(spark.createDataFrame(fits, "length bigint, size bigint"))
        rows = left.select(F.lit(True).alias("piece"), "id", "length", F.col("length").alias("size"))
        rows = rows.unionByName(gaps.join(near, "length").select(F.lit(False).alias("piece"), "id", "length", "size"))
        order = [F.desc("size"), F.asc("piece"), F.asc("length"), F.asc("id")]
        if tasks > 1:
            dealt = rows.withColumn("cut", spread("id", seed=1000 + step)).repartitionByRange(tasks, F.desc("size"), "cut")
        else:
            dealt = rows.repartition(1)
        swept = materialize(dealt.sortWithinPartitions(*order).select("piece", "id", "length").mapInArrow(_swept(capacity, tasks == 1), SWEPT))
        placed = placed.unionByName(swept.filter(F.col("what") == PLACED).select("id", "sequence_id", "offset"))
        left, gaps = (swept.filter(F.col("what") == w).select("id", "length") for w in (LEFT, GAP))
        counts, widths = tally(left), tally(gaps)
        stalled = sum(counts.values()) > (1 - PROGRESS) * total
        step += 1
    return named.join(placed.withColumnRenamed("id", "_pid"), "_pid").drop("_pid")


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialize(token_pieces(documents(spark, sf_dir)).drop("size"))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
