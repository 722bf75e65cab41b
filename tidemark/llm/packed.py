"""Find window keys that occur at more than one place, with a few bytes of shuffle per window.

A task turns a chunk of texts into (key, place) pairs and combines them first: of windows with one key it sends a single
one, so a passage that a third of all texts share costs one pair per chunk. The pairs of a chunk are cut by key range and
packed, one row for each chunk and range: key bytes and places in column order, and the ids of the texts. Ranges become
Spark partitions (``repartitionById``), each sorts its own keys, and what comes back is places, by text.

Places of a text are ``uid`` (two 64-bit numbers, see :func:`with_uid`) and positions within the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (fills pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import U64, chunks

#: Text bytes that one partition of keys may stand for, and the fewest partitions.
BYTES_A_PARTITION, LEAST_PARTITIONS = 256 << 20, 40

PACKED = "bucket int, n int, keys binary, flags binary, places binary, docs binary, hit_a bigint, hit_b bigint, hits binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("flags", pa.binary()), ("places", pa.binary()), ("docs", pa.binary()), ("hit_a", pa.int64()), ("hit_b", pa.int64()), ("hits", pa.binary())])
HITS = "hit_a bigint, hit_b bigint, hits binary"
HITS_ARROW = pa.schema([("hit_a", pa.int64()), ("hit_b", pa.int64()), ("hits", pa.binary())])


def with_uid(docs: DataFrame) -> DataFrame:
    """Add ``uid_a, uid_b``: 128 bits of (doc_id, text). Rows that repeat both share them, and share all that is found."""
    return docs.withColumn("uid_a", F.xxhash64("doc_id", "text")).withColumn("uid_b", F.xxhash64(F.lit(7), "text", "doc_id"))


def key_partitions(docs: DataFrame) -> int:
    """Partitions for the keys, by the size of the texts alone: 40 at least, one for 16 MB, beyond 64 GB 4096, beyond 1 TB one for 256 MB."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(LEAST_PARTITIONS, min(-(-size // (BYTES_A_PARTITION // 16)), 4096), -(-size // BYTES_A_PARTITION))


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, first all lowest bytes, then all second ones: high zeros compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _rows(cols: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    n = max(map(len, cols.values()))
    return pa.RecordBatch.from_arrays([pa.array(cols.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def hit_rows(doc: np.ndarray, place: np.ndarray, uid_a: np.ndarray, uid_b: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Places by text, as one row for each text that has any."""
    if not len(doc):
        return
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
    which = doc[cut[:-1]]
    data = place.astype("<u4")
    yield _rows({"bucket": (which % 4096).tolist(), "hit_a": uid_a[which].tolist(), "hit_b": uid_b[which].tolist(), "hits": [data[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]}, schema)


def pack(key: np.ndarray, low: np.ndarray | None, doc: np.ndarray, place: np.ndarray, flag: np.ndarray, uid_a: np.ndarray, uid_b: np.ndarray, parts: int, width: int, wide_local: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk. ``key`` (64 bits) and ``low`` (32 more, or None) name a window, ``flag`` marks anchors.

    Places of keys that the chunk itself holds twice go out as hits at once (with ``wide_local``: flagged or not).
    """
    if not len(key):
        return
    order = np.argsort(key, kind="stable") if low is None else np.lexsort((low, key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    if low is not None:
        new[1:] |= low[order][1:] != low[order][:-1]
    first = np.flatnonzero(new)
    many = np.diff(np.concatenate([first, [len(k)]])) > 1
    group = np.cumsum(new) - 1
    flagged = np.logical_or.reduceat(flag[order], first)
    here = order[many[group]]
    yield from hit_rows(doc[here], place[here], uid_a, uid_b, PACKED_ARROW)

    rep = order[first]
    back = np.argsort(rep, kind="stable")  # in the order of the text: places grow by little
    rep, state = rep[back], (flagged | many)[back] if wide_local else flagged[back]
    bucket = ((key[rep] >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    rep, state, bucket = rep[by], state[by], bucket[by]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    cols: dict[str, list] = {c: [] for c in ("bucket", "n", "keys", "flags", "places", "docs")}
    for a, b in zip(cut, cut[1:], strict=False):
        at = rep[a:b]
        d, p = doc[at], place[at]
        step = np.concatenate([[True], d[1:] != d[:-1]])
        gap = np.where(step, p, p - np.concatenate([[0], p[:-1]]))
        head = np.flatnonzero(step)
        count = np.diff(np.concatenate([head, [len(d)]]))
        cols["bucket"].append(int(bucket[a]))
        cols["n"].append(int(b - a))
        cols["keys"].append(planes(key[at], width) + (planes(low[at], 4) if low is not None else b""))
        cols["flags"].append(np.packbits(state[a:b]).tobytes())
        cols["places"].append(planes(gap, 4))
        cols["docs"].append(uid_a[d[head]].astype("<i8").tobytes() + uid_b[d[head]].astype("<i8").tobytes() + count.astype("<u4").tobytes())
    yield _rows(cols, PACKED_ARROW)


def _matched(width: int, with_low: bool, need_flag: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lows, flags, places, docs, ua, ub, seen = [], [], [], [], [], [], [], 0
        for batch in batches:
            hits = batch.filter(pa.compute.is_valid(batch.column("hits")))
            if hits.num_rows:
                yield hits.select(HITS_ARROW.names)
            for x in batch.filter(pa.compute.is_valid(batch.column("keys"))).select(["n", "keys", "flags", "places", "docs"]).to_pylist():
                n = x["n"]
                keys.append(from_planes(x["keys"][: n * width], n, width))
                if with_low:
                    lows.append(from_planes(x["keys"][n * width :], n, 4).astype(np.uint32))
                flags.append(np.unpackbits(np.frombuffer(x["flags"], np.uint8), count=n).astype(bool))
                m = len(x["docs"]) // 20
                count = np.frombuffer(x["docs"], "<u4", offset=16 * m)
                head = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
                sums = np.cumsum(from_planes(x["places"], n, 4).astype(np.int64))
                base = np.concatenate([[0], sums[head[1:] - 1]])
                places.append((sums - np.repeat(base, count)).astype(np.uint32))
                docs.append(np.repeat(np.arange(seen, seen + m, dtype=np.int32), count))
                ua.append(np.frombuffer(x["docs"], "<i8", m))
                ub.append(np.frombuffer(x["docs"], "<i8", m, offset=8 * m))
                seen += m
        if not keys:
            return
        key = np.concatenate(keys)
        low = np.concatenate(lows) if with_low else None
        flag = np.concatenate(flags)
        del keys, lows, flags
        order = np.argsort(key, kind="stable") if low is None else np.lexsort((low, key))
        k = key[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        if low is not None:
            new[1:] |= low[order][1:] != low[order][:-1]
        first = np.flatnonzero(new)
        size, any_flag = np.diff(np.concatenate([first, [len(k)]])), np.logical_or.reduceat(flag[order], first)
        good = (size > 1) & any_flag if need_flag else (size > 1) | any_flag
        at = order[good[np.cumsum(new) - 1]]
        doc, place = np.concatenate(docs)[at], np.concatenate(places)[at].astype(np.int64)
        yield from hit_rows(doc, place, np.concatenate(ua), np.concatenate(ub), HITS_ARROW)

    return run


def match(packed: DataFrame, parts: int, *, width: int, with_low: bool = False, need_flag: bool = False) -> DataFrame:
    """``hit_a, hit_b, hits``: the places of all keys that occur twice (``need_flag``: and are an anchor somewhere).

    A text has several rows. Without ``need_flag`` a flag says that the key occurs twice within its chunk.
    """
    dealt = packed.repartitionById(parts, F.pmod(F.col("bucket"), F.lit(parts)).cast("int"))
    return dealt.mapInArrow(_matched(width, with_low, need_flag), HITS)


def gathered(hits: DataFrame) -> DataFrame:
    """One row a text: ``hit_a, hit_b, hits`` as an array of packed places. A chunk and a key range give one element."""
    return hits.groupBy("hit_a", "hit_b").agg(F.collect_list("hits").alias("hits"))


def joined(docs: DataFrame, hits: DataFrame) -> DataFrame:
    return docs.join(gathered(hits), (F.col("uid_a") == F.col("hit_a")) & (F.col("uid_b") == F.col("hit_b")), "left").drop("hit_a", "hit_b")


def places_of(hits: list | None) -> np.ndarray:
    """Distinct places, ascending."""
    if not hits:
        return np.zeros(0, np.int64)
    return np.unique(np.frombuffer(b"".join(hits), "<u4")).astype(np.int64)


def uids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("uid_a").to_numpy(), table.column("uid_b").to_numpy()


__all__ = ["HITS", "PACKED", "chunks", "gathered", "joined", "key_partitions", "match", "pack", "places_of", "uids", "with_uid"]
