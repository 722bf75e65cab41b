"""Where any of many patterns occurs in any of many texts, at any number of either.

Every pattern is known by one of its grams: of size 16, or the largest power of two that fits into it, and of those the one whose hash is
smallest, so that patterns with a common opening don't meet. Texts send those of their grams (of the sizes that occur) that a Bloom
filter of fixed size doesn't exclude; grams and patterns are joined by hash, and what is found is compared character by character.
The filter saves shuffling, it decides nothing: a table of patterns that fills it is joined all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

SIZES = (1, 2, 4, 8, 16)

#: Bits of the filter (2 MB, whatever the tables), and characters of texts that are hashed together.
FILTER_BITS, CHUNK = 24, 1 << 20

_STEP, _SPREAD, _FINAL = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MASK = np.uint64((1 << FILTER_BITS) - 1)


def gram_hashes(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``size, hashes`` for each size: one hash for every place that has so many characters before the end."""
    h = points * _SPREAD
    h ^= h >> np.uint64(29)
    for size in SIZES:
        out = (h + np.uint64(size)) * _FINAL
        yield size, out ^ out >> np.uint64(31)
        if len(h) <= size:
            return
        h = h[:-size] * _STEP + h[size:]
        h ^= h >> np.uint64(32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _anchors(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, offset, size = [], [], []
            for value in batch.column(text).to_pylist():
                for size_of, hashes in gram_hashes(_points(value)):
                    own, at = size_of, hashes
                place = int(at.argmin())
                key.append(int(at[place].astype(np.int64)))
                offset.append(place)
                size.append(own)
            more = [pa.array(offset, pa.int32()), pa.array(size, pa.int32()), pa.array(key, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "offset", "gram", "hash"])

    return run


def anchored(patterns: DataFrame, text: str) -> DataFrame:
    """``patterns`` (none empty) with ``offset, gram, hash``: the place, size and hash of the gram that each is known by."""
    schema = StructType([*patterns.schema.fields, StructField("offset", IntegerType()), StructField("gram", IntegerType()), StructField("hash", LongType())])
    return patterns.mapInArrow(_anchors(text), schema)


def _filter(keyed: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The Bloom filter as 64-bit words, and the sizes that occur; 2^18 rows come to the driver at most."""
    bit = F.explode(F.array(F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1), F.shiftrightunsigned("hash", 32).bitwiseAND((1 << FILTER_BITS) - 1))).alias("bit")
    words = keyed.select(bit).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS INT))")).alias("bits")).collect()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    if words:
        at, bits = zip(*words, strict=True)
        out[np.array(at)] = np.array(bits, np.int64).view(np.uint64)
    return out, [r.gram for r in keyed.select("gram").distinct().collect()]


def _windows(words: np.ndarray, sizes: list[int]):
    held = lambda at: words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1

    def hits(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = _points("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        room = np.repeat(ends, [len(t) for t in texts]) - np.arange(len(points))
        found = []
        for size, h in gram_hashes(points) if len(points) else ():
            if size in sizes:
                near = np.flatnonzero((room[: len(h)] >= size) & held(h & _MASK))
                near = near[held(h[near] >> np.uint64(32) & _MASK)]
                found.append((near, h[near]))
        place = np.concatenate([p for p, _ in found] or [np.zeros(0, np.int64)])
        which = np.searchsorted(ends, place, side="right")
        return which, place - np.concatenate([[0], ends])[which], np.concatenate([h for _, h in found] or [np.zeros(0, np.uint64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
                    size += len(texts[last])
                    last += 1
                which, place, h = hits(texts[first:last])
                if len(which):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which + first)), pa.array(place, pa.int32()), pa.array(h.astype(np.int64))], names=["_key", "_place", "hash"])
                first = last

    return run


def occurrences(texts: DataFrame, patterns: DataFrame, *, key: str, text: str, pattern: str) -> DataFrame:
    """The columns of ``patterns`` with ``key`` and ``char_start`` of every place where a text holds the pattern, overlapping ones included.

    ``key`` tells the texts apart. Null texts hold nothing; null and empty patterns are nowhere. Places count code points.
    """
    keyed = anchored(patterns.filter(F.length(pattern) > 0), pattern)
    words, sizes = _filter(keyed)
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(words)
    narrow = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = StructType([narrow.schema["_key"], StructField("_place", IntegerType()), StructField("hash", LongType())])
    grams = narrow.select("_key", "_text").mapInArrow(lambda batches: _windows(shared.value, sizes)(batches), schema)
    near = grams.join(keyed, "hash").withColumn("char_start", F.col("_place") - F.col("offset")).filter("char_start >= 0")
    same = F.substr(F.col("_text"), F.col("char_start") + 1, F.length(pattern)) == F.col(pattern)
    return near.join(narrow, "_key").filter(same).select(F.col("_key").alias(key), *[c for c in patterns.columns if c != key], "char_start")
