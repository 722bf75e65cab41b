"""Substring deduplication over bytes, by distributed prefix doubling on sparse suffixes.

*Positions.* Every string of ``width`` bytes has one anchor: the position in it whose next 32 bytes have the least hash
(leftmost if several). Equal strings have the same anchor, so repeats are found from anchors alone, about one in eighty
positions. Each anchor knows the run of window starts that it serves.

*Doubling.* An anchor's rank after 32 bytes is the class of those bytes. Spark then groups (rank, rank of what follows)
pairs at offsets 32 and 64, and 128 up to the threshold, and reranks. A suffix that is alone in its class drops out, and none of its
windows that reach so far can have a twin: their run is cut short.

*Verdict.* If everything from an anchor's first window to the end of its last occurs elsewhere, all of them have twins (the
inside of a long repeat: one group-by). The windows that are left, at the ends of repeats, are compared by 96 bits and key
range of their content (see ``packed``) with each other and with one window run of each distinct long repeat.

No pairs of positions are listed at any point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packed import PACKED, key_partitions, match, pack, places_of, uids, with_uid
from .shared import HOT_KEYS, documents, materialize, release
from .textops import U64, Chunk, chunks, mix, ranges

WIDTH, SEED_BYTES = 200, 32
OFFSETS = [32, 64, 128]
KEY_BYTES = 5
DEALS = 1 << 20  # into which rows without a partner in a join are dealt
CHUNK = 512 << 10
INSIDE, TEST, SHOWN = 0, 1, 2


P = U64((1 << 31) - 1)


def _near(x: np.ndarray) -> np.ndarray:
    """``x`` (a temporary array, under ``2**63``) modulo the prime ``2**31 - 1``, or one or two more than that."""
    for _ in range(2):
        high = x >> U64(31)
        x &= P
        x += high
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    x = _near(x)
    return np.subtract(x, P, out=x, where=x >= P)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, _fold(out * U64(pow(base, len(out), int(P))))])
    return out


class _Residues:
    """Polynomial hash of byte ranges modulo a prime, from sums over prefixes."""

    def __init__(self, seed: int):
        self.table = _fold(mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) >> U64(1))
        self.base = int(mix(np.array([seed + 77], U64))[0]) % (int(P) - 1000) + 500
        self.power = self.inverse = np.ones(1, U64)

    def read(self, buf: np.ndarray) -> None:
        n = len(buf) + 1
        if len(self.power) < n:
            self.power, self.inverse = _powers(self.base, n), _powers(pow(self.base, -1, int(P)), n)
        self.prefix = np.zeros(n, U64)
        np.cumsum(_near(self.table[buf] * self.power[: n - 1]), out=self.prefix[1:])

    def range(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _fold(_near(self.prefix[begin + size] - self.prefix[begin]) * self.inverse[begin])


class Substrings:
    """62-bit fingerprints of any byte ranges of a buffer: two polynomials of random base modulo a prime, so that two
    different strings agree by chance alone, whatever their structure; ``seed`` picks an independent pair.
    """

    def __init__(self, seed: int):
        self.parts = _Residues(2 * seed), _Residues(2 * seed + 1)

    def read(self, buf: np.ndarray) -> "Substrings":
        for p in self.parts:
            p.read(buf)
        return self

    def at(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        a, b = (p.range(begin, size) for p in self.parts)
        return mix(((a << U64(31)) | b) + np.asarray(size).astype(U64) * U64(0x9E3779B97F4A7C15))


class Rolling:
    """Cheap 64-bit hashes of byte ranges. Where two strings agree by mistake, more windows than needed are compared."""

    def __init__(self, seed: int):
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        self.base = int(mix(np.array([seed + 77], U64))[0]) | 1
        self.power = self.inverse = np.ones(1, U64)

    def read(self, buf: np.ndarray) -> "Rolling":
        n = len(buf) + 1
        if len(self.power) < n:
            for name, base in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                out = np.full(n, base, U64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        self.prefix = np.zeros(n, U64)
        np.cumsum(self.table[buf] * self.power[: n - 1], out=self.prefix[1:])
        return self

    def at(self, begin: np.ndarray, size: int) -> np.ndarray:
        return mix((self.prefix[begin + size] - self.prefix[begin]) * self.inverse[begin] + U64(size))

    def every(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        return mix((self.prefix[size:] - self.prefix[:n]) * self.inverse[:n] + U64(size)) if n > 0 else np.zeros(0, U64)


class Anchors:
    """The anchors of a chunk: text, place in it, first and last window start that it serves (places in the buffer)."""

    def __init__(self, chunk: Chunk, hashes: Rolling, width: int):
        seeds = hashes.read(chunk.buf).every(SEED_BYTES)
        reach = width - SEED_BYTES + 1
        starts = ranges(chunk.byte_start[:-1], chunk.n_bytes - width + 1)
        if not len(starts):
            self.doc = self.at = self.first = self.last = np.zeros(0, np.int64)
            return
        least, size = (seeds & U64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=U64), 1
        while 2 * size <= reach:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < reach:
            least = np.minimum(least[: len(least) - (reach - size)], least[reach - size :])
        at = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
        begin = np.flatnonzero(new)
        self.at, self.first = at[begin], starts[begin]
        self.last = starts[np.append(begin[1:], len(starts)) - 1]
        self.doc = np.searchsorted(chunk.byte_start, self.at, "right") - 1
        self.key = seeds[self.at]


def _probes(width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Rolling(1)
        for table, texts in chunks(batches, size=CHUNK):
            chunk = Chunk(texts)
            a = Anchors(chunk, hashes, width)
            if len(a.at):
                yield from pack(a.key, None, a.doc, a.at - chunk.byte_start[a.doc], np.zeros(len(a.at), bool), *uids(table), parts, KEY_BYTES, False)

    return run


SUFFIXES = "uid_a bigint, uid_b bigint, at bigint, first bigint, last bigint, seed bigint, f32 bigint, f64 bigint, f128 bigint, span_a bigint, span_b bigint"
_SUFFIX_NAMES = [x.split()[0] for x in SUFFIXES.split(", ")]


def _suffixes(width: int):
    ends = [*OFFSETS[1:], width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, one, two = Rolling(1), Substrings(1), Substrings(2)
        for table, texts in chunks(batches, size=CHUNK):
            chunk = Chunk(texts)
            a = Anchors(chunk, rolling, width)
            if not len(a.at):
                continue
            base = chunk.byte_start[a.doc]
            mine = [places_of(h) for h in table.column("hits").to_pylist()]
            hit = np.concatenate([p + b for p, b in zip(mine, chunk.byte_start[:-1], strict=True)])
            keep = np.isin(a.at, hit)
            at, first, last, base, doc, key = (x[keep] for x in (a.at, a.first, a.last, base, a.doc, a.key))
            stop = base + chunk.n_bytes[doc]
            follow = []
            for begin, end in zip(OFFSETS, ends, strict=True):
                inside = at + end <= stop
                value = rolling.at(np.where(inside, at + begin, 0), end - begin)
                follow.append(pa.array(value.view(np.int64), mask=~inside))
            span = [h.read(chunk.buf).at(first, last - first + width).view(np.int64) for h in (one, two)]
            ua, ub = (u[doc] for u in uids(table))
            cols = [pa.array(ua), pa.array(ub), *[pa.array(x - base) for x in (at, first, last)], pa.array(key.view(np.int64)), *follow, *map(pa.array, span)]
            yield pa.RecordBatch.from_arrays(cols, names=_SUFFIX_NAMES)

    return run


def _looked_up(rows: DataFrame, table: DataFrame, keys: dict[str, str], hot: Column) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row a key, ``keys``: column of the table to column of the rows).

    Rows of the table for which ``hot`` holds, fewer than ``HOT_KEYS``, are broadcast. Rows that meet one of them, or
    that have no key, are dealt at random in the join of all others, so that none of its tasks is theirs alone.
    """
    values = [c for c in table.columns if c not in keys]
    side = lambda part, name: part.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.struct(F.lit(True).alias("_met"), *values).alias(f"_{name}"))
    same = lambda name: [F.col(f"_{name}_{k}") == F.col(c) for k, c in keys.items()]
    met = rows.join(F.broadcast(side(table.filter(hot), "hot")), same("hot"), "left")
    apart = F.col("_hot").isNotNull()
    for c in keys.values():
        apart |= F.col(c).isNull()
    met = met.withColumn("_deal", F.when(apart, 1 + F.pmod(F.xxhash64("uid_a", "uid_b", "at"), F.lit(DEALS))).otherwise(0))
    # Always zero, but no constant: one would leave the join's keys, and the rows would be dealt without it.
    cold = side(table, "cold").withColumn("_cold_deal", F.pmod(F.col("_cold._n"), F.lit(1)).cast("long"))
    met = met.join(cold, [*same("cold"), F.col("_deal") == F.col("_cold_deal")], "left").withColumn("_v", F.coalesce("_hot", "_cold"))
    return met.select(*rows.columns, F.col("_v").isNotNull().alias("met"), *[F.col(f"_v.{c}").alias(c) for c in values if not c.startswith("_n")])


def doubled(suffixes: DataFrame, width: int) -> DataFrame:
    """Rank pairs at growing offsets; ``last`` is cut back where a suffix turns out to be alone."""
    hot = F.col("_n") > max(1, suffixes.count() // HOT_KEYS)
    out, written = suffixes.withColumn("rank", F.col("seed")), None
    for begin, end in zip(OFFSETS, [*OFFSETS[1:], width], strict=True):
        follow = f"f{begin}"
        pairs = out.filter(F.col("rank").isNotNull() & F.col(follow).isNotNull()).groupBy("rank", follow)
        twice = pairs.agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        out = _looked_up(out, twice, {"rank": "rank", follow: follow}, hot)
        out = out.withColumn("last", F.when(F.col("met"), F.col("last")).otherwise(F.least("last", F.col("at") + (end - width - 1))))
        out = out.withColumn("rank", F.when(F.col("met"), F.xxhash64("rank", follow))).drop("met", follow)
        before, written = written, materialize(out)
        out = written
        if before is not None:
            release(before)
    return written


def verdicts(suffixes: DataFrame, width: int) -> DataFrame:
    """``run_a, run_b, runs``: per text, runs of window starts that have twins (INSIDE), may have (TEST), or have twins and are shown to others (SHOWN)."""
    me = F.struct("uid_a", "uid_b", "at")
    spans = suffixes.groupBy("span_a", "span_b").agg(F.count(F.lit(1)).alias("_n"), F.min(me).alias("first_at")).filter("_n > 1")
    ends = doubled(suffixes.withColumn("whole", F.col("last")), width)
    judged = _looked_up(ends, spans, {"span_a": "span_a", "span_b": "span_b"}, F.col("_n") > max(1, ends.count() // HOT_KEYS))
    judged = judged.withColumnRenamed("met", "inside").withColumn("one", F.coalesce(F.col("first_at") == me, F.lit(False)))
    judged = materialize(judged.filter("inside OR first <= last").select("uid_a", "uid_b", "at", "seed", "first", "last", "whole", "inside", "one"))
    release(suffixes, ends)
    open_seeds = judged.filter("NOT inside").select(F.col("seed").alias("_seed")).distinct()
    shown = judged.filter("one").join(open_seeds, F.col("seed") == F.col("_seed"), "left_semi")
    run = lambda kind, end: F.struct(F.lit(kind).alias("kind"), F.col("first").cast("int").alias("first"), F.col(end).cast("int").alias("last"))
    rows = judged.filter("NOT inside").select("uid_a", "uid_b", run(TEST, "last").alias("run"))
    rows = rows.unionByName(judged.filter("inside").select("uid_a", "uid_b", run(INSIDE, "whole").alias("run")))
    rows = rows.unionByName(shown.select("uid_a", "uid_b", run(SHOWN, "whole").alias("run")))
    runs = materialize(rows.groupBy(F.col("uid_a").alias("run_a"), F.col("uid_b").alias("run_b")).agg(F.collect_list("run").alias("runs")))
    release(judged)
    return runs


def _runs(table: pa.Table, kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, kind, first and last of all runs of a chunk."""
    lists = table.column("runs").combine_chunks()
    doc = np.repeat(np.arange(len(lists)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))
    flat = lists.flatten()
    kind, first, last = (np.asarray(flat.field(i), np.int64) for i in range(3))
    keep = np.isin(kind, kinds)
    return doc[keep], kind[keep], first[keep], last[keep]


def _windows(width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Substrings(3), Substrings(4)
        for table, texts in chunks(batches, size=CHUNK):
            doc, kind, first, last = _runs(table, (TEST, SHOWN))
            if not len(doc):
                continue
            chunk = Chunk(texts)
            n = last - first + 1
            place = ranges(first, n)
            doc, flag = np.repeat(doc, n), np.repeat(kind == SHOWN, n)
            at = place + chunk.byte_start[doc]
            key, low = one.read(chunk.buf).at(at, width), two.read(chunk.buf).at(at, width) & U64(0xFFFFFFFF)
            yield from pack(key, low, doc, place, flag, *uids(table), parts, 8, True)

    return run


OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,bytes:int>>, kept binary"


def _removed(width: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches, size=CHUNK):
            doc, _, first, last = _runs(table, (INSIDE, SHOWN))
            order = np.argsort(doc, kind="stable")
            doc, first, last = doc[order], first[order], last[order]
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            hits, rows = table.column("hits").to_pylist(), []
            for i, text in enumerate(texts):
                n, own = len(text), places_of(hits[i])
                begin = np.concatenate([first[cut[i] : cut[i + 1]], own])
                if not len(begin):
                    rows.append((n, 0, 0, hashlib.sha256(text).hexdigest(), [], text if keep_text else None))
                    continue
                end = np.concatenate([last[cut[i] : cut[i + 1]], own]) + width
                gone = np.cumsum(np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1])[:n] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = [{"start": a, "bytes": b - a} for a, b in edge.reshape(-1, 2).tolist()]
                rows.append((n, int(gone.sum()), len(spans), hashlib.sha256(left).hexdigest(), spans, left if keep_text else None))
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("bytes", pa.int32())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in OUT.split(", ")])

    return run


def repeated_bytes(docs: DataFrame, *, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``n_bytes, n_removed, n_spans, kept_sha256``, removed ``spans``, ``kept`` bytes.

    A byte goes if a string of ``width`` bytes (over 128) over it also starts at another place of the table, in the same
    text or another; no string crosses texts. Null, empty and shorter texts lose nothing. Repeated rows are two places.
    Null ids are allowed. An empty table gives an empty one. Other columns of ``docs`` are ignored.
    """
    texts = with_uid(docs.select("doc_id", "text"))
    parts = key_partitions(docs)
    probes = texts.select("uid_a", "uid_b", "text").mapInArrow(_probes(width, parts), PACKED)
    found = materialize(match(probes, parts, width=KEY_BYTES))
    hits = found.groupBy("hit_a", "hit_b").agg(F.collect_list("hits").alias("hits"))
    mine = (F.col("uid_a") == F.col("hit_a")) & (F.col("uid_b") == F.col("hit_b"))
    suffixes = materialize(texts.join(hits, mine).select("uid_a", "uid_b", "text", "hits").mapInArrow(_suffixes(width), SUFFIXES))
    release(found)
    runs = verdicts(suffixes, width)
    # Both joins below deal the same columns of the texts by the same key, so Spark shuffles the texts once.
    judged = texts.join(runs, (F.col("uid_a") == F.col("run_a")) & (F.col("uid_b") == F.col("run_b")), "left").drop("run_a", "run_b")
    twins = match(judged.mapInArrow(_windows(width, parts), PACKED), parts, width=8, with_low=True)
    twins = twins.groupBy("hit_a", "hit_b").agg(F.collect_list("hits").alias("hits"))
    return judged.join(twins, mine, "left").select("doc_id", "text", "runs", "hits").mapInArrow(_removed(width, keep_text), OUT)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir), keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP6_SQL = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, i, md5(b[i + 1:i + 200]) AS k FROM t, unnest(range(0, octet_length(b) - 199)) AS r(i)),
twin AS (SELECT doc_id, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM twin),
run AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
piece AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM run),
gone AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS last, string_agg(hex(b[kept_from + 1:a]), '' ORDER BY a) AS kept
  FROM piece JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1:octet_length(b)]))) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id)
"""
