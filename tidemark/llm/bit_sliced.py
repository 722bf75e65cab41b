"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers. The index is a table of blocks of some 32,768 vectors; a block holds, for each attribute
and each bit of its values, a bitmap over its rows. A query weighs an attribute by its own integer component:

1. *add*: the slices of the upper bits of all attributes, shifted by the set bits of their weights, are summed by
   bitmap arithmetic (carry-save adders over whole bitmaps) into the slices of a coarse score; an attribute with a negative weight
   gives its complement, so all terms count up;
2. *select*: from the most significant score slice downward, the k-th largest coarse score is found by counting bits;
3. *resolve*: the lower bits that were left out can add a known amount at most, so the rows within that amount of the
   k-th one (or of the k-th exact score found before) are the boundary: their integer inner products decide, ties by id.

Blocks and query pieces meet in a grid of cells, each cell one Spark partition: a group of blocks is read into memory and
query pieces stream past it. Index blocks are sent once for each 131,072 queries, queries once for each group of blocks (:class:`Layout`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, partitions, release

SCALE, EVERY, K = 256, 50, 5


@dataclass(frozen=True)
class Layout:
    """Rows that a block is planned for, blocks that share a cell, queries that travel as one row, queries that a cell
    answers, and bits of each attribute that the coarse score counts. Results don't depend on any of them."""

    block_rows: int = 32_768
    blocks_a_cell: int = 8
    queries_a_piece: int = 64
    queries_a_cell: int = 131_072
    coarse_bits: int = 6


BLOCK = pa.schema([("dims", pa.int32()), ("n", pa.int32()), ("bits", pa.int32()), ("ids", pa.binary()), ("known", pa.binary()), ("least", pa.binary()), ("slices", pa.binary())])
PIECE = pa.schema([("dims", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("least", pa.binary())])
FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, c``: floor(scale * component) of every vector that is not null and holds neither null nor non-finite components."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))  # NaN is larger than infinity
    return vectors.filter(x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("c"))


def _by_length(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``ids, known, values`` of up to ``most`` vectors of one length."""
    held: dict[int, list] = {}
    rows: dict[int, int] = {}

    def out(size: int):
        ids, known, values = (np.concatenate(x) for x in zip(*held.pop(size), strict=True))
        n = rows.pop(size)
        yield from ((ids[a : a + most], known[a : a + most], values[a : a + most]) for a in range(0, n, most))

    for batch in batches:
        lists, ids = batch.column("c"), batch.column("vec_id")
        sizes = np.diff(lists.offsets.to_numpy())
        flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            held.setdefault(size, []).append((ids[at], known[at], flat[starts[at][:, None] + np.arange(size)].astype(np.int64)))
            rows[size] = rows.get(size, 0) + len(at)
        while sum(n * (s + 1) for s, n in rows.items()) > max(most, 4096) * 65:
            yield from out(max(rows, key=lambda s: rows[s] * (s + 1)))
    for size in list(rows):
        yield from out(size)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for ids, known, values in _by_length(batches, most):
        order = np.lexsort((ids, ~known))  # ties go to the smaller id: the earlier row; rows without id come last
        ids, known, values = ids[order], known[order], values[order]
        least = values.min(0)
        above = (values - least).astype(np.uint64)
        bits = int(above.max()).bit_length() if above.size else 0
        slices = np.stack([_bitmaps(above.T >> np.uint64(b) & np.uint64(1)) for b in range(bits)], 1) if bits else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_pylist([{"dims": values.shape[1], "n": len(ids), "bits": bits, "ids": ids.tobytes(), "known": known.tobytes(), "least": least.tobytes(), "slices": slices.tobytes()}], schema=BLOCK)


def _bitmaps(flags: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words."""
    packed = np.packbits(flags.astype(np.uint8), axis=-1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)])).view(np.uint64)


def _flags(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bitmap.view(np.uint8), axis=-1, bitorder="little")[..., :n]


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for ids, _, values in _by_length(batches, most):
        yield pa.RecordBatch.from_pylist([{"dims": values.shape[1], "n": len(ids), "ids": ids.tobytes(), "least": values.tobytes()}], schema=PIECE)


class Block:
    """A block in memory: coarse slices, their complements, and the integers themselves."""

    def __init__(self, row: dict, coarse_bits: int) -> None:
        self.n, self.dims, bits = row["n"], row["dims"], row["bits"]
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.least = np.frombuffer(row["least"], np.int64)
        words = -(-self.n // 64)
        slices = np.frombuffer(row["slices"], np.uint64).reshape(self.dims, bits, words)
        values = np.repeat(self.least[None, :], self.n, 0)
        for b in range(bits):
            values += _flags(slices[:, b], self.n).T.astype(np.int64) << b
        self.left_out = max(0, bits - coarse_bits)
        high = slices[:, self.left_out :]
        self.bits, self.rows = high.shape[1], _bitmaps(np.ones((1, self.n)))[0]
        self.terms = np.concatenate([high, ~high]).reshape(2 * self.dims * self.bits, words)  # attribute by attribute, then its complements
        self.width = max(-int(values.min()), int(values.max())) if values.size else 0
        self.values = values.astype(np.int32) if self.width < 1 << 31 else values

    def coarse(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum over attributes of |q| times its upper bits (their complement where q is negative)."""
        weights = np.abs(q)
        first = (np.arange(len(q)) + self.dims * (q < 0)) * self.bits
        waiting: dict[int, list[np.ndarray]] = {}
        for p in range(int(weights.max(initial=0)).bit_length()):
            for b in range(self.bits):
                waiting.setdefault(p + b, []).append(first[weights >> p & 1 == 1] + b)
        out: list[np.ndarray] = []
        carried = self.terms[:0]
        while waiting or len(carried):
            which = np.concatenate(waiting.pop(len(out), [np.zeros(0, np.int64)]))
            same = np.concatenate([self.terms[which], carried])
            carries = []
            while len(same) > 1:
                third = len(same) // 3
                if third:
                    a, b, c = same[:third], same[third : 2 * third], same[2 * third : 3 * third]
                    half = a ^ b
                    carries.append((a & b) | (half & c))
                    same = np.concatenate([half ^ c, same[3 * third :]])
                else:
                    carries.append(same[:1] & same[1:])
                    same = same[:1] ^ same[1:]
            out.append(same[0] if len(same) else np.zeros_like(self.rows))
            carried = np.concatenate(carries) if carries else self.terms[:0]
        return out

    def boundary(self, q: np.ndarray, own: np.ndarray, k: int, least: int | None) -> np.ndarray:
        """Places of the rows that may be among the k best: none of the others is. ``own`` flags rows that don't count, ``least`` is a score to reach."""
        slices = self.coarse(q)
        rows = self.rows & ~_bitmaps(own[None, :])[0] if own.any() else self.rows
        # the k-th largest coarse value, from the most significant slice downward
        sure, even, value = 0, rows, 0
        for i in range(len(slices) - 1, -1, -1):
            more = even & slices[i]
            n = sure + int(np.bitwise_count(more).sum())
            if n >= k:
                even, value = more, value | 1 << i
            else:
                sure, even = n, even & ~slices[i]
        # what the bits left out can add, in units of the coarse score
        open_bits = (1 << self.left_out) - 1
        slack = open_bits * int(np.abs(q).sum())
        reach = (value << self.left_out) - slack
        if least is not None:
            reach = max(reach, least - self.base(q) - slack)
        return np.flatnonzero(_flags(_at_least(slices, rows, -(-reach >> self.left_out) if reach > 0 else 0), self.n))

    def base(self, q: np.ndarray) -> int:
        """The score of a row whose terms all count nothing."""
        top = (1 << self.bits + self.left_out) - 1
        return sum(int(w) * (int(m) + (top if w < 0 else 0)) for w, m in zip(q, self.least, strict=True))

    def scores(self, q: np.ndarray, at: np.ndarray) -> list[int]:
        if self.width * int(np.abs(q).max(initial=0)) * max(1, len(q)) < 1 << 62:
            return (self.values[at].astype(np.int64) @ q).tolist()
        return (self.values[at].astype(object) @ q.astype(object)).tolist()


def _at_least(slices: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """Rows whose sliced number is ``value`` or more."""
    if value >> len(slices):
        return np.zeros_like(rows)
    above, even = np.zeros_like(rows), rows
    for i in range(len(slices) - 1, -1, -1):
        if value >> i & 1:
            even = even & slices[i]
        else:
            above, even = above | (even & slices[i]), even & ~slices[i]
    return above | even


def best(block: Block, q: np.ndarray, query_id: int, k: int, held: list[tuple]) -> list[tuple]:
    """``held`` (score, known, id; best first) with the rows of ``block``; of an attribute that one side lacks nothing is counted."""
    both = min(block.dims, len(q))
    q = np.concatenate([q[:both], np.zeros(block.dims - both, np.int64)])
    own = block.known & (block.ids == query_id)
    at = block.boundary(q, own, k, held[k - 1][0] if len(held) >= k else None)
    rows = zip(block.scores(q, at), block.known[at].tolist(), block.ids[at].tolist(), strict=True)
    return sorted([*held, *rows], key=lambda r: (-r[0], not r[1], r[2]))[:k]


def _answers(k: int, layout: Layout):
    """Answers of the cells of a partition; a cell's blocks come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, blocks = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != cell:
                    cell, blocks = row["cell"], []
                if row["piece"] is None:
                    blocks.append(Block(row, layout.coarse_bits))
                    continue
                ids, values = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["least"], np.int64).reshape(row["n"], row["dims"])
                out = []
                for i, (query_id, q) in enumerate(zip(ids.tolist(), values, strict=True)):
                    held: list[tuple] = []
                    for block in blocks:
                        held = best(block, q, query_id, k, held)
                    out += [{"query": row["piece"] * layout.queries_a_piece + i, "query_id": query_id, "vec_id": v if known else None, "score": min(max(s, _LONG.min), _LONG.max)} for s, known, v in held]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=FOUND)

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def index(vectors: DataFrame, scale: int = SCALE, layout: Layout = Layout()) -> DataFrame:
    """The bit-sliced blocks of all usable vectors, as a table. No row is shuffled: tasks of small inputs are joined, so blocks fill."""
    usable = quantised(vectors, scale)
    tasks = max(1, -(-usable.count() // layout.block_rows))
    return materialize(usable.coalesce(tasks).mapInArrow(lambda batches: _blocks(batches, 2 * layout.block_rows), _ddl(BLOCK)))


def search(vectors: DataFrame, queries: Column, *, k: int = K, scale: int = SCALE, layout: Layout = Layout()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` that ``queries`` (a condition) names, its k best among the others.

    ``vectors`` needs ``vec_id, embedding``; further columns aren't read. Vectors that are null or hold null or
    non-finite components take no part, neither as query nor as candidate; empty vectors score 0 with all. Vectors of unequal length
    meet in the components that both have. Rows with the query's own id are its own and no candidates of it; rows that repeat a
    query's id are queries of their own, each with its ranks. Rows without id are no queries, and as candidates come after all
    ids with the same score. Equal scores go to the smaller id. Quantised components beyond a long, and scores beyond it, stay at its ends.
    With fewer than k candidates all are returned; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    blocks = index(vectors, scale, layout)
    asked = quantised(vectors.filter(queries & F.col("vec_id").isNotNull()), scale)
    tasks = max(1, -(-asked.count() // layout.block_rows))
    pieces = materialize(asked.coalesce(tasks).mapInArrow(lambda batches: _pieces(batches, layout.queries_a_piece), _ddl(PIECE)))
    groups = max(1, -(-blocks.count() // layout.blocks_a_cell))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    strips = max(-(-total // layout.queries_a_cell), -(-partitions(spark) // groups), 1)

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = F.monotonically_increasing_id()
    left = blocks.withColumn("group", F.pmod(F.xxhash64(number), F.lit(groups))).select("*", F.lit(None).cast("long").alias("piece"), numbers(strips).alias("strip"))
    right = pieces.withColumn("piece", number).withColumn("strip", F.pmod(F.xxhash64("piece"), F.lit(strips))).select("*", numbers(groups).alias("group"))
    cell = (F.col("group") * strips + F.col("strip")).cast("int")
    columns = [*BLOCK.names, "piece", "cell"]
    sent = left.withColumn("cell", cell).select(columns).unionByName(right.withColumn("cell", cell).select("dims", "n", "ids", "least", "piece", "cell"), allowMissingColumns=True)
    met = sent.repartitionById(groups * strips, F.col("cell")).sortWithinPartitions("cell", F.asc_nulls_first("piece"))
    found = materialize(met.mapInArrow(_answers(k, layout), _ddl(FOUND)))
    release(blocks, pieces)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, o.vec_id, list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * o.c[i]))::BIGINT AS score
  FROM v q, v o WHERE q.vec_id % 50 = 0 AND q.vec_id <> o.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
