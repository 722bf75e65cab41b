"""Mixing sources to target weights, by Pfair scheduling of blocks.

Each source's rows are dealt at random into blocks of equal size. With target weight ``w``, its ``k``-th block (from 1) is
released at slot ``floor((k - 1) / w)`` and due by slot ``ceil(k / w)``; in every slot the released block with the earliest
deadline runs. Such a schedule meets all deadlines, so after any number ``t`` of slots a source that still has blocks has had
``w * t`` of them, give or take less than one. Releases and deadlines are worked out in whole numbers from the exact ratio of
the weights, so the bound holds for the weights asked for, over the whole schedule and for any number of sources. One pass
over the blocks (not the rows; ``MOST_BLOCKS`` and one a source at most) assigns the slots; it holds two entries a source.

Rows are ranked within their source by many tasks: the range of a hash of the row is cut into buckets of about
``BUCKET_ROWS`` rows, bucket counts become offsets, and the slots of a bucket's blocks meet its rows as one array. So whole
rows are shuffled once to be ranked, and once more if they are sorted by slot.

A source that has run out leaves its slots empty; the others keep their own slots, and with them their weights among
each other. No row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import documents, materialize, spread

#: Rows in a block, at least, and blocks in a schedule, at most: larger tables have larger blocks.
BLOCK_ROWS, MOST_BLOCKS, TEMPERATURE = 8, 4_000_000, 0.5
BUCKET_ROWS = 4096
BATCH = 1 << 16
SCHEDULE = "_source string, _block long, _slot long, _release long, _deadline long"


def whole_weights(weights: dict[str | None, float], frame: int) -> dict[str | None, int]:
    """Multiples of ``1 / frame`` that sum to it, one at least each: largest remainders first, then by name."""
    if len(weights) > frame:
        raise ValueError(f"{len(weights)} sources need a frame of as many slots at least, not {frame}")
    total = sum(weights.values())
    exact = {s: w / total * (frame - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s is None, s or ""))[: frame - sum(out.values())]:
        out[s] += 1
    return out


def exact_weights(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in exactly the ratio of the weights (every float is a fraction)."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*{x.denominator for x in exact.values()})
    return {s: x.numerator * (scale // x.denominator) for s, x in exact.items()}


def schedule(shares: dict[str | None, int], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """``(source, k, slot, release, deadline)`` of all blocks by slot, for weights ``share / sum(shares)``."""
    total = sum(shares.values())
    name = lambda s: (s is None, s or "")
    waiting = [(0, -(-total // share), name(s), 1) for s, share in shares.items() if blocks[s]]
    heapq.heapify(waiting)
    ready: list = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, deadline, order, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, order, k, release))
        deadline, order, k, release = heapq.heappop(ready)
        s = None if order[0] else order[1]
        yield s, k, slot, release, deadline
        if k < blocks[s]:
            heapq.heappush(waiting, (k * total // shares[s], -(-(k + 1) * total // shares[s]), order, k + 1))
        slot += 1


def pfair_frame(shares: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """``(source, k, slot, release, deadline)`` of each block in one frame of ``sum(shares)`` slots, by earliest deadline."""
    return list(schedule(shares, shares))


def _scheduled(shares: dict[str | None, int], blocks: dict[str | None, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_source", "_block", "_slot", "_release", "_deadline"]
        for _ in range(sum(batch.num_rows for batch in batches)):
            todo = schedule(shares, blocks)
            while part := list(itertools.islice(todo, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(zip(*part, strict=True))], names=names)

    return run


def _slots(table: DataFrame, sizes: DataFrame, block_rows: int) -> DataFrame:
    """``_source, _bucket, _before, _first, _slots``: per bucket its offset, its first block and what is scheduled for its blocks."""
    last = F.expr(f"(_before + _n - 1) div {block_rows} + 1")
    span = sizes.withColumn("_first", F.expr(f"_before div {block_rows} + 1")).withColumn("_block", F.explode(F.sequence("_first", last)))
    plan = table.select(F.col("_source").alias("_of"), F.col("_block").alias("_nth"), F.struct("_block", "_slot", "_release", "_deadline").alias("_run"))
    met = span.join(plan, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_nth")))
    return met.groupBy("_source", "_bucket", "_before", "_first").agg(F.array_sort(F.collect_list("_run")).alias("_slots"))


def mix(docs: DataFrame, *, weights: dict[str | None, float] | None = None, block_rows: int | None = None, frame: int | None = None, temperature: float = TEMPERATURE, seed: int = 41) -> DataFrame:
    """Add ``block`` (its number in the source, from 1), ``release``, ``deadline`` and ``slot`` to rows with ``doc_id`` and ``source``.

    Sorted by ``slot, place`` (``place``: within the block), rows are mixed to ``weights`` (any positive numbers by source;
    all sources must be named) or, without them, to row counts to the power ``temperature``. A null source is a source. With
    ``frame``, weights are first rounded to whole multiples of ``1 / frame`` (:func:`whole_weights`); by default they are exact.
    Without ``block_rows``, a block has ``BLOCK_ROWS`` rows, or so many more that there are ``MOST_BLOCKS`` blocks.
    Null ids and repeated rows keep places of their own; equal rows are interchangeable. An empty table stays empty.
    ``docs`` is read several times: pass a table. Columns of the names added are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("block", "release", "deadline", "slot", "place")
    counts = {r[0]: r[1] for r in docs.groupBy("source").count().collect()}  # one row a source
    if not counts:
        return docs.selectExpr("*", "0L block", "0L release", "0L deadline", "0L slot", "0L place")
    if weights is not None and (set(counts) - set(weights) or min(weights.values()) <= 0):
        raise ValueError("every source needs a positive weight")
    total = sum(counts.values())
    block_rows = block_rows or max(BLOCK_ROWS, -(-total // MOST_BLOCKS))
    wanted = {s: weights[s] if weights is not None else n**temperature for s, n in counts.items()}
    shares = exact_weights(wanted) if frame is None else whole_weights(wanted, frame)
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    table = materialize(spark.range(0, 1, 1, 1).mapInArrow(_scheduled(shares, blocks), SCHEDULE))

    buckets = spark.createDataFrame([(s, -(-n // BUCKET_ROWS)) for s, n in counts.items()], "_source string, _buckets long")
    near = spread("doc_id", *(c for c in ("text",) if c in docs.columns), seed=seed)
    cut = F.shiftright(F.col("_near") * F.col("_buckets"), 31)
    named = docs.select("doc_id", near.alias("_near"), F.col("source").alias("_from"), F.struct("*").alias("_row"))
    named = named.join(F.broadcast(buckets), F.col("_from").eqNullSafe(F.col("_source")))  # one row a source
    named = named.select("doc_id", "_near", "_source", cut.alias("_bucket"), "_row")
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = named.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    plan = materialize(_slots(table, sizes, block_rows)).select(F.col("_source").alias("_of"), F.col("_bucket").alias("_part"), "_before", "_first", "_slots")

    inside = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_near", "doc_id")) - 1
    same = F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_part"))
    ranked = named.withColumn("_inside", inside).join(plan, same).withColumn("_rank", F.col("_before") + F.col("_inside"))
    ranked = ranked.withColumn("block", F.expr(f"_rank div {block_rows} + 1"))
    run = F.get("_slots", (F.col("block") - F.col("_first")).cast("int"))
    return ranked.select("_row.*", "block", *[run[f"_{c}"].alias(c) for c in ("release", "deadline", "slot")], (F.col("_rank") % block_rows).alias("place"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = materialize(documents(spark, sf_dir).select("doc_id", "source"))
    return mix(slim).select("doc_id", "source", "block", "release", "deadline", "slot", "place")
