"""Building blocks of several operators: skew-safe ranks, block sums, and durable tables from ``tidemark.storage``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize, release, shared_dir


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(*cols: Column | str, seed: int) -> Column:
    """A pseudo-random 31-bit number from the columns; equal rows get equal numbers."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(0x7FFFFFFF)).cast("long")


def rank_in_group(df: DataFrame, group: list[str], order: list[str], out: str, total: int | None = None, rows_a_bucket: int = 100_000) -> DataFrame:
    """Add ``out``: the gapless 0-based rank of each row in its group, in ascending order of ``order[0]``, then the rest.

    ``order[0]`` is a 31-bit :func:`spread` number. Its range is cut into buckets, so that a group of any size is
    ranked by many tasks: rows are counted by (group, bucket), counts become offsets, and only the rows of one bucket
    are sorted together. Rows equal in every column of ``order`` share a bucket and take neighbouring ranks.
    ``df`` is read twice: pass a table that is cheap to read.
    """
    n = total if total is not None else df.count()
    buckets = max(8, -(-n // rows_a_bucket))
    cut = F.shiftright(F.col(order[0]) * F.lit(buckets), 31).cast("int")
    keyed = df.withColumn("_bucket", cut)
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    ranked = keyed.withColumn("_inside", F.row_number().over(inside) - 1)
    return ranked.join(counts, same).withColumn(out, F.col("_before") + F.col("_inside")).drop("_bucket", "_b", "_before", "_inside", *[f"_g{i}" for i in range(len(group))])


#: A key is hot if it has more than one in so many of all rows: there are fewer hot keys than that in any table.
HOT_KEYS = 10_000


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row a key). The few hot keys are broadcast, so none fills a task; the rest is dealt by key.

    Both are read several times: pass tables.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > max(1, rows.count() // HOT_KEYS)).select(key)
    hot = materialize(table.join(hot, key, "left_semi"))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(table, key))


def sum_blocks(parts: DataFrame, dtype: str, blocks: int = 64, into: str | None = None) -> DataFrame:
    """Sum equally long arrays by ``block`` (``blocks`` of them); ``parts`` has ``block int, data binary``. One running sum a block is in memory.

    A task that fills ``parts`` sends each block once at most and needn't send those without a count; sums are kept as ``into`` (``dtype`` unless told).
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(data, dtype)
                if block in sums:
                    sums[block] += x
                else:
                    sums[block] = x.astype(into or dtype)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])

    n = min(blocks, partitions(parts.sparkSession))
    return parts.repartition(n, "block").mapInArrow(run, "block int, data binary")


def collect_blocks(sums: DataFrame, dtype: str, blocks: int, width: int) -> np.ndarray:
    """The summed blocks as one array of fixed size ``blocks * width``."""
    out = np.zeros((blocks, width), dtype)
    for row in sums.collect():
        out[row.block] = np.frombuffer(row.data, dtype)
    return out.ravel()


__all__ = ["HOT_KEYS", "collect_blocks", "documents", "lookup", "materialize", "partitions", "rank_in_group", "release", "shared_dir", "spread", "sum_blocks"]
