"""Uniform sharding with exact shard sizes, by a hypergeometric communication matrix.

Rows lie in blocks (a hash of their id). From the block counts alone, a matrix is drawn that says how many rows each
block sends to each shard: row by row it is a multivariate hypergeometric draw from what the shards still have room for,
so every shard gets its exact size and all assignments are equally likely. Inside a block a random permutation deals the
rows out according to the matrix row; inside a shard a second one gives each row its slot. The matrix has
``blocks x shards`` cells, bounded by rows / ``ROWS_A_BLOCK``; everything that touches rows is a DataFrame expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, materialize, rank_in_group, spread

ROWS_A_BLOCK, LEAST_BLOCKS = 1_000_000, 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items taken without replacement from ``good + bad`` are good; exact at any size.

    Inverts the distribution over its mode +- 14 standard deviations; what lies outside has less weight than a float can tell.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    sd = math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1))
    a, b = max(low, mode - int(14 * sd) - 20), min(high, mode + int(14 * sd) + 20)
    k = np.arange(a, b, dtype=float)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows each block sends to each shard; row sums are ``block_rows``, column sums ``shard_rows``."""
    rng, room, out = np.random.default_rng(seed), list(shard_rows), []
    for n in block_rows:
        left, rest, row = n, sum(room), []
        for s, r in enumerate(room):
            rest -= r
            take = hypergeometric(rng, r, rest, left) if left else 0
            row.append(take)
            room[s] -= take
            left -= take
        out.append(row)
    return out


def shard(rows: DataFrame, *, key: list[str], shards: int = 40, seed: int = 17, tie: list[str] | None = None) -> DataFrame:
    """Add ``shard`` (0 to ``shards - 1``, row counts at most one apart) and ``slot`` (a gapless place in the shard).

    ``key`` names the columns whose hash drives both permutations, ``tie`` further ones that tell equal keys apart; rows
    equal in all of them are interchangeable. Null keys are one more value. An empty table stays empty. All columns
    are carried (columns named like the two that are added are replaced) and the rows are written twice on the way.
    """
    spark, tie = rows.sparkSession, tie or []
    carried = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]).alias("_row")
    named = rows.select(*key, *tie, spread(*key, *tie, seed=seed).alias("_near"), spread(*key, *tie, seed=seed + 1).alias("_far"), carried)
    held = materialize(named)
    total = held.count()
    blocks = max(LEAST_BLOCKS, -(-total // ROWS_A_BLOCK))
    held = held.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 2), *key, *tie), F.lit(blocks)).cast("int"))
    counts = dict(held.groupBy("_block").count().collect())  # one number a block
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], sizes, seed)
    bounds = spark.createDataFrame([(b, np.cumsum(row).tolist()) for b, row in enumerate(matrix)], "_b int, _bounds array<bigint>")
    dealt = rank_in_group(held, ["_block"], ["_near", *key, *tie], "_rank", total=total)
    dealt = dealt.join(bounds, F.col("_block") == F.col("_b"))
    dealt = dealt.withColumn("shard", F.size(F.filter("_bounds", lambda x: x <= F.col("_rank"))).cast("int"))
    sent = materialize(dealt.drop("_block", "_b", "_bounds", "_rank", "_near"))
    return rank_in_group(sent, ["shard"], ["_far", *key, *tie], "slot", total=total).select("_row.*", "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    narrow = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard(narrow, key=["doc_id"], tie=["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
