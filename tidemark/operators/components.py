"""Connected components by randomised contraction.

Each round every vertex points at the neighbour (or itself) with the least hash of that round, edges are relabelled and
loops and repeats go. The vertex count falls by a constant factor a round in expectation, whatever the graph, so long
paths and stars alike need a logarithmic number of rounds. Each round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release


ROWS_A_TASK = 100_000


def _tasks(rows: int) -> int:
    """Tasks for the last step over so many rows: the table shrinks from round to round, and so does the number of files."""
    return max(2, -(-rows // ROWS_A_TASK))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, component`` for every vertex of ``edges``; the component is its least vertex. Vertices may be of any
    orderable type. Null ends are ignored; loops and repeated edges do no harm; no edges give no rows.
    """
    pairs = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    vertices = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    label = vertices.withColumn("root", F.col("id"))
    live = pairs.filter("a <> b")
    edges_left, rounds = live.count(), 0
    label_tasks = _tasks(2 * edges_left)
    while edges_left:
        rounds += 1
        before = live, label
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.union(both.select("a", F.col("a").alias("b")))
        hash_of = F.xxhash64(F.lit(rounds), F.col("b"))
        up = materialize(both.groupBy("a").agg(F.min_by("b", F.struct(hash_of, F.col("b"))).alias("up")).coalesce(_tasks(2 * edges_left)))
        left, right = up.select(F.col("a").alias("_a"), F.col("up").alias("_ua")), up.select(F.col("a").alias("_b"), F.col("up").alias("_ub"))
        live = live.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
        live = live.filter("_ua <> _ub").select(F.least("_ua", "_ub").alias("a"), F.greatest("_ua", "_ub").alias("b"))
        live = materialize(live.distinct().coalesce(_tasks(edges_left)))
        label = materialize(label.join(left, F.col("root") == F.col("_a"), "left").select("id", F.coalesce("_ua", "root").alias("root")).coalesce(label_tasks))
        release(up, *before)
        edges_left = live.count()
    least = label.groupBy("root").agg(F.min("id").alias("component"))
    return label.join(least, "root").select("id", "component")
