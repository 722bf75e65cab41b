"""Centroid clustering in exact integers, with the bounds of Elkan's algorithm.

Vectors are quantised to integers and stay packed in a table, with what is known of each: its centroid, an upper bound of the
distance to it, and a lower bound for each centroid. A round is one ``mapInArrow`` over that table with the few centroids as
a closure. It moves the bounds by the way the centroids went, and computes a distance only where bounds and the distances between
centroids don't exclude it. Its last row a task carries the sums of its clusters, so the next centroids need only that column.

Bounds are doubles rounded outward (uppers up, lowers down), and a centroid is skipped only if it is strictly farther by them; a
tie is therefore always computed, in integers. Distances that are told are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bit_sliced import quantised
from .shared import materialize, release

SCALE, DIMS, CLUSTERS, ROUNDS = 1024, 64, 8, 10

#: Components beyond this magnitude aren't taken: squares and their sums must fit a long.
MOST_COMPONENT = 1 << 27

#: A relative step outward that covers the rounding of a square root, a sum and a product of doubles.
_OUT = 1e-12

STATE = "vec_id bigint, v binary, cluster int, upper double, lower binary, computed bigint, sums array<bigint>"


def up(x):
    return x * (1 + _OUT)


def down(x):
    return x * (1 - _OUT)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``a`` from ``b`` (a row, or as many)."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Geometry:
    """Centroids, lower bounds of half the distances between them, and upper bounds of how far each has moved."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None) -> None:
        self.now = np.array(now, np.int64)
        k = len(now)
        self.half = np.stack([down(np.sqrt(squared(self.now, c).astype(float)) / 2) for c in self.now])
        others = self.half + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.nearest = others.min(1)  # infinite where there is one centroid alone
        self.moved = up(np.sqrt(squared(self.now, np.array(before, np.int64)).astype(float))) if before else np.zeros(k)


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids (ties: the smaller number), new bounds, and how many distances were computed.

    ``cluster`` is -1 for vectors that were never assigned; ``lower`` is changed in place.
    """
    fresh = cluster < 0
    cluster = np.where(fresh, 0, cluster)
    upper = np.where(fresh, np.inf, up(upper + g.moved[cluster]))
    np.maximum(down(lower - g.moved), 0, out=lower)
    exact = np.full(len(v), -1, np.int64)  # the squared distance to ``cluster``, once computed
    computed = 0

    def measure(rows: np.ndarray, c) -> np.ndarray:
        nonlocal computed
        computed += len(rows)
        return squared(v[rows], g.now[c])

    asks = np.flatnonzero(upper >= g.nearest[cluster])
    for c in range(len(g.now)):
        rows = asks[(cluster[asks] != c) & (upper[asks] >= lower[asks, c]) & (upper[asks] >= g.half[cluster[asks], c])]
        stale = rows[exact[rows] < 0]
        if len(stale):
            exact[stale] = measure(stale, cluster[stale])
            upper[stale] = up(np.sqrt(exact[stale].astype(float)))
            lower[stale, cluster[stale]] = down(np.sqrt(exact[stale].astype(float)))
            rows = rows[(upper[rows] >= lower[rows, c]) & (upper[rows] >= g.half[cluster[rows], c])]
        if not len(rows):
            continue
        found = measure(rows, np.full(len(rows), c))
        lower[rows, c] = down(np.sqrt(found.astype(float)))
        closer = (found < exact[rows]) | ((found == exact[rows]) & (c < cluster[rows]))
        rows, found = rows[closer], found[closer]
        cluster[rows], exact[rows], upper[rows] = c, found, up(np.sqrt(found.astype(float)))
    return cluster, upper, lower, computed


def _fixed(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column of equally long values as an array."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype, count=(offsets[-1] - offsets[0]) // np.dtype(dtype).itemsize, offset=int(offsets[0])).reshape(len(column), width)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of an array as a binary column."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(x)])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("c").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), DIMS)
        if len(batch) and max(int(values.max()), -int(values.min())) > MOST_COMPONENT:
            raise ValueError(f"a component is beyond {MOST_COMPONENT} units: its squared distance may not fit a long")
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _binary(values.astype(np.int32))], names=["vec_id", "v"])


def _round(g: Geometry):
    k = len(g.now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, computed = np.zeros((k, DIMS + 1), np.int64), 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            raw = batch.column("v")
            v = _fixed(raw, np.int32, DIMS).astype(np.int64)
            lower = _fixed(batch.column("lower"), float, k).copy()
            cluster, upper, lower, did = assign(v, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), lower, g)
            computed += did
            for c in range(k):
                own = v[cluster == c]
                sums[c, 0] += len(own)
                sums[c, 1:] += own.sum(0)
            nothing = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), raw, pa.array(cluster, pa.int32()), pa.array(upper), _binary(lower), pa.nulls(n, pa.int64()), nothing], names=["vec_id", "v", "cluster", "upper", "lower", "computed", "sums"])
        last = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*last, pa.array([computed]), pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names=["vec_id", "v", "cluster", "upper", "lower", "computed", "sums"])

    return run


def _distances(centroids: list[list[int]]):
    now = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cluster = batch.column("cluster")
                d = squared(_fixed(batch.column("v"), np.int32, DIMS).astype(np.int64), now[cluster.to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cluster, pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def seeds(kept: DataFrame, k: int, salt: int = 3) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``salt:vec_id``, in that order; equal ids by their vectors, rows without id never."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.c) for r in kept.filter("vec_id IS NOT NULL").orderBy(order, "c").limit(k).select("c").collect()]


def cluster(vectors: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, computed: list[int] | None = None) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of exactly 64 finite components.

    ``vectors`` needs ``vec_id, embedding``; further columns aren't read. Other vectors (null, of another length, with null or
    non-finite components) are left out. Repeated rows and rows without id are vectors like any; the latter are no seeds, and with
    fewer than ``k`` vectors that have an id there are so many centroids. With none (or an empty table) the result is
    empty. An empty cluster keeps its centroid. Components of more than 2^27 units raise a ValueError. ``computed`` gets the number of
    distances computed in each round.
    """
    spark = vectors.sparkSession
    kept = quantised(vectors.filter(F.size("embedding") == DIMS), scale)
    now, before = seeds(kept, k), None
    if not now:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    unknown = F.unhex(F.lit("00" * 8 * len(now)))
    state = materialize(kept.mapInArrow(_packed, "vec_id bigint, v binary").select("*", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), unknown.alias("lower")))
    for turn in range(rounds + 1):
        rows = state.filter("v IS NOT NULL").select("vec_id", "v", "cluster", "upper", "lower")
        after = materialize(rows.mapInArrow(_round(Geometry(now, before)), STATE))
        release(state)
        state = after
        told = state.filter("sums IS NOT NULL")
        if computed is not None:
            computed.append(told.agg(F.sum("computed")).first()[0])
        if turn < rounds:
            # a row a task; len(now) * (DIMS + 1) numbers come back
            sums = dict(told.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect())
            table = [[sums[c * (DIMS + 1) + i] for i in range(DIMS + 1)] for c in range(len(now))]
            before, now = now, [[x // n for x in own] if n else old for (n, *own), old in zip(table, now, strict=True)]
    out = state.filter("v IS NOT NULL").select("vec_id", "v", "cluster").mapInArrow(_distances(now), "vec_id bigint, cluster int, distance bigint")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    inertia = out.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()  # a row a centroid
    named = spark.createDataFrame([(c, x, sum(r.x for r in inertia), digests[c]) for c, x in inertia], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Plain Lloyd rounds, unrolled: ``a<i>`` assigns every vector to the centroids ``c<i>``, ``c<i+1>`` are their means."""
    steps = [
        "WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster, c FROM (SELECT c, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT 8))",
    ]
    for i in range(ROUNDS + 1):
        far = "list_sum(list_transform(range(1, 65), lambda i: (v.c[i] - k.c[i]) * (v.c[i] - k.c[i])))::BIGINT"
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v.c, cluster, {far} AS distance FROM v, c{i} k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)")
        if i < ROUNDS:
            mean = f"SELECT cluster, dim, floor_div AS x FROM (SELECT cluster, dim, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM (SELECT cluster, unnest(c) AS x, unnest(range(1, 65)) AS dim FROM a{i}) GROUP BY cluster, dim)"
            steps.append(f"m{i} AS MATERIALIZED (SELECT cluster, list(x::BIGINT ORDER BY dim) AS c FROM ({mean}) GROUP BY cluster)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))")
    last = f"""SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(k.c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} k USING (cluster)"""
    return ", ".join(steps) + " " + last


OP13_SQL = _sql()
