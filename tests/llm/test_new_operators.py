"""The filter audit, the bit-sliced search and the bounded clustering against brute force."""

import hashlib
import math
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bit_sliced, elkan, filter_audit


def audit_docs(spark):
    long_clean = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, long_clean, "a"), (2, long_clean, "b"), (2, long_clean, "b"), (None, long_clean, "a"), (3, None, None), (4, "", "a"), (4, "", ""), (5, "x $ y", "a"),
        (6, "WORD " * 80, "a"), (7, "é" * 30 + " AB", None), (7, long_clean + " %", "b"), (8, "w x " * 70, "a"), (9, "very long word " * 40_000, "b"), (10, "very long word " * 40_000, "b"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, mask string")


def brute_masks(rows):
    least = {}
    for r in rows:
        if r.doc_id is not None:
            t = r.text or ""
            least[t] = min(least.get(t, r.doc_id), r.doc_id)
    out = []
    for r in rows:
        t = r.text or ""
        words = [w for w in __import__("re").split("[ \t\n\r\x0b\x0c]+", t) if w]
        mask = (len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)) + 8 * any(c in "#$%&*|" for c in t)
        out.append((r.doc_id, r.source or "", mask + 16 * (r.doc_id is not None and r.doc_id > least[t])))
    return out


@pytest.mark.parametrize("key", [filter_audit.fingerprint, lambda text: 7])
def test_verdicts(spark, key):
    docs = audit_docs(spark)
    want = Counter(brute_masks(docs.collect()))
    for chunk in (filter_audit.CHUNK_BYTES, 1):
        got = Counter()
        for r in filter_audit.verdicts(docs.repartition(3), key=key, chunk_bytes=chunk).collect():
            got[r.doc_id, r.part, r["mask"]] += r.n
        assert got == want
    assert Counter(r.doc_id for r in filter_audit.repeated_ids(docs).collect()) == Counter(i for i, _, m in brute_masks(docs.collect()) if m & 16)


def test_audit(spark):
    docs = audit_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (5, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(docs, labels).collect()}
    masks = brute_masks(docs.collect())
    good, toxic = {1, 2}, {1, 5}
    assert len(rows) == 600 * len({p for _, p, _ in masks})
    for part in {p for _, p, _ in masks}:
        own = [(i, m) for i, p, m in masks if p == part]
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                out = [(i, m) for i, m in alive if m & bit]
                gone = [x for x in own if x not in alive]
                removed_by[letter] += len(out)
                alive = [(i, m) for i, m in alive if not m & bit]
                r = rows[part, order, step]
                earlier = sum(1 for _, m in own if m & bit) - len(out)
                assert (r.kept, r.removed, r.redundant, r.unique_fails) == (len(alive), len(out), earlier, sum(m == bit for _, m in own)), (part, order, step, gone)
                assert (r.good_lost, r.toxic_lost) == (sum(i in good for i, _ in out), sum(i in toxic for i, _ in out))
        assert all(rows[part, order, step].shapley == removed_by[order[step - 1]] for order in ("ABCDE", "EDCBA", "CABED") for step in range(1, 6))
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_hot_text(spark):
    """A text that most rows have reaches its partition once a chunk, not once a row."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("same").alias("text"), F.lit("s").alias("source")).repartition(4)
    rows = docs.select("doc_id", F.col("text").cast("binary"), F.lit("s")).rdd.mapPartitions(lambda x: filter_audit._routed(x, filter_audit.fingerprint, 8, 1 << 25))
    entries = rows.filter(lambda x: len(x[1]) == 5 and x[1][1] == b"same").count()
    assert entries <= 4
    assert filter_audit.repeated_ids(docs).count() == 20_000 - 6_667 - 1


def brute_best(rows, every, k):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, q in usable:
        if i is None or i % every:
            continue
        near = sorted(((sum(a * b for a, b in zip(q, c, strict=False)), o) for o, c in usable if o != i), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out.update((i, rank, o, s) for rank, (s, o) in enumerate(near, 1))
    return out


def odd_vectors(rng, n, dims):
    rows = [(i, rng.normal(0, 0.2, dims).round(2).tolist()) for i in range(n)]
    for i in range(n // 3):  # a vector that a third of all rows have
        rows[i * 3 % n] = (rows[i * 3 % n][0], [0.25] * dims)
    rows += [(None, [0.25] * dims), (100, [0.25] * dims), (100, [0.5] * dims), (7000, None), (7050, [None] * dims), (7100, [float("nan")] * dims), (7150, [float("inf")] * dims)]
    return [*rows, (7200, []), (7250, [1.0, -1.0]), (7300, [-3.0] * (dims + 2)), (7350, [1000.0] * dims), (7400, [0.0] * dims)]


@pytest.mark.parametrize("layout", [bit_sliced.Layout(), bit_sliced.Layout(40, 2, 3, 5, 2), bit_sliced.Layout(40, 1, 2, 100, 20)])
def test_search(spark, layout):
    rows = odd_vectors(np.random.default_rng(5), 300, 6)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, piece string").repartition(3)
    got = bit_sliced.search(table, F.col("vec_id") % 50 == 0, layout=layout)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_best(rows, 50, 5)


def test_search_small(spark):
    few = spark.createDataFrame([(50, [1.0, 2.0]), (51, [1.0, 0.0]), (52, [1.0, 0.0])], "vec_id long, embedding array<float>")
    asked = F.col("vec_id") % 50 == 0
    assert [tuple(r) for r in bit_sliced.search(few, asked).orderBy("rank").collect()] == [(50, 1, 51, 65536), (50, 2, 52, 65536)]
    assert bit_sliced.search(few.limit(0), asked).count() == 0
    assert bit_sliced.search(few.filter("vec_id = 50"), asked).count() == 0


def test_boundary_is_narrow():
    """The coarse score leaves a part of the rows to be compared exactly, and never drops one of the best."""
    rng = np.random.default_rng(1)
    values = (rng.normal(0, 32, (5000, 64))).astype(np.int64)
    above = (values - values.min(0)).astype(np.uint64)
    bits = int(above.max()).bit_length()
    slices = np.stack([bit_sliced._bitmaps(above.T >> np.uint64(b) & np.uint64(1)) for b in range(bits)], 1)
    block = bit_sliced.Block({"n": 5000, "dims": 64, "bits": bits, "ids": np.arange(5000).tobytes(), "known": np.ones(5000, bool).tobytes(), "least": values.min(0).tobytes(), "slices": slices.tobytes()}, 6)
    assert (block.values == values).all()
    for i in range(20):
        own = np.arange(5000) == i
        at = block.boundary(values[i], own, 5, None)
        exact = values @ values[i]
        exact[i] = -(1 << 62)
        assert set(np.argsort(-exact, kind="stable")[:5]) <= set(at.tolist()) and len(at) < 1000


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in key[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(now)) for _, v in kept]
        if turn < rounds:
            for j in range(len(now)):
                own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
                if own:
                    now[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, near, strict=True))


def test_clusters(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.1, (12, 64))
    rows = [(i, (base[i % 12] + rng.normal(0, 0.05, 64)).round(2).tolist()) for i in range(240)]
    rows += [(i, [0.125] * 64) for i in range(300, 400)]  # repeated vectors
    rows += [(400 + i, [(-1) ** (i + j) * 0.0625 for j in range(64)]) for i in range(40)]  # ties
    rows += [(None, [0.5] * 64), (5, [0.5] * 64), (5, [0.5] * 64), (900, None), (901, [0.1] * 63), (902, [0.1] * 65), (903, [None] * 64), (904, [float("nan")] * 64), (905, [float("-inf")] * 64)]
    table = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(5)
    computed = []
    got = elkan.cluster(table, computed=computed)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows)
    usable = sum(brute_clusters(rows).values())
    assert len(computed) == 11 and computed[-1] < 0.6 * usable * 8


def test_clusters_small(spark):
    schema = "vec_id long, embedding array<double>"
    two = [(1, [1.0] * 64), (2, [-1.0] * 64), (None, [0.9] * 64)]
    assert Counter(map(tuple, elkan.cluster(spark.createDataFrame(two, schema)).collect())) == brute_clusters(two)
    one = [(1, [1.0] * 64)] * 3
    assert Counter(map(tuple, elkan.cluster(spark.createDataFrame(one, schema)).collect())) == brute_clusters(one)
    assert elkan.cluster(spark.createDataFrame([], schema)).count() == 0
    assert elkan.cluster(spark.createDataFrame([(None, [1.0] * 64)], schema)).count() == 0
    with pytest.raises(Exception, match="component is beyond"):
        elkan.cluster(spark.createDataFrame([(1, [1e9] * 64)], schema))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(8)
    v = rng.integers(-40, 40, (2000, 64))
    now, before = v[:8].tolist(), None
    cluster, upper, lower = np.full(2000, -1), np.zeros(2000), np.zeros((2000, 8))
    for turn in range(6):
        g = elkan.Geometry(now, before)
        cluster, upper, lower, computed = elkan.assign(v, cluster, upper, lower, g)
        exact = np.stack([elkan.squared(v, c) for c in g.now], 1)
        assert (cluster == exact.argmin(1)).all()
        assert (upper**2 >= exact[np.arange(2000), cluster]).all() and (lower**2 <= exact).all()
        assert computed <= 2000 * 8
        before, now = now, [(v[cluster == c].sum(0) // max(1, (cluster == c).sum())).tolist() for c in range(8)]
        if turn == 4:
            now = before  # nothing moves: nothing but ties is computed
    assert computed < 2000
