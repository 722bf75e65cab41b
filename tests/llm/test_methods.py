"""The dealt methods against plain versions of themselves, and the stages of the pipeline on odd rows."""

import heapq
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import best_fit, exact_dedup, jaccard_join, mixing, quality_classifier
from tidemark.llm.shared import lookup
from tidemark.llm.textops import Chunk, Hasher

SF = "/root/testdata/sf0.001"


def best_fit_decreasing(lengths, capacity):
    """Number of sequences by plain sequential best fit, the longest first."""
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            opened += 1
            gaps.append(capacity - n)
    return opened


@pytest.mark.parametrize("seed,size,high", [(1, 300, 100), (2, 400, 40), (3, 150, 60), (4, 500, 3), (5, 1, 100)])
def test_packing_against_sequential_best_fit(spark, seed, size, high):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(1, high + 1, size)]
    rows = spark.createDataFrame([(i if i % 9 else None, 0, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, offset string")
    plain = best_fit_decreasing(lengths, 100)
    for rows_a_task in (10**9, 60):
        out = best_fit.pack(rows, capacity=100, rows_a_task=rows_a_task).collect()
        assert sorted(r.length for r in out) == sorted(lengths)
        sequences = defaultdict(list)
        for r in out:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 100
        assert len(sequences) == plain if rows_a_task == 10**9 else len(sequences) <= plain * 1.12 + 2


def test_one_length_for_a_third_of_all_pieces(spark):
    rows = spark.range(900).selectExpr("id AS doc_id", "0 AS piece", "CASE WHEN id % 3 = 0 THEN 64 ELSE 1 + id % 100 END AS length")
    out = best_fit.pack(rows, capacity=100, rows_a_task=50)
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    plain = best_fit_decreasing([r.length for r in rows.collect()], 100)
    assert max(r.n for r in used) <= 100 and plain <= len(used) <= plain * 1.1


def test_schedule_against_slot_by_slot():
    """Earliest deadline first, told slot by slot with fractions."""
    rng = np.random.default_rng(3)
    for n in (1, 3, 8):
        shares = {f"s{i}": int(x) for i, x in enumerate(rng.integers(1, 60, n))}
        blocks = {s: int(rng.integers(1, 40)) for s in shares}
        total, done, want = sum(shares.values()), dict.fromkeys(shares, 0), []
        slot = 0
        while any(done[s] < blocks[s] for s in shares):
            open_ = [(-(-(done[s] + 1) * total // shares[s]), s) for s in shares if done[s] < blocks[s] and done[s] * total // shares[s] <= slot]
            if open_:
                s = heapq.nsmallest(1, open_)[0][1]
                done[s] += 1
                want.append((s, done[s], slot))
            slot += 1
        assert [x[:3] for x in mixing.schedule(shares, blocks)] == want


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 64)
    docs = spark.range(1000).selectExpr("id AS doc_id", "if(id % 4 = 0, 'a', 'b') AS source", "'x' AS _row", "0 AS _near")
    rows = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1000)) and all(r._row == "x" for r in rows)
    sizes = defaultdict(set)
    for r in rows:
        sizes[r.source, r.block].add(r.place)
    assert all(v == set(range(len(v))) and len(v) <= 20 for v in sizes.values()) and len(sizes) <= 52


def test_forward_pass_against_plain_numpy():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
    net = quality_classifier.Network().fit(x, y)
    hidden = [[max(0.0, sum((row[i] - net.mean[i]) / net.scale[i] * net.w[0][i, j] for i in range(6)) + net.w[1][j]) for j in range(net.w[1].size)] for row in x[:20]]
    plain = [1 / (1 + np.exp(-(sum(h * w for h, w in zip(hs, net.w[2], strict=True)) + net.w[3][0]) / net.temperature)) for hs in hidden]
    assert np.allclose(net.score(x[:20]), plain)
    assert ((net.score(x) > 0.5) == y).mean() > 0.85


def test_exact_dedup_of_hot_texts_keeps_the_row(spark):
    rows = [(i, "hot", {"k": str(i)}) for i in range(60)] + [(None, "hot", None), (100, None, {"k": "n"}), (99, "", {"k": "e"}), (7, "hot", {"k": "7"})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept map<string,string>")
    out = {r.text: (r.doc_id, r.kept) for r in exact_dedup.exact_dedup(docs, salts=3).collect()}
    assert out == {"hot": (59, {"k": "59"}), None: (100, {"k": "n"})}
    sizes = {r.group_size for r in exact_dedup.exact_groups(docs, salts=3).collect()}
    assert sizes == {62, 2}


def test_lookup_with_a_hot_key(spark):
    rows = spark.range(300).selectExpr("id", "if(id < 200, 0, id) AS key")
    table = spark.range(0, 290).selectExpr("id AS key", "id * 2 AS twice")
    assert sorted((r.id, r.twice) for r in lookup(rows, table, "key").collect()) == [(i, 0 if i < 200 else 2 * i) for i in range(290)]


def test_run_and_stages_on_odd_rows(spark):
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.count() > 0 and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(pieces.columns)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = docs.limit(1).withColumn("text", F.expr("repeat('a long text of words ', 20000)")).withColumn("doc_id", F.lit(-5).cast("long"))
    none = docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    odd = docs.unionByName(docs.limit(3)).unionByName(none).unionByName(long).unionByName(docs.limit(1).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(-6).cast("long")))
    odd = odd.selectExpr("*", "77 AS slot", "'x' AS score", "doc_id AS kept", "'y' AS _row", "1 AS uid_a", "'z' AS place", "2 AS block").cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all((r.slot, r.score, r._row, r.uid_a, r.place, r.block) == (77, "x", "y", 1, "z", 2) and r.kept == r.doc_id for r in rows), name
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert len(corpus_pipeline.mix_sources(spark, odd, SF).collect()) == odd.count()
    packed = corpus_pipeline.pack_sequences(spark, odd, SF)
    assert packed.filter("doc_id IS NULL").count() == 2 and packed.filter("doc_id = -5").count() > 1
    assert corpus_pipeline.pack_sequences(spark, odd.limit(0), SF).count() == 0
    assert jaccard_join.near_dedup(odd).count() <= odd.count()


def test_contexts_are_sums_of_neighbours_index_vectors(spark):
    """Contexts and pooled vectors of a small table against plain loops."""
    texts = ["The cat sat on the mat", "a cat", "", None, "alone", "THE cat 12 cats; sat on on on", "é ü cat the"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    held = quality_classifier.word_contexts(docs)
    words, shapes = Hasher(5), quality_classifier._Shapes()
    units = {}
    for text in texts:
        for word in (text or "").split():
            chunk = Chunk([word.encode()])
            units[word] = int(words.words(chunk)[0]), int(shapes(chunk)[0])

    def index(unit):
        out = np.zeros(quality_classifier.DIMS)
        for place, sign in quality_classifier._draws(np.array([unit], np.uint64)):
            out[place[0]] += sign[0]
        return out

    buckets = quality_classifier._word_bucket, quality_classifier._shape_bucket
    total = np.zeros((quality_classifier.BUCKETS, quality_classifier.DIMS))
    for text in texts:
        line = [units[w] for w in (text or "").split()]
        for i, unit in enumerate(line):
            for j in range(max(0, i - 2), min(len(line), i + 3)):
                for kind in (0, 1):
                    total[buckets[kind](np.array([unit[kind]], np.uint64))[0]] += index(line[j][kind]) * (i != j)
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.abs(held - want).max() < 1e-6 and np.linalg.norm(held, axis=1).max() < 1 + 1e-6
    pooled = quality_classifier._pooled(held, [(t or "").encode() for t in texts], words, shapes)
    size = quality_classifier.DIMS
    for row, text in zip(pooled, texts, strict=True):
        line = [units[w] for w in (text or "").split()]
        for kind in (0, 1):
            mean = np.mean([want[buckets[kind](np.array([u[kind]], np.uint64))[0]] for u in line], axis=0) if line else np.zeros(size)
            assert np.abs(row[kind * size : (kind + 1) * size] - mean).max() < 1e-5
        assert abs(row[-1] - np.log1p(len(line))) < 1e-6
        again = [sum(line[i][0] == line[i - far][0] for i in range(far, len(line))) / max(1, len(line)) for far in (1, 2)]
        assert np.abs(row[[-2, -3]] - again).max() < 1e-6


def test_word_contexts_tell_words_apart(spark):
    """Words that stand among different words have different contexts; those that stand among the same have like ones."""
    rng = np.random.default_rng(4)
    left, right = ([f"{c}{i}" for i in range(30)] for c in "lr")
    lines = [" ".join(rng.choice(side, 6).tolist() + [mid] + rng.choice(side, 6).tolist()) for side, mids in ((left, ("one", "two")), (right, ("three",))) for mid in mids for _ in range(200)]
    held = quality_classifier.word_contexts(spark.createDataFrame([(x,) for x in lines], "text string"))
    of = lambda w: held[quality_classifier._word_bucket(Hasher(5).words(Chunk([w.encode()])))[0]]
    assert of("one") @ of("two") > 0.8 and of("one") @ of("three") < 0.5


def test_sequences_follow_the_mixture(spark):
    """Documents of some 700 tokens open a sequence each: read by position, sequences have sources as they were mixed, and short ones fill them."""
    long = [(i, " ".join(f"w{i}x{j}" for j in range(120)), "rare" if i % 10 == 0 else "common") for i in range(200)]
    docs = spark.createDataFrame(long + [(1000 + i, "a few words", None) for i in range(50)], "doc_id long, text string, source string").repartition(5)
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    packed = corpus_pipeline.pack_sequences(spark, corpus_pipeline.materialize(mixed), SF).cache()
    place = {r.doc_id: i for i, r in enumerate(mixed.collect())}
    assert len(set(place.values())) == docs.count() == packed.select("doc_id").distinct().count()
    rows = packed.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    first = [r for r in rows if r.offset == 0]
    assert [place[r.doc_id] for r in first] == sorted(place[r.doc_id] for r in first) and {r.sequence_id: r.position for r in first} == {r.sequence_id: r.position for r in rows}
    order = [r.doc_id for r in first if r.doc_id < 1000]
    assert order == sorted(order, key=place.get) and order != sorted(order)
    source = {i: s for i, _, s in long}
    assert [source[i] for i in order[:40]].count("rare") > 6  # a tenth of the rows, a quarter by weight
