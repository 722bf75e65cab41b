"""Word, byte and set operators against brute force on small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, substring_dedup, suffix_dedup
from tidemark.llm.packed import with_uid
from tidemark.llm.textops import Chunk, Hasher, chunks, covered, ranges

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def noisy_texts(seed, n=40):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    base = [[vocab[j] for j in rng.integers(0, 300, rng.integers(30, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(base[rng.integers(6)])
        for _ in range(int(rng.integers(0, 5))):
            words[rng.integers(len(words))] = vocab[rng.integers(300)]
        cut = int(rng.integers(0, 20))
        rows.append((i, (" " if i % 3 else "\n\t").join(words[cut:])))
    return rows


ODD = [(100, None), (101, ""), (102, " \n\t "), (103, "x"), (104, "a b c"), (105, "A B C"), (106, "y " * 400), (None, "a b c d e"), (107, "  nbsp word"), (108, "same row twice " * 20), (108, "same row twice " * 20)]


def test_words_and_windows():
    texts = ["", "a  b\tc\x0bd", "\n", "é è x y", "one two three four five six"]
    chunk = Chunk([t.encode() for t in texts])
    assert chunk.n_words.tolist() == [len(WORD.findall(t)) for t in texts]
    hasher = Hasher(1)
    words = hasher.words(chunk)
    assert [texts[i].encode() for i in range(5)] == chunk.texts
    assert len(set(words.tolist())) == len({w for t in texts for w in WORD.findall(t)})
    for k in (1, 2, 3, 5):
        at = chunk.window_starts(k)
        assert len(at) == sum(max(0, len(WORD.findall(t)) - k + 1) for t in texts)
        values = hasher.windows(words, k)[at]
        names = [tuple(WORD.findall(t)[i : i + k]) for t in texts for i in range(len(WORD.findall(t)) - k + 1)]
        assert len(set(values.tolist())) == len(set(names))
    assert Hasher(1, lower=True).words(Chunk([b"AbC"]))[0] == Hasher(1, lower=True).words(Chunk([b"aBc"]))[0]
    assert ranges(np.array([3, 9]), np.array([2, 3])).tolist() == [3, 4, 9, 10, 11]
    assert covered(np.array([1, 2, 6]), 3, 8).tolist() == [False, True, True, True, True, False, True, True]


def test_chunks_keep_all_rows():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"i": list(range(b, b + 7)), "text": [None if i % 5 == 0 else "x" * (i * 13 % 90) for i in range(b, b + 7)]}) for b in range(0, 70, 7)]
    seen = [(i, t) for table, texts in chunks(iter(batches), size=100) for i, t in zip(table.column("i").to_pylist(), texts, strict=True)]
    assert seen == [(i, b"" if i % 5 == 0 else b"x" * (i * 13 % 90)) for i in range(70)]


def brute_words(rows, window):
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,window", [(1, 35), (2, 8)])
def test_repeated_words(spark, seed, window):
    rows = noisy_texts(seed) + ODD
    got = substring_dedup.repeated_words(frame(spark, rows), window=window)
    kept = got.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()
    assert sorted(((r[0], r[1], r[2], r[3]) for r in kept), key=repr) == brute_words(rows, window)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in kept)


def brute_bytes(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes(spark, seed):
    rows = noisy_texts(seed) + ODD + [(200, "z" * 1000), (201, "ab" * 300), (202, "q" * 199)]
    got = suffix_dedup.repeated_bytes(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_bytes(rows, 200)


def shingle_set(text, k):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(s), least.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("seed,k,percent", [(3, 4, 85), (4, 5, 80), (5, 2, 60)])
def test_near_duplicates(spark, seed, k, percent):
    rows = noisy_texts(seed, 60) + ODD
    members, links = jaccard_join.near_duplicates(frame(spark, rows), shingle=k, percent=percent)
    assert sorted(map(tuple, members.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute_components(rows, k, percent)
    texts = dict(r for r in rows if r[0] is not None)
    for a, b in {tuple(x) for x in links.collect()}:
        x, y = shingle_set(texts[a], k), shingle_set(texts[b], k)
        assert 100 * len(x & y) >= percent * len(x | y)


def test_near_dedup_keeps_columns_and_one_of_each(spark):
    rows = [(1, "a b c d e f", 1), (2, "A b c d e f", 2), (3, None, 3), (4, "", 4), (5, "other words altogether here now", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid_a long")
    out = jaccard_join.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(r for r in rows if r[0] != 2)


def test_exact_groups(spark):
    rows = noisy_texts(6) + ODD + [(300 + i, "hot") for i in range(50)] + [(301, "hot")]
    docs = frame(spark, rows).selectExpr("*", "'x' AS kept", "doc_id AS other")
    by = {}
    for doc, text in rows:
        by.setdefault(text or "", []).append(doc)
    for digest in (None, __import__("pyspark.sql.functions", fromlist=["x"]).length("_text")):  # a weak digest: contents decide
        got = exact_dedup.exact_groups(docs, salts=4, digest=digest).collect()
        assert len(got) == len(rows)
        for r in got:
            group = next(g for t, g in by.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and (r.doc_id in g))
            assert r.group_size == len(group) and r.keep_id == max((d for d in group if d is not None), default=None)
            assert r.other == r.doc_id
        assert sum(r.kept for r in got) == len(by)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns and out.count() == len(by)


def test_empty_tables(spark):
    docs = frame(spark, [], 1)
    assert substring_dedup.repeated_words(docs).count() == 0
    assert suffix_dedup.repeated_bytes(docs).count() == 0
    assert exact_dedup.exact_groups(docs).count() == 0
    members, links = jaccard_join.near_duplicates(docs)
    assert members.count() == 0 and links.count() == 0


def test_exact_dedup_of_rows_that_repeat(spark):
    """Equal rows without ids: dealt over salts, one of them is kept; names of the operator's own columns are free."""
    names = ("_null", "_rest", "_text", "_id", "_digest", "_salt", "_sha", "_best", "_row", "keep_salt")
    docs = spark.createDataFrame([(None, "copy", *names)] * 3000 + [(7, "copy", *names)] * 50 + [(None, None, *names), (1, "", *names), (2, "alone", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(12)
    dealt = exact_dedup._salted(exact_dedup._rows(docs, None), docs.count(), 32).filter("_text = 'copy'").groupBy("_salt").count().collect()
    assert len(dealt) >= 6 and max(r["count"] for r in dealt) < 3050 / 3
    groups = exact_dedup.exact_groups(docs)
    assert set(names) <= set(groups.columns) and groups.count() == 3053
    kept = sorted((r.doc_id, r.keep_id, r.group_size) for r in groups.filter("kept").collect())
    assert kept == [(1, 1, 2), (2, 2, 1), (7, 7, 3050)]
    nameless = exact_dedup.exact_groups(docs.filter("doc_id IS NULL AND text = 'copy'"))
    assert nameless.filter("kept").count() == 1 and nameless.filter("keep_id IS NULL").count() == 3000
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns and sorted((r.doc_id, r.text, r._null) for r in out.collect()) == [(1, "", "_null"), (2, "alone", "_null"), (7, "copy", "_null")]


def test_only_texts_of_pairs_are_moved(spark):
    texts = with_uid(frame(spark, [(i, f"text {i}") for i in range(6000)] + [(7, "text 7")] * 5, 5))
    some = texts.filter("doc_id % 100 = 7").select(F.struct("uid_a", "uid_b").alias("uid")).distinct()
    moved = jaccard_join._needed(texts, some)
    assert sorted(r.text for r in moved.join(some, "uid").collect()) == sorted(f"text {i}" for i in range(7, 6000, 100))
    assert moved.count() < 300 and moved.select("uid").distinct().count() == moved.count()
    assert jaccard_join._needed(texts, some.limit(0)).count() == 0
