"""The pair search by sorted neighbours and the pattern index against brute force."""

import datetime as dt
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence, geo, linking, neighbours, patterns

BASE = dt.datetime(2026, 10, 1)
SIG = "incident_id string, record_id string, reported_at timestamp, kind string, value string"


def brute_pairs(reports, pairs, days):
    found = defaultdict(list)
    for i, a in enumerate(reports):
        for b in reports[i + 1 :]:
            low, high = sorted((a, b))
            shared = len(low[3] & high[3])
            gap = None if low[2] is None or high[2] is None else abs(int((low[2] - high[2]).total_seconds()))
            if shared and low[1] != high[1] and (gap is None or gap <= days * 86400):
                link = "LNK-" + hashlib.sha256(f"{low[0]}|{high[0]}".encode()).hexdigest()[:16]
                row = (-shared, gap is None, gap or 0, link, low[0], high[0], gap)
                found[low[0]].append(row)
                found[high[0]].append(row)
    best = {r for own in found.values() for r in sorted(own)[:pairs]}
    return {(low, high, -shared, gap, link) for shared, _, _, link, low, high, gap in best}


def signals_of(spark, reports):
    rows = [(i, r, t, *s) for i, r, t, sigs in reports for s in sorted(sigs)]
    return spark.createDataFrame(rows, SIG).repartition(4)


@pytest.mark.parametrize(("seed", "undated", "per_record", "people"), [(1, 0.0, 1, 0), (2, 0.1, 2, 0), (3, 0.05, 9, 0), (4, 0.05, 1, 9)])
def test_nearest_pairs(spark, seed, undated, per_record, people):
    rng = random.Random(seed)
    reports = []
    for n in range(220):
        when = None if rng.random() < undated else BASE + dt.timedelta(days=rng.randrange(40), hours=rng.choice([0, 0, 0, 5]))
        sigs = {("category", "hot" if rng.random() < 0.6 else "cool"), ("type", f"t{rng.randrange(4)}")}
        if rng.random() < 0.7:
            sigs.add(("place", f"p{rng.randrange(9)}"))
        if rng.random() < 0.3:
            sigs.add(("person", f"n{rng.randrange(40)}"))
        if rng.random() < 0.1:
            sigs = set(sorted(sigs)[:1])
        if people and rng.random() < 0.2:  # more signals than are combined
            sigs |= {("person", f"n{rng.randrange(12)}") for _ in range(people)}
        reports.append((f"i{n:03}", f"r{n // per_record}", when, frozenset(sigs)))
    got = neighbours.nearest_pairs(signals_of(spark, reports), pairs=5, gap_days=7)
    assert got.columns == ["low_id", "high_id", "shared", "gap_seconds", "link_id"]
    assert set(map(tuple, got.collect())) == brute_pairs(reports, 5, 7)


def test_nearest_pairs_edges(spark):
    none = spark.createDataFrame([], SIG)
    assert neighbours.nearest_pairs(none, pairs=5, gap_days=7).count() == 0
    one = [("a", "r", BASE, frozenset({("type", "x")}))]
    assert neighbours.nearest_pairs(signals_of(spark, one), pairs=5, gap_days=7).count() == 0
    same_second = [(f"i{n:02}", f"r{n}", BASE, frozenset({("type", "x"), ("category", "y")})) for n in range(30)]
    edge = [("e1", "x1", BASE, frozenset({("place", "p")})), ("e2", "x2", BASE + dt.timedelta(days=7), frozenset({("place", "p")})), ("e3", "x3", BASE + dt.timedelta(days=7, seconds=1), frozenset({("place", "p")}))]
    for reports in (same_second, edge):
        assert set(map(tuple, neighbours.nearest_pairs(signals_of(spark, reports), pairs=5, gap_days=7).collect())) == brute_pairs(reports, 5, 7)


@pytest.mark.parametrize(("per_record", "dense", "hours"), [(1, False, 24), (3, False, 1), (1, True, 24), (40, False, 24)])
def test_cells_against_brute_force(spark, monkeypatch, per_record, dense, hours):
    """Dated reports are searched in cells by one shuffle; cells too dense for a task and large records are looked up by keys."""
    from tidemark.operators import cells

    rng = random.Random(per_record)
    reports = []
    for n in range(400):
        sigs = {("category", f"c{rng.randrange(2)}"), ("place", f"p{rng.randrange(3)}")} | ({("type", f"t{rng.randrange(3)}")} if rng.random() < 0.8 else set()) | ({("person", f"n{rng.randrange(60)}")} if rng.random() < 0.9 else set())
        day = rng.choice([0, 0, 1, 6, 7, 8]) + rng.randrange(0, 90, 9) if rng.random() < 0.8 else rng.randrange(400)
        reports.append((f"i{n:03}", f"r{n // per_record}" if n < 200 else f"s{n}", BASE + dt.timedelta(days=day, hours=rng.randrange(0, 24, hours)), frozenset(sigs)))
    looked, keyed = [], neighbours._by_combinations
    monkeypatch.setattr(neighbours, "_by_combinations", lambda base, asking, *a: looked.append(asking.count()) or keyed(base, asking, *a))
    monkeypatch.setattr(cells, "CELL_ROWS", 30)
    if dense:
        monkeypatch.setattr(cells, "MOST_ROWS", 60)
    got = list(map(tuple, neighbours.nearest_pairs(signals_of(spark, reports), pairs=5, gap_days=7).collect()))
    assert len(got) == len(set(got)) and set(got) == brute_pairs(reports, 5, 7)
    assert bool(looked) == (dense or per_record > cells.MOST_REPORTS) and all(0 < n < 400 for n in looked)


def test_pairs_looked_at_grow_with_reports(spark):
    """A signal that all share isn't paired with itself: what is compared stays near ``pairs`` a report where times differ."""
    made = []
    for n in (500, 2000):
        reports = [(f"i{k:05}", f"r{k}", BASE + dt.timedelta(seconds=k * 37 % 86400, days=k % 3), frozenset({("category", "hot")})) for k in range(n)]
        keyed = neighbours._keyed(neighbours.reports(signals_of(spark, reports)), 1, 1)
        made.append(neighbours._partners(keyed, keyed, 5, 7 * 86400, undated=False, crowded=False).count() / n)
    assert made[0] < 20 and made[1] < 1.3 * made[0]


def brute_spans(texts, quotes):
    return sorted((k, q, i, i + len(s)) for k, t in texts if t for q, s in quotes if s and s.strip() for i in range(len(t) - len(s) + 1) if t.startswith(s, i))


def test_patterns_against_brute_force(spark):
    rng = random.Random(4)
    letters = "ab தமிழ\n😀c"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 200)))) for i in range(60)] + [(100, None), (101, ""), (102, "a" * 300)]
    quotes = [(1000, "a"), (1001, "aa"), (1002, ""), (1003, None), (1004, "  "), (1005, "nowhere at all in these texts"), (1006, "a" * 40)]
    for i in range(200):
        t = rng.choice(texts[:60])[1]
        if t:
            at = rng.randrange(len(t))
            quotes.append((i, t[at : at + rng.randrange(1, 45)]))
    fields = spark.createDataFrame(texts, "field_id long, text string").repartition(3)
    held = spark.createDataFrame(quotes, "quote_id long, quote string").repartition(3)
    assert sorted(map(tuple, evidence.quote_spans(fields, held).collect())) == brute_spans(texts, quotes)


def test_patterns_without_hits(spark):
    fields = spark.createDataFrame([("x", "nothing here"), ("y", None)], "field_id string, text string")
    quotes = spark.createDataFrame([(1, "quote")], "quote_id long, quote string")
    assert evidence.quote_spans(fields, quotes).collect() == [] and evidence.unique_field(fields, quotes).collect() == []
    assert evidence.quote_spans(fields.limit(0), quotes).collect() == [] and evidence.quote_spans(fields, quotes.limit(0)).collect() == []


def test_full_filter_decides_nothing(spark, monkeypatch):
    """With every bit of the filter set, the join alone gives the same places."""
    fields = spark.createDataFrame([(1, "the quick brown fox jumps over the dog"), (2, "dog the")], "field_id long, text string")
    quotes = spark.createDataFrame([(1, "the"), (2, "quick brown fox jumps over"), (3, "dog")], "quote_id long, quote string")
    want = sorted(map(tuple, evidence.quote_spans(fields, quotes).collect()))
    words = patterns._filter
    monkeypatch.setattr(patterns, "_filter", lambda keyed: (words(keyed)[0] | ~words(keyed)[0], words(keyed)[1]))
    assert sorted(map(tuple, evidence.quote_spans(fields, quotes).collect())) == want
    assert len(want) == 6


def test_many_patterns(spark):
    """200,000 quotes and 20,000 aliases inside words: one plan, the same places as brute force for those that occur."""
    fields = spark.range(300).select(F.col("id").alias("field_id"), F.concat_ws(" ", *[F.sha2(F.concat(F.col("id"), F.lit(f"/{i}")), 256) for i in range(4)]).alias("text"))
    quotes = spark.range(200_000).select(F.col("id").alias("quote_id"), F.when(F.col("id") < 300, F.substring(F.sha2(F.concat(F.col("id"), F.lit("/1")), 256), 5, 20)).otherwise(F.substring(F.sha2(F.concat(F.col("id"), F.lit("?")), 256), 1, 20)).alias("quote"))
    got = {(r.field_id, r.quote_id, r.char_start) for r in evidence.quote_spans(fields, quotes).collect()}
    assert got == {(i, i, 65 + 4) for i in range(300)}
    aliases = spark.range(20_000).select(F.col("id").alias("place_id"), F.concat(F.lit("ஊர்"), F.col("id").cast("string"), F.lit("ல்")).alias("alias"), F.col("id").alias("position"))
    rows = spark.createDataFrame([(1, "இது ஊர்77ல்உள்ள ஊர்3ல்", None, None), (2, "ஊர்", None, None)], "id long, text string, lat double, lng double")
    registry = spark.range(20_000).select(F.col("id").alias("place_id"), F.lit(9.9).alias("lat"), F.lit(78.1).alias("lng"))
    out = {r.id: (r.place_id, r.resolution) for r in geo.geocode(rows, registry, aliases, key="id", text="text").collect()}
    assert out == {1: (3, "registry"), 2: (None, "insufficient")}


def test_links_are_counted_with_one_search_and_without_events(spark, monkeypatch):
    from tidemark import catalogue

    searches, search = [], linking.nearest_pairs
    monkeypatch.setattr(linking, "nearest_pairs", lambda *a, **k: searches.append(1) or search(*a, **k))
    monkeypatch.setattr(linking, "connected_components", lambda *a: searches.append("components"))
    assert catalogue.QUERIES["link_pass_counts"](spark, "/root/testdata/sf0.001").count() == 6
    assert len(searches) == 1
