"""Questions in one plan, and the days that questions name."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import answers, questions, records, replies

TODAY = dt.date(2026, 10, 14)


@pytest.fixture(scope="module")
def ask(spark):
    def run(*texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        out = rows.select("i", answers.question_window(F.col("t"), F.lit(TODAY)).alias("w")).orderBy("i").collect()
        return [tuple(r.w) if r.w else None for r in out]

    return run


def test_days_that_questions_name(ask):
    d = dt.date
    one = lambda *x: (d(*x),) * 2
    forms = {
        "on 2026-10-2?": one(2026, 10, 2), "2026-1-05": one(2026, 1, 5), "12026-10-02": None, "on 2/10/2026": one(2026, 10, 2), "2-1-2026": one(2026, 1, 2), "2 10 2026": one(2026, 10, 2), "31/2/2026": (None, None),
        "3 days ago": one(2026, 10, 11), "1 day ago": one(2026, 10, 13), "100 days ago": None, "last 7 days": (d(2026, 10, 8), TODAY), "recent 10 days": (d(2026, 10, 5), TODAY), "past 1 day": (TODAY, TODAY), "last 100 days": None,
        "2 Oct": one(2026, 10, 2), "2 Oct 2025": one(2025, 10, 2), "what of 20 october, 2024?": one(2024, 10, 20), "2-sept": one(2026, 9, 2), "5 goats 3 may": one(2026, 5, 3), "31 feb 3 mar": one(2026, 3, 3), "2 octagons": None,
        "yesterday": one(2026, 10, 13), "todays": None, "நாளை மழை": one(2026, 10, 15), "last week": (d(2026, 10, 5), d(2026, 10, 11)), "current week": (d(2026, 10, 12), d(2026, 10, 18)), "கடந்த மாதம்": (d(2026, 9, 1), d(2026, 9, 30)),
        "previous month": (d(2026, 9, 1), d(2026, 9, 30)), "today 2026-01-03": one(2026, 1, 3), "last week or 3 may": one(2026, 5, 3), "rain?": None, "": None,
    }
    got = dict(zip(forms, ask(*forms), strict=True))
    assert got == forms


def test_emoji_of_all_ranges(spark):
    texts = ["plain", "flag \U0001F1EE\U0001F1F3", "star ⭐", "heart ❤", "variation x️", "tile \U0001F004", "face \U0001F600", "arrow →"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    fault = replies.general_refusal(F.array("t"), answerable=F.lit(True), value_shaped=F.lit(False), district_claims=F.lit(False), places=F.array().cast("array<string>"))
    assert [r.f for r in rows.select(fault.alias("f")).collect()] == [None, *["emoji"] * 6, None]


def test_follow_ups_carry_what_they_follow(spark):
    rows = [
        ("s", 1, "and floods?", True, False), ("s", 2, "floods in melur", False, False), ("s", 3, "hello", False, True), ("s", 4, "and roads?", True, False), ("s", 5, "last week?", True, False), ("s", 6, "last week?", True, False),
        ("s", 7, "fires", False, False), ("t", 1, "fires", False, False), ("t", 2, "more", True, False),
    ]
    table = spark.createDataFrame(rows, "session string, position int, text string, follows boolean, general boolean")
    got = {(r.session, r.position): (r.asked, r.carried) for r in questions.follow_ups(table).collect()}
    assert got == {
        ("s", 1): ("and floods?", False), ("s", 2): ("floods in melur", False), ("s", 3): ("hello", False), ("s", 4): ("floods in melur and roads?", True), ("s", 5): ("floods in melur and roads? last week?", True), ("s", 6): ("last week?", False),
        ("s", 7): ("fires", False), ("t", 1): ("fires", False), ("t", 2): ("fires more", True),
    }
    long = spark.createDataFrame([("s", i, f"q{i}", i > 0, False) for i in range(20)], table.schema)
    assert {r.position: r.asked for r in questions.follow_ups(long, most=2).collect()}[19] == "q17 q18 q19"


def corpus(spark):
    day = lambda d: dt.datetime(2026, 10, d)
    rows = [
        ("E1", "i1", day(13), "Flood", "water", "Melur"), ("E1", "i2", day(12), "Flood", "water", "Melur Town"), ("E2", "i3", day(12), "flood", "water", "Vadipatti"), ("E3", "i4", None, "flood", "water", "Melur"),
        ("E4", "i5", day(5), "flood", "water", "Melur"), ("E5", "i6", day(13), "fire", "safety", "Melur"), ("E6", "i7", day(1), "fire", "safety", None),
    ]
    table = spark.createDataFrame(rows, "event_id string, incident_id string, at timestamp, type string, category string, place string")
    units = questions.units_of(table, {"type": "type", "category": "category", "place": "place"}, event="event_id", day="at")
    evidence = table.select("event_id", "incident_id", F.concat(F.lit("ev-"), "incident_id").alias("evidence_id"), F.concat("type", F.lit(" seen")).alias("quote"), F.lit("u").alias("source_url"))
    return units, evidence


def test_search_and_answers(spark):
    units, evidence = corpus(spark)
    vocabulary = units.select(F.explode("held").alias("v")).select("v.*").distinct()
    texts = {1: "floods? flood in MELUR last 7 days", 2: "flood", 3: "fire or flood in melur town", 4: "what happened", 5: "flood in vadipatti 2 days ago", 6: "fire yesterday", 7: "water in vadipatti on 2020-01-01", 8: "flood melur 1 day ago", 9: "fire 2020-01-01", 10: "last 7 days"}
    asked = spark.createDataFrame(list(texts.items()), "question_id int, asked string")
    read = questions.read(asked, vocabulary, F.lit(TODAY)).cache()
    wanted = {r.question_id: [tuple(x) for x in r.wanted] for r in read.collect()}
    assert wanted[1] == [("place", "melur"), ("type", "flood")] and wanted[3] == [("place", "melur"), ("place", "melur town"), ("type", "fire"), ("type", "flood")] and wanted[4] == []
    searches = read.select("search_id", "wanted", "since", "until").distinct()
    found = questions.retrieve(units, searches).cache()
    by = {r.question_id: r for r in read.join(found.drop("wanted", "since", "until"), "search_id").collect()}
    row = lambda i: (by[i].events, by[i].incidents, by[i].previous, by[i].undated, by[i].outside, by[i].shown)
    assert row(1) == (1, 2, 1, 1, 2, ["E1"])
    assert row(2) == (4, 5, 0, 0, 0, ["E2", "E1", "E4", "E3"])
    assert row(3) == (4, 5, 0, 0, 0, ["E5", "E1", "E4", "E3"])
    assert row(4)[0] == 6 and row(10)[:2] == (3, 4)
    assert row(5) == (1, 1, 0, 0, 0, ["E2"]) and row(6) == (1, 1, 0, 0, 1, ["E5"])
    assert row(7)[0] == 0 and row(9) == (0, 0, 0, 0, 2, [])
    out = {r.question_id: r for r in questions.answers(read, found, evidence).collect()}
    assert out[1].state == "grounded" and out[1].statements[0] == "1 distinct event(s) in 2 report(s) from 2026-10-08 to 2026-10-14." and "Flood seen" in out[1].statements
    assert [c.evidence_id for c in out[1].citations] == ["ev-i1", "ev-i2"] and out[1].change == 0
    assert (out[9].state, out[9].missing) == ("refused", "nothing falls into the period") and out[9].statements == []
    assert set(out) == set(texts)
    drafts = spark.createDataFrame([(1, "2 report(s) of floods", True, ["E1"], []), (1, "77 people", True, ["E1"], []), (2, "uncited", False, [], []), (2, "confirmed by E2", False, ["E2"], ["ev-i3"]), (5, "a flood", False, ["E9"], ["ev-i3"])], "question_id int, text string, calculated boolean, cited_events array<string>, cited_evidence array<string>")
    told = {r.question_id: r for r in questions.answers(read, found, evidence, drafts).collect()}
    assert (told[1].state, told[1].statements, told[1].findings) == ("qualified", ["2 report(s) of floods"], ["number not measured"])
    assert (told[2].state, told[2].statements, told[2].findings) == ("qualified", ["confirmed by E2"], ["uncited", "confirmed"])
    assert (told[5].state, told[5].missing, told[5].findings) == ("refused", "no statement carried its own citation", ["event out of scope"])


def test_searches_of_nothing(spark):
    units, evidence = corpus(spark)
    asked = spark.createDataFrame([(1, "zebra"), (2, None)], "question_id int, asked string")
    vocabulary = units.select(F.explode("held").alias("v")).select("v.*").distinct()
    read = questions.read(asked, vocabulary, F.lit(TODAY))
    assert read.select("search_id").distinct().count() == 1
    found = questions.retrieve(units.limit(0), read.select("search_id", "wanted", "since", "until").distinct())
    assert [(r.events, r.shown) for r in found.collect()] == [(0, [])]
    assert {r.state for r in questions.answers(read, found, evidence).collect()} == {"refused"}


def test_searches_add_up_sets_of_values_not_events(spark):
    kinds, places = ["flood", "fire", None], ["melur", "vadipatti"]
    rows = [(f"E{i:05}", f"i{i}", dt.datetime(2026, 10, 1 + i % 13) if i % 5 else None, kinds[i % 3], "water", places[i % 2]) for i in range(3000)]
    table = spark.createDataFrame(rows, "event_id string, incident_id string, at timestamp, type string, category string, place string")
    units = questions.units_of(table, {"place": "place", "type": "type", "category": "category"}, event="event_id", day="at")
    vocabulary = units.select(F.explode("held").alias("v")).select("v.*").distinct()
    texts = ["flood last 3 days", "fire or flood in melur", "water last 7 days", "anything", "flood", "fire in vadipatti or melur last 3 days"]
    asked = spark.createDataFrame(list(enumerate(texts)), "question_id int, asked string")
    read = questions.read(asked, vocabulary, F.lit(dt.date(2026, 10, 13))).cache()
    searches = read.select("search_id", "wanted", "since", "until").distinct()
    sets = questions.holders(units, searches)
    assert sets.count() <= 6 * len(texts) and {len(r.held) for r in sets.collect()} == {2, 3}
    found = {r.search_id: r for r in questions.retrieve(units, searches).collect()}
    for s in read.collect():
        wanted = {f: {v.value for v in s.wanted if v.facet == f} for f in {v.facet for v in s.wanted}}
        met = [(r[0], r[2] and r[2].date()) for r in rows if all({"type": r[3], "category": r[4], "place": r[5]}[f] in vs for f, vs in wanted.items())]
        inside = [m for m in met if s.since is None or (m[1] and s.since <= m[1] <= s.until)]
        before = [m for m in met if s.since and m[1] and 0 < (s.since - m[1]).days <= (s.until - s.since).days + 1]
        newest = sorted(inside, key=lambda m: (m[1] or dt.date.min, m[0]), reverse=True)
        r = found[s.search_id]
        assert (r.events, r.incidents, r.previous, r.outside) == (len(inside), len(inside), len(before), len(met) - len(inside))
        assert r.undated == len([m for m in met if m not in inside and m[1] is None]) and r.shown == [m[0] for m in newest[:8]]


def test_fields_named_by_many_questions(spark):
    index = spark.createDataFrame([("kind", "Road", "a"), ("kind", "bridge", "a"), ("kind", "road", "b"), ("kind", "bridge", "c"), ("kind", "well", None), ("who", "road", "a")], "field string, word string, id string")
    asked = spark.createDataFrame([(1, "a ROAD, a bridge"), (2, "road"), (3, "well?"), (4, "none"), (5, None)], "question_id int, text string")
    got = {(r.question_id, r.field): (r.words, r.ids) for r in records.named_fields(index, asked).collect()}
    assert got == {(1, "kind"): (["bridge", "road"], 3), (1, "who"): (["road"], 1), (2, "kind"): (["road"], 2), (2, "who"): (["road"], 1), (3, "kind"): (["well"], 0)}
    n = 40_000  # pairs of questions and ids would be 1.6 billion
    index = spark.range(n).select(F.lit("kind").alias("field"), F.lit("road").alias("word"), F.col("id").cast("string").alias("id"))
    began = time.time()
    assert records.named_fields(index, spark.range(n).select(F.col("id").alias("question_id"), F.lit("a road").alias("text"))).agg(F.sum("ids")).first()[0] == n * n
    assert time.time() - began < 60
