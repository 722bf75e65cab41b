"""The whole passes against brute force, and operators that have no query of their own."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark import catalogue as q
from tidemark.operators import boards, checkpoints, documents, families, filters, gis, linking, recurrence, replies, trends
from tidemark.plans import passes
from tidemark.queries import _groups
from tidemark.sources import captures, views

SF = "/root/testdata/sf0.001"


def r4(x):
    return round(x, 4)


def test_trend_pass_counts_events(spark):
    pool, groups = _groups(spark, SF)
    event = {r.incident_id: r.event_id for r in groups.collect()}
    rows = [r for r in pool.collect()]
    day = defaultdict(lambda: dt.date.max)
    for r in rows:
        day[event[r.incident_id]] = min(day[event[r.incident_id]], r.event_time.date())
    end, start = max(day.values()), min(day.values())
    usable = min(3, (end - dt.timedelta(29) - start).days // 30)
    window = {e: (end - d).days // 30 for e, d in day.items()}
    pools = defaultdict(set)
    for r in views.incidents(spark, SF).collect():
        k = (end - r.event_time.date()).days // 30
        if 0 <= k <= usable:
            pools[k].add(r.record_id)
    found = defaultdict(lambda: defaultdict(set))
    reports, sources = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for r in rows:
        e = event[r.incident_id]
        if window[e] > usable:
            continue
        kind = r.incident_type if r.incident_type not in ("unresolved", "other", "unknown") else None
        for p in (("category", r.category), ("incident_type", kind), ("place", r.taluk and f"taluk:{r.taluk}")):
            if p[1]:
                p = p[0], p[1].lower()
                found[p][window[e]].add(e)
                reports[p][window[e]].add(r.incident_id)
                sources[p][window[e]].add(r.source_id)
    want = {}
    for p, by in found.items():
        e0, eb = len(by[0]), sum(len(by[k]) for k in range(1, usable + 1))
        mean = eb / usable
        if e0 < 3 or (mean and e0 <= mean):
            continue
        ratio = r4(e0 / mean) if mean else None
        shares = sum(len(by[k]) / len(pools[k]) for k in range(1, usable + 1) if pools[k]) / max(1, sum(1 for k in range(1, usable + 1) if pools[k]))
        per0 = r4(len(reports[p][0]) / e0)
        perb = r4(sum(len(reports[p][k]) for k in range(1, usable + 1)) / eb) if eb else 0
        older = set().union(*(sources[p][k] for k in range(1, usable + 1)))
        checks = [("empty_window", any(not pools[k] for k in range(usable + 1))), ("zero_baseline", not mean), ("low_ratio", mean and ratio < 2), ("coverage", r4(shares) > 0 and r4(e0 / len(pools[0]) / shares) < 2), ("reports_per_event", perb and per0 >= 1.5 * perb), ("new_sources", mean and bool(sources[p][0] - older))]
        want[p] = (ratio, e0, "|".join(n for n, hit in checks if hit))
    got = q.QUERIES["trend_pass_rank"](spark, SF).collect()
    assert {(r.dimension, r.value): (r.ratio, r.recent_events, r.findings) for r in got} == want
    assert len({r.trend_id for r in got}) == len(got) and [(-(r.ratio or 0), -r.recent_events, r.trend_id) for r in got] == sorted((-(r.ratio or 0), -r.recent_events, r.trend_id) for r in got)
    alone = passes.trend_pass(pool, views.incidents(spark, SF).withColumn("day", F.to_date("event_time")), trends.Trend(recent_days=30, baseline_blocks=3)).collect()
    assert alone and all(r.findings[0] == "not_deduplicated" and not r.alert_eligible for r in alone)


def test_recurrence_pass(spark):
    at = lambda d: dt.datetime(2026, 8, d)
    rows = [("e1", at(1), ["flood"], ["water"], ["t1"], ["d"]), ("e2", at(9), ["flood"], [], ["t2"], ["d"]), ("e3", at(3), [], ["health"], ["t1"], ["d"])]
    units = spark.createDataFrame(rows, "event_id string, when timestamp, types array<string>, categories array<string>, taluks array<string>, districts array<string>")
    found, months = passes.recurrence_pass(units)
    assert [r.event_ids for r in found.collect()] == [["e2", "e1"]] or [sorted(r.event_ids) for r in found.collect()] == [["e1", "e2"]]
    assert [(r.month, r.events) for r in months.collect()] == [("2026-08", 2)]
    assert recurrence.buckets(units.limit(1)).count() == 0


def test_first_report_stays(spark):
    rows = spark.createDataFrame([("a", "r2", dt.datetime(2026, 1, 2)), ("a", "r1", dt.datetime(2026, 1, 1)), ("a", "r0", None), ("b", "r9", None)], "incident_id string, record_id string, event_time timestamp")
    rows = rows.withColumn("record_kind", F.lit("incident")).withColumn("review", F.lit("accepted"))
    assert sorted((r.incident_id, r.record_id) for r in filters.accepted_pool(rows).collect()) == [("a", "r1"), ("b", "r9")]


def test_families_without_a_second_event(spark):
    drafts = spark.createDataFrame([("b", 1, "l", "d", "police", 0.9, [1, 9], ["q"], 0, []), ("b", 2, "l", "d", "police", 0.9, [1, 2, 2, 3], ["q1", "q2", "zz"], 0, [])], "bucket_id string, family int, label string, description string, department string, confidence double, events array<int>, cited array<string>, truncated int, differences array<string>")
    members = spark.createDataFrame([("b", 1, "e1"), ("b", 2, "e2"), ("b", 3, "e3")], "bucket_id string, number int, event_id string")
    units = spark.createDataFrame([(f"e{i}", dt.datetime(2026, 1, i), i, ["water"]) for i in (1, 2, 3)], "event_id string, when timestamp, incidents int, categories array<string>")
    keys = spark.createDataFrame([("e2", "x"), ("e3", "y")], "event_id string, key string")
    quotes = spark.createDataFrame([("e2", "q1"), ("e3", "q2")], "event_id string, evidence_id string")
    row = families.assess(drafts, members, units, keys, quotes).collect()
    assert len(row) == 1 and row[0].event_ids == ["e2", "e3"] and row[0].findings == ["reused event", "quote not shown", "not linked"]
    assert (row[0].incidents, row[0].span_days, row[0].review) == (5, 1, "review_required")


def test_boundaries_and_ladder_edges(spark):
    text = '{"type": "FeatureCollection", "crs": {"a": 1}, "features": [{"type": "Feature"}]}'
    files = spark.createDataFrame([("a", text), ("b", "[]"), ("c", None)], "file string, text string")
    assert {r.file: r.fault for r in gis.boundary_faults(files).collect()} == {"a": "reference system", "b": "not a collection", "c": "not a collection"}
    rows = spark.createDataFrame([("nan", "78"), ("9.9", None), (None, None)], "lat string, lng string")
    none = F.lit(None).cast("string")
    place = gis.resolution(latitude=F.col("lat"), longitude=F.col("lng"), raw_text=none, source_type=none, canonical_id=none, district=none, market=none, station_id=none, source_id=none)
    assert [r[0] for r in rows.select(place["status"]).collect()] == ["INVALID_SOURCE_COORDINATES"] * 2 + ["UNRESOLVED_INSUFFICIENT_DATA"]


def test_collection_is_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("k:1", "{}"), ("k:2", "{}")], "key string, feature string").repartition(2)
    gis.write_collection(rows, str(tmp_path / "out"), district="D", state="S")
    assert spark.read.text(str(tmp_path / "out/features")).count() == 2
    assert '"feature_count":2' in spark.read.text(str(tmp_path / "out/metadata")).first()[0]


def test_manifest_of_nothing_and_settling(spark):
    log = spark.createDataFrame([("a", "completed"), ("b", "failed")], "record_id string, state string")
    empty = checkpoints.manifest(log.limit(0))
    assert checkpoints.reconcile(empty, checkpoints.manifest(log)).first().fault == "incomplete manifest"
    seen, waits = checkpoints.settle(log.limit(0), spark.createDataFrame([("a",), ("z",)], "record_id string"), log)
    assert sorted(r[0] for r in seen.collect()) == ["a", "b"] and sorted(r[0] for r in waits.collect()) == ["b", "z"]
    merged = checkpoints.merged_results(log, log.withColumn("state", F.lit("deferred")))
    assert {r.record_id: r.state for r in merged.collect()} == {"a": "completed", "b": "deferred"}


def test_place_rules_of_documents(spark):
    place = "struct<text:string,normalized_name:string,location_type:string,role:string,district:string,taluk:string,block:string,village:string,review:string,evidence_ids:array<string>>"
    rows = [("Melur", None, "taluk", "event_location", "Madurai", "Melur", None, "Kottampatti", "accepted", ["e"]), ("Madurai", None, "village", "event_location", "Madurai", None, None, None, "accepted", []), ("Chennai", None, "town", "mentioned_only", None, None, None, None, "accepted", []), ("Salem", None, "town", "event_location", None, None, None, None, "review_required", [])]
    doc = spark.createDataFrame([(rows, [], "Madurai", None)], f"locations array<{place}>, entities array<struct<text:string,normalized_name:string,entity_type:string,review:string>>, district_hint string, state_hint string")
    got = doc.select(documents.place_names(), documents.unit_keys(), F.transform(documents.area_entries(), lambda a: F.concat_ws(":", a["level"], a["name"]))).first()
    assert got[0] == ["melur"]
    assert got[1] == ["district:madurai", "taluk:melur", "village:kottampatti", "village:madurai"]
    assert got[2] == ["taluk:Melur", "village:Kottampatti", "district:Madurai", "village:Madurai"]


def test_submission_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "incident_id string, at int")
    out = documents.submit(rows, rows.filter("incident_id = 'b'"), "incident_id", "at")
    assert sorted((r.incident_id, r.at, r.outcome) for r in out.collect()) == [("a", 1, "stored"), ("a", 2, "duplicate"), ("b", 1, "duplicate")]
    assert documents.submit(rows.limit(0), rows, "incident_id", "at").count() == 0


def test_links_and_added_lines(spark):
    pages = spark.createDataFrame([(1, "<div>ADDED : மே 5, 2026 09:15 PM</div>"), (2, "<p>none</p>")], "page_id int, html string")
    assert {r.page_id: r.added for r in captures.added_line(pages).collect()} == {1: "ADDED : மே 5, 2026 09:15 PM", 2: None}
    assert boards.facet_filter(pages, page_id="1").count() == 1
    assert linking.decide(spark.createDataFrame([("same_event", float("nan"), 1, 1, [])], "verdict string, confidence double, quotes_low int, quotes_high int, conflicts array<string>")).first().findings == ["bad confidence", "low confidence"]


@pytest.mark.parametrize("size,most", [(5, 2), (0, 2)])
def test_limited_evidence(spark, size, most):
    rows = spark.createDataFrame([(1, "e", "i", p, f"q{p % 4}") for p in range(size)], "event_rank int, event_id string, incident_id string, position int, evidence_id string")
    assert replies.limited_evidence(rows, most=most).count() == min(size, most)


def test_readers_fail_over_and_close(spark):
    from tidemark.plans.readers import Refused, Unreadable, read_with

    def first(row):
        if row["k"] >= 5:
            raise Refused("quota")
        return {"verdict": f"a{row['k']}"} if row["k"] % 2 == 0 else None

    def second(row):
        if row["k"] == 3:
            raise Unreadable("torn page")
        return {"verdict": "b"} if row["k"] < 8 else None

    rows = spark.createDataFrame([(k,) for k in range(10)], "k long").coalesce(1)
    got = {r.k: (r.state, r.answered_by, r.verdict) for r in read_with(rows, [("first", first), ("second", second)], "verdict string", key="k").collect()}
    assert got[0] == ("completed", "first", "a0") and got[1] == ("completed", "second", "b") and got[3] == ("failed", "second", None)
    assert got[6] == ("completed", "second", "b")  # the first one has closed
    assert got[9] == ("deferred", None, None)
    assert {r.state for r in read_with(rows, [], "verdict string", key="k").collect()} == {"deferred"}


def test_session_memory_on_a_stream(spark, tmp_path):
    from tidemark.streaming.memory import remembered

    turns = [(1, t, "x" * (150 * t)) for t in range(1, 8)] + [(2, 1, None), (2, 2, "y" * 2000)]
    for part in (turns[:4], turns[4:]):
        spark.createDataFrame(part, "conv_id long, turn long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "in"))
        remembered(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    got = {(r.conv_id, r.turn): (r.kept, r.chars) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for conv in (1, 2):
        own = [(t, len(x or "")) for c, t, x in turns if c == conv]
        for i, (t, _) in enumerate(own):
            kept = chars = 0
            for _, size in reversed(own[max(0, i - 5) : i + 1]):
                if chars + size > 1200:
                    break
                kept, chars = kept + 1, chars + size
            want[conv, t] = (kept, chars)
    assert got == want
