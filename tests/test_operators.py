"""Operators on small literal tables, edge cases included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import answers, evidence, filters, geo, linking, recurrence, state, trends
from tidemark.operators.components import connected_components
from tidemark.schema import INCIDENT
from tidemark.sources import captures
from tidemark.streaming import windows


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_spans(spark):
    find = lambda t, q: one(spark, X.find_spans(F.col("t"), F.col("q")), t=t, q=q)
    assert find("abcabc", "abc") == [0, 3]
    assert find("aaaa", "aa") == [0, 1, 2]
    assert find("மதுரை மதுரை", "மதுரை") == [0, 6]
    assert find("😀x😀x", "x") == [1, 3]
    assert find("a.b\\Ec", ".b\\E") == [1]
    assert find("abc", "z") == [] and find("", "z") == [] and find("abc", " ") is None
    at = lambda t, q, o: one(spark, X.locate(X.find_spans(F.col("t"), F.col("q")), F.length("q"), o), t=t, q=q)
    assert tuple(at("abcabc", "abc", None)) == ("ambiguous", None, None)
    assert tuple(at("abcabc", "abc", -1)) == (None, 3, 6) and tuple(at("abcabc", "abc", 1)) == (None, 3, 6)
    assert at("abcabc", "abc", 2).fault == "out_of_range" and at("abc", "q", None).fault == "missing" and at("abc", "", None).fault == "blank"


def test_quotes_in_texts(spark):
    texts = spark.createDataFrame([(1, "x" * 30 + "the quick brown fox jumps over" + "x" * 9), (2, "the quick brown fox jumps"), (3, "ab ab"), (4, None)], "field_id long, text string")
    quotes = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "ab"), (3, " "), (4, "the quick brown fox jumps")], "quote_id long, quote string")
    got = sorted(map(tuple, evidence.quote_spans(texts, quotes).collect()))
    assert got == [(1, 1, 30, 60), (1, 4, 30, 55), (2, 4, 0, 25), (3, 2, 0, 2), (3, 2, 3, 5)]
    assert sorted(map(tuple, evidence.unique_field(texts, quotes).collect())) == [(1, 1), (4, 2)]


def test_text_functions(spark):
    assert one(spark, X.script(F.col("t")), t="மதுரை rain") == "mixed" and one(spark, X.script(F.col("t")), t="42") == "other"
    assert one(spark, X.digit_runs(F.col("t")), t="007 of 10 and 7") == ["7", "10"]
    assert one(spark, X.fold(F.col("t")), t="  A \n b ") == "a b"
    assert one(spark, X.contains_alias(F.col("t"), F.lit("melur")), t="in melur town") and not one(spark, X.contains_alias(F.col("t"), F.lit("melur")), t="melurian")
    assert one(spark, X.route_mode(F.lit(""), F.lit("article"), F.lit("Paper"), ("paper",))) == "semantic"
    assert one(spark, X.route_mode(F.lit("news"), F.lit("forecast"), F.lit(""))) == "structured"
    assert one(spark, evidence.verified(F.lit("abc"), F.sha2(F.lit("abc"), 256), F.lit("bc"), F.lit(1), F.lit(3))) == "validated"


def test_question_windows(spark):
    today = F.lit(dt.date(2026, 10, 14))
    ask = lambda t: tuple(one(spark, answers.question_window(F.col("t"), today), t=t) or ())
    day = dt.date
    assert ask("on 2026-10-02?") == (day(2026, 10, 2),) * 2
    assert ask("on 2/10/2026") == (day(2026, 10, 2),) * 2
    assert ask("3 days ago") == (day(2026, 10, 11),) * 2
    assert ask("last 7 days") == (day(2026, 10, 8), day(2026, 10, 14))
    assert ask("last week") == (day(2026, 10, 5), day(2026, 10, 11)) and ask("this month") == (day(2026, 10, 1), day(2026, 10, 31))
    assert ask("2026-02-31") == (None, None) and ask("rain?") == ()


def test_filters(spark):
    rows = spark.createDataFrame([(1, "high", "a", "North", dt.datetime(2026, 10, 2, 23, 59)), (2, None, "a", "South", None), (3, "low", "b", None, dt.datetime(2026, 10, 3))], "incident_id int, severity string, category string, taluk string, event_time timestamp").withColumn("district", F.lit("D"))
    ids = lambda **k: [r.incident_id for r in rows.filter(filters.Filters(**k).keeps()).orderBy("incident_id").collect()]
    assert ids() == [1, 2, 3] and ids(min_severity="low") == [1, 3] and ids(min_severity="high") == [1]
    assert ids(since=dt.date(2026, 10, 1), until=dt.date(2026, 10, 2)) == [1] and ids(place=" NORTH ") == [1] and ids(category="a") == [1, 2]
    with pytest.raises(ValueError):
        filters.Filters(since=dt.date(2026, 1, 2), until=dt.date(2026, 1, 1))
    assert filters.page(rows.orderBy("incident_id"), 9, 2).collect()[0].incident_id == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3), (301, 300)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _reports(spark, rows):
    schema = "incident_id string, record_id string, event_time timestamp, incident_type string, category string, taluk string, person string"
    return spark.createDataFrame(rows, schema)


def test_candidate_pairs(spark):
    t = lambda d: dt.datetime(2026, 10, d)
    rows = [("a", "1", t(1), "flood", "x", "P", None), ("b", "2", t(8), "flood", "unknown", "P", None), ("c", "3", t(20), "flood", "x", "P", None), ("d", "4", None, "flood", "other", None, None), ("e", "1", t(1), "flood", "x", "P", None), ("f", "9", t(2), "unresolved", "other", None, None)]
    got = {(r.low_id, r.high_id): (r.shared, r.gap_seconds) for r in linking.candidate_pairs(linking.signals(_reports(spark, rows))).collect()}
    assert got == {("a", "b"): (2, 604800), ("b", "e"): (2, 604800), ("a", "d"): (1, None), ("b", "d"): (1, None), ("c", "d"): (1, None), ("d", "e"): (1, None)}
    same = _reports(spark, [(f"i{i:02}", str(i), t(1), "flood", "x", "P", None) for i in range(12)])
    capped = linking.candidate_pairs(linking.signals(same), pairs=2).collect()
    assert len(capped) <= 24 and all(r.low_id < r.high_id for r in capped)


def test_link_decisions_and_events(spark):
    pool = spark.createDataFrame([(x,) for x in "abcde"], "incident_id string")
    drafts = spark.createDataFrame(
        [("a", "b", "same_event", 0.9, 1, 1, []), ("b", "c", "same_event", 0.9, 1, 1, []), ("a", "c", "separate_event", 0.9, 0, 0, []), ("c", "d", "same_event", 0.7, 1, 1, []), ("d", "e", "same_event", 0.9, 1, 0, ["day"]), ("a", "e", "maybe", None, 1, 1, [])],
        "low_id string, high_id string, verdict string, confidence double, quotes_low int, quotes_high int, conflicts array<string>",
    )
    links = linking.decide(drafts)
    assert [r.findings for r in links.orderBy("low_id", "high_id").collect()] == [[], [], ["bad verdict", "bad confidence", "low confidence"], [], ["low confidence"], ["no quote from both sides", "conflict"]]
    groups = {r.incident_id: (r.root, r.size, r.review) for r in linking.event_groups(pool, links).collect()}
    assert groups == {**dict.fromkeys("abc", ("a", 3, "review_required")), "d": ("d", 1, "accepted"), "e": ("e", 1, "accepted")}


def _steady(spark, recent, middle=1, oldest=1):
    end, rows, n = dt.date(2026, 10, 10), [], 0
    for day, events in ((end - dt.timedelta(80), oldest), (end - dt.timedelta(45), middle)):
        for e in range(events):
            for _ in range(3):
                n += 1
                rows.append((f"ev{day}{e}", f"i{n}", f"r{n}", "s1", day))
    for i in range(recent):
        n += 1
        rows.append((f"new{i}", f"i{n}", f"r{n}", "s1", end - dt.timedelta(i)))
    rows.append(("old", "i0", "r0", "s1", end - dt.timedelta(100)))
    return spark.createDataFrame(rows, "event_id string, incident_id string, record_id string, source_id string, day date")


def _trend(spark, rows):
    t = trends.Trend(recent_days=30, baseline_blocks=2)
    spans = trends.windows(rows, "day", t)
    grouped = rows.withColumn("dimension", F.lit("type")).withColumn("value", F.lit("flood"))
    return spans, trends.findings(trends.arithmetic(trends.blocks(grouped, "day", spans), trends.coverage(rows, "day", spans), t, trends.new_sources(grouped, "day", spans)), t)


def test_trend_counts_events_not_reports(spark):
    spans, found = _trend(spark, _steady(spark, 3))
    assert [(str(r.since), str(r.until)) for r in spans.orderBy("k").collect()] == [("2026-09-11", "2026-10-10"), ("2026-08-12", "2026-09-10"), ("2026-07-13", "2026-08-11")]
    r = found.first()
    assert (r.recent_events, r.baseline_mean, r.ratio, r.share_ratio, r.findings) == (3, 1.0, 3.0, 3.0, [])
    assert r.alert_eligible and r.per_event_recent == 1.0 and r.per_event_baseline == 3.0


def test_trend_gates_and_gaps(spark):
    assert _trend(spark, _steady(spark, 2))[1].count() == 0
    gap = _trend(spark, _steady(spark, 3, middle=0))[1].first()
    assert gap.empty_windows == 1 and gap.ratio == 6.0 and "empty_window" in gap.findings
    short = _steady(spark, 3).filter("day > DATE '2026-08-20'")
    assert trends.windows(short, "day", trends.Trend()).count() == 0


def test_half_period_and_precision(spark):
    t = lambda m, d: dt.datetime(2026, m, d)
    rows = spark.createDataFrame([("f", t(8, 1)), ("f", t(9, 20)), ("f", t(10, 5)), ("g", t(8, 1)), ("g", t(8, 20)), ("h", t(8, 1)), ("h", None)], "family string, at timestamp")
    got = {r.family: (r.change, r.recent_events, r.previous_events, r.reason) for r in recurrence.half_period(rows, "family", "at").collect()}
    assert got == {"f": (1, 2, 1, None), "g": (None, None, None, "shorter than the 61 days"), "h": (None, None, None, "fewer than two dated events")}
    areas = spark.createDataFrame([("f", "e1", "village", "v"), ("f", "e1", "district", "d"), ("f", "e2", "taluk", "t")], "family string, event_id string, level string, name string")
    assert tuple(recurrence.area_precision(areas).first()) == ("f", 3, "taluk")
    assert {r.month for r in recurrence.monthly(rows.filter("family = 'h'"), [], "at").collect()} == {"2026-08", "undated"}


def test_state(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", None)], "record_id string, event_time int")
    assert sorted(r.record_id for r in state.newly_ingested(rows, rows.filter("record_id = 'a'")).collect()) == ["b", "c"]
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "record_id string, line int, v string")
    assert sorted((r.v, r.superseded) for r in state.last_write_wins(log, "record_id", "line").collect()) == [("y", 1), ("z", 0)]
    batch = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "incident_id string, digest string")
    out = state.post_outcomes(batch, spark.createDataFrame([("a", "1"), ("b", "0")], batch.schema), spark.createDataFrame([("a",), ("b",)], "incident_id string"))
    assert sorted(map(tuple, out.collect())) == [("a", "unchanged", "1"), ("b", "duplicate", "0"), ("c", "created", "1")]
    assert {r.state: r.n for r in state.counts_by_state(spark.createDataFrame([("failed",)], "state string"), "state", ["completed", "failed"]).collect()} == {"completed": 0, "failed": 1}
    assert sorted(r.v for r in state.merged(log, log.filter("record_id = 'b'").withColumn("v", F.lit("n")), ["record_id"]).collect()) == ["n", "x", "y"]


def test_geo(spark):
    rows = spark.createDataFrame([(1, 9.9, 78.1, "x"), (2, None, None, "Near Anna  Nagar."), (3, 9.9, None, "anna nagar"), (4, 78.1, 9.9, ""), (5, None, None, "annanagar"), (6, float("nan"), 78.0, "")], "id int, lat double, lng double, text string")
    registry = spark.createDataFrame([("p", 9.91, 78.15)], "place_id string, lat double, lng double")
    alias = spark.createDataFrame([("p", "anna nagar", 0)], "place_id string, alias string, position int")
    got = {r.id: (r.resolution, r.lat_out) for r in geo.geocode(rows, registry, alias, key="id", text="text", lat_box=(9.5, 10.4), lng_box=(77.6, 78.6)).collect()}
    assert got == {1: ("explicit", 9.9), 2: ("registry", 9.91), 3: ("rejected_incomplete", None), 4: ("rejected_swapped", None), 5: ("insufficient", None), 6: ("rejected_not_finite", None)}
    same = spark.createDataFrame([(i, 9.9179, 78.1504) for i in range(3)], "id int, lat double, lng double")
    spread = geo.disperse(same, lat="lat", lng="lng", order=["id"]).collect()
    assert len({(r.display_lat, r.display_lng) for r in spread}) == 3 and all(abs(r.display_lat - r.lat) < 0.001 for r in spread)
    notes = spark.createDataFrame([("N", "incident", "high"), ("N", "incident", "low"), ("M", "incident", "medium"), ("V", "forecast", "high")], "taluk string, record_kind string, severity string")
    areas = spark.createDataFrame([("N",), ("M",), ("V",)], "taluk string")
    assert {r.taluk: (r.severity, r.incidents) for r in geo.areas_joined(areas, geo.area_rollup(notes, "taluk"), "taluk").collect()} == {"N": ("high", 2), "M": ("medium", 1), "V": ("unknown", 0)}


def test_contract_rules(spark):
    ev = dict(evidence_id="e1", record_id="r", field="f", method="text", quote="abc", char_start=0, char_end=3, text_hash="h")
    claim = dict(field="description", value="v", method="text", confidence=None, review="accepted", evidence_ids=["e1"])
    base = dict.fromkeys(f.name for f in INCIDENT.fields)
    good = base | dict(incident_id="1", record_kind="incident", review="accepted", incident_type="flood", locations=[], entities=[], claims=[claim], evidence=[ev])
    bad = good | dict(incident_id="2", evidence=[ev | dict(char_end=9), ev], claims=[claim | dict(evidence_ids=["zz"], confidence=2.0, review="review_required")])
    rows = spark.createDataFrame([tuple(x[f.name] for f in INCIDENT.fields) for x in (good, bad)], INCIDENT)
    got = {r.rule: r.documents for r in evidence.violations(rows).collect() if r.documents}
    assert got == {"evidence_length": 1, "evidence_repeated": 1, "dangling_reference": 1, "confidence_range": 1, "accepted_with_open_claim": 1}


def test_captures(spark):
    html = '<h1>A <b>title</b></h1><a href="/x">x</a><a class="c" href="/x">x</a><a href="http://o/y">y</a><p> one </p><p></p><p>two\n three</p><table><tr><th>Date</th></tr><tr><td>02-Oct</td><td>2</td></tr></table>'
    pages = spark.createDataFrame([(1, html), (2, "")], "page_id long, html string")
    assert [r.url for r in captures.links(pages, base="http://h/").orderBy("position").collect()] == ["http://h/x", "http://o/y"]
    assert tuple(captures.articles(pages).filter("page_id = 1").first()) == (1, "A title", "one two three")
    assert captures.table_rows(pages, cells=2).first().cells == ["02-Oct", "2"]
    payload = spark.createDataFrame([("m", '{"rice": {"quantity": "0", "min_price": "10.5", "max_price": ""}}')], "market string, payload string")
    assert tuple(captures.price_rows(payload).first()) == ("m", "rice", None, 10.5, None)
    jobs = spark.createDataFrame([(1, 2, [("LINE", "c")]), (1, 1, [("PAGE", None), ("LINE", "a"), ("WORD", "a"), ("LINE", "b")])], "job_id int, page_number int, blocks array<struct<type:string,text:string>>")
    assert tuple(captures.ocr_lines(jobs).first()) == (1, 3, 1, "a\nb\nc")


def test_streams_match_batches(spark, tmp_path):
    start = dt.datetime(2026, 10, 1)
    rows = [(str(i), f"u{i % 3}", "view", start + dt.timedelta(hours=i * i % 97), float(i)) for i in range(40)]
    batch = spark.createDataFrame(rows, "record_id string, source_id string, record_type string, event_time timestamp, value double")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    for f, mode in ((windows.tumbling, "complete"), (windows.sliding, "complete"), (windows.sessions, "complete")):
        stream = windows.read_events(spark, str(tmp_path / "in"), batch.schema)
        name = f"out_{f.__name__}"
        run = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).start()
        run.processAllAvailable()
        run.stop()
        assert sorted(map(tuple, spark.table(name).collect()), key=repr) == sorted(map(tuple, f(batch).collect()), key=repr)
    seen = windows.first_seen(windows.read_events(spark, str(tmp_path / "in"), batch.schema))
    run = seen.writeStream.format("memory").queryName("out_seen").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("out_seen").count() == 40


def test_normalize(spark):
    from tidemark.operators import normalize

    article = normalize.articles(spark.createDataFrame([("http://a/1", " A  title ", None, "text"), ("http://a/2", "", None, None)], "url string, title string, published_at timestamp, content string"), prefix="N-", source="paper", district="D")
    rows = {r.record_id: r for r in normalize.canonical(article).collect()}
    full, bare = sorted(rows.values(), key=lambda r: len(r.missing))
    assert [tuple(t) for t in full.texts] == [("title", "A title"), ("data.content", "text")] and full.missing == [] and full.notes == []
    assert bare.missing == ["title"] and bare.notes == ["content"] and bare.texts == []
    weather = normalize.forecasts(spark.createDataFrame([("S", "02-Oct", {"max": "31"}), ("S", "31-Feb", {"max": ""})], "station string, forecast_date string, measures map<string,string>"), prefix="W-", source="office", year=F.lit(2026))
    assert sorted(str(r.event_time) for r in weather.collect()) == ["2026-10-02 00:00:00", "None"]
    assert [(r.fact_index, r.name) for r in normalize.structured_facts(weather).collect()] == [(0, "max")]
    assert one(spark, normalize.distinct_parts(F.array(F.lit("Melur town"), F.lit("melur"), F.lit(None).cast("string"), F.lit("East")))) == "Melur town, East"
    assert one(spark, normalize.display_entries(F.create_map(F.lit("max_c"), F.lit("31"), F.lit("language"), F.lit("ta"), F.lit("min_price"), F.lit("5"), F.lit("unit"), F.lit("kg")))) == {"max_c": "31 °C", "min_price": "5 /kg", "unit": "kg"}
    assert [tuple(r)[1:] for r in normalize.source_places(article).limit(2).collect()] == [("D", "unknown"), ("D", "district")]
