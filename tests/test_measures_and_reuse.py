"""The cube of periods, the lines that read from it, and the reasons why a saved result can't be used again."""

import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.operators import measures, state

DAY = dt.date(2026, 10, 14)


def reports(spark, rows):
    return spark.createDataFrame(rows, "event_id string, incident_id string, record_id string, source_id string, day date, areas array<string>, category string, status string, quoted boolean")


ROWS = [
    ("E1", "i1", "r1", "s1", DAY, ["Melur", "Madurai"], "water", "ongoing", True), ("E1", "i2", "r2", "s2", DAY, ["Melur"], "safety", "resolved", True), ("E2", "i3", "r3", "s1", dt.date(2026, 10, 9), None, "water", "unknown", True),
    ("E3", "i4", "r4", "s3", dt.date(2026, 10, 2), ["Melur", ""], None, "ongoing", False), ("E4", "i5", "r5", "s3", None, ["Melur"], "water", None, None), ("E5", "i6", "r5", "s3", dt.date(2026, 8, 1), [], "water", "closed", True),
]


def cells_of(spark, rows, days):
    table = reports(spark, rows)
    periods = measures.counted_back(table, days)
    facets = {"area": F.col("areas"), "category": F.array("category"), "standing": F.array(measures.standing(F.col("status"), F.col("quoted")))}
    return table, periods, measures.cube(table, periods, facets)


def test_cube_against_loops(spark):
    _, _, cells = cells_of(spark, ROWS, {"week": 7, "fortnight": 14})
    found = defaultdict(lambda: [set(), set(), set(), set()])
    for period, days in (("week", 7), ("fortnight", 14)):
        for event, incident, record, source, day, areas, category, status, quoted in ROWS:
            side = "undated" if day is None else "inside" if DAY - dt.timedelta(days - 1) <= day <= DAY else "outside"
            stands = "unstated" if status in (None, "unknown") else "unquoted" if not quoted else {"ongoing": "open", "resolved": "recorded"}.get(status, "other")
            values = [(None, None)] + [("area", a) for a in areas or [] if a] + ([("category", category)] if category else []) + [("standing", stands)]
            for dimension, value in values:
                for held, x in zip(found[period, side, dimension, value], (event, incident, record, source), strict=True):
                    held.add(x)
    got = {(r.period_id, r.side, r.dimension, r.value): (r.events, r.incidents, r.records, r.sources) for r in cells.collect()}
    assert got == {k: tuple(map(len, v)) for k, v in found.items()} and cells.count() == len(got)


def test_many_periods_share_one_row_an_id(spark, capsys):
    """More periods than fit into one number, and no copy of the reports for each set of distinct ids."""
    days = {f"p{n:02}": n + 1 for n in range(25)}
    _, _, cells = cells_of(spark, ROWS, days)
    got = {(r.period_id, r.side): (r.events, r.incidents) for r in cells.filter("dimension IS NULL").collect()}
    for period, n in days.items():
        inside = [r for r in ROWS if r[4] and r[4] > DAY - dt.timedelta(n)]
        assert got[period, "inside"] == (len({r[0] for r in inside}), len(inside)) and got[period, "undated"] == (1, 1)
    cells.explain()
    assert "Expand" not in capsys.readouterr().out


def test_lines_and_reasons(spark):
    _, periods, cells = cells_of(spark, ROWS, {"week": 7})
    reasons = measures.emptiness(cells, periods, read=6, kept=6)
    overlaps = spark.createDataFrame([("week", "ISS-1", "family", 4, 1), ("week", "TRD-9", "trend", 3, 2)], "period_id string, item_id string, kind string, events long, shared long")
    lines = [r.line for r in measures.lines(cells, periods, reasons, overlaps).orderBy("position").collect()]
    assert lines == [
        "Period: 2026-10-08 to 2026-10-14 - 7 day(s) counted back from 2026-10-14, the newest dated record here (its date read from event_time).",
        "The period holds 2 distinct event(s) from 3 accepted incident(s) in 3 record(s) filed by 2 publisher(s).", "Places in the period: Madurai (1 event(s)), Melur (1 event(s)).", "Categories here: safety, water.",
        "Open with a quote: 1, action or resolution recorded: 1, no status evidenced: 1, a status stated with no words to quote: 0.", "1 distinct event(s) in these records carry no date, so they fall in no period.",
        "2 dated event(s) fall outside this period and are not counted here.", "Measured increase TRD-9 counts 2 of its 3 event(s) in this period.", "Saved recurring issue ISS-1 counts 1 of its 4 event(s) in this period.",
    ]
    table = reports(spark, [(*ROWS[0][:4], None, *ROWS[0][5:])])
    far = spark.createDataFrame([("june", dt.date(2026, 6, 1), dt.date(2026, 6, 30), 30, "given")], "period_id string, since date, until date, days_back int, window_basis string")
    empty = measures.cube(table, far, {"category": F.array("category")})
    said = lambda **n: [r.reason for r in measures.emptiness(empty, far, **n).collect()]
    assert said(read=0, kept=0) == ["no record was read"] and said(read=3, kept=0) == ["no accepted report matches the filter"]
    assert said(read=1, kept=1) == ["the records read hold 1 event(s) with no date at all and none dated in the period"]
    told = [r.line for r in measures.lines(empty, far, measures.emptiness(empty, far, read=1, kept=1)).orderBy("position").collect()]
    assert told[1] == "Nothing was measured for this period: the records read hold 1 event(s) with no date at all and none dated in the period." and len(told) == 3
    nothing = reports(spark, [])
    open_ended = measures.counted_back(nothing, {"week": 7})
    assert [(r.since, r.until, r.window_basis) for r in open_ended.collect()] == [(None, None, "none")] and measures.cube(nothing, open_ended, {"category": F.array("category")}).count() == 0


def test_reasons_of_reuse_in_their_order(spark):
    job = {"mode": "semantic", "prompt_version": "v1", "input_hash": "h", "prompt_digest": "d"}
    entry = job | {"state": "completed", "schema_version": "c1", "provider": "p", "model": "m"}
    cases = [
        (job, entry, None), (job, None, "absent"), (job, entry | {"state": "failed", "mode": "structured"}, "absent"), (job, entry | {"mode": "structured", "prompt_version": "v0"}, "mode"), (job, entry | {"prompt_version": "v0", "schema_version": "c0"}, "prompt version"),
        (job, entry | {"schema_version": "c0", "input_hash": "x"}, "contract"), (job | {"input_hash": None}, entry, "not fingerprinted"), (job, entry | {"input_hash": "x", "prompt_digest": ""}, "input"), (job | {"mode": "structured"}, entry | {"mode": "structured", "prompt_digest": "", "model": "z"}, None),
        (job, entry | {"prompt_digest": None}, "prompt unknown"), (job, entry | {"prompt_digest": "e", "model": "z"}, "prompt"), (job | {"prompt_digest": ""}, entry | {"prompt_digest": "e"}, None), (job, entry | {"model": "z"}, "reader"), (job, entry | {"model": None, "provider": "q"}, "reader"),
    ]
    names = list(entry)
    jobs = spark.createDataFrame([(str(i), *[j[n] for n in job]) for i, (j, _, _) in enumerate(cases)], "record_id string, " + ", ".join(f"{n} string" for n in job))
    saved = spark.createDataFrame([(str(i), *[e[n] for n in names]) for i, (_, e, _) in enumerate(cases) if e], "record_id string, " + ", ".join(f"{n} string" for n in names))

    def reasons(**more):
        return [r.reason for r in state.reuse_reasons(jobs, saved, schema_version="c1", **more).orderBy(F.col("record_id").cast("int")).collect()]

    assert reasons(candidates=[("p", "m"), ("o", "n")]) == [{"reader": "not a candidate"}.get(w, w) for _, _, w in cases]
    alone = reasons(provider="p", model="m")
    assert alone[:12] == [w for _, _, w in cases][:12] and alone[12:] == ["model", "provider"]
    assert reasons()[12:] == [None, None]


def test_families_with_one_key_need_no_components(spark, monkeypatch):
    from tidemark.operators import families

    rows = [("b", 1, f"e{i}") for i in range(4)] + [("c", 1, f"f{i}") for i in range(3)] + [("d", 1, f"g{i}") for i in range(4)]
    picked = spark.createDataFrame(rows, "bucket_id string, family int, event_id string")
    keys = [(f"e{i}", "k") for i in range(4)] + [("f0", "x"), ("f1", "y")] + [("g0", "p"), ("g1", "p"), ("g1", "q"), ("g2", "q"), ("g3", "z")]
    keyed = lambda n: spark.createDataFrame([k for k in keys if k[0][0] in n], "event_id string, key string")
    got = lambda n: {r.bucket_id: r.parts for r in families._connected(picked.filter(F.col("bucket_id").isin(*n)), keyed("efg")).collect()}
    assert got("bcd") == {"b": 1, "c": 3, "d": 2}
    monkeypatch.setattr(families, "connected_components", None)
    assert got("bc") == {"b": 1, "c": 3}


def test_buckets_of_events_that_say_the_same(spark, monkeypatch):
    """The graph holds one vertex for all events that say the same, and events without a key stay out of it."""
    from tidemark.operators import recurrence

    sent, found = [], recurrence.connections
    monkeypatch.setattr(recurrence, "connections", lambda heads: sent.append(heads.count()) or found(heads))
    event = lambda i, place, kind: (f"e{i:02}", dt.datetime(2026, 1, 1) + dt.timedelta(days=i), [kind] if kind else [], [], [place] if place else [], [])
    rows = [event(i, "Melur", "flood") for i in range(12)] + [event(20, "Melur", None), event(21, None, "fire"), event(22, None, "fire"), event(23, "Usilampatti", "fire")]
    units = spark.createDataFrame(rows, "event_id string, when timestamp, types array<string>, categories array<string>, taluks array<string>, districts array<string>")
    out = recurrence.buckets(units).collect()
    assert [(r.size, r.truncated, r.event_ids) for r in out] == [(12, 4, [f"e{i:02}" for i in range(4, 12)])] and sent == [4]


def test_texts_that_many_rows_have_are_looked_up_once(spark, monkeypatch):
    from tidemark.operators import geo

    seen, found = [], geo.occurrences
    monkeypatch.setattr(geo, "occurrences", lambda texts, *a, **k: seen.append(texts.count()) or found(texts, *a, **k))
    rows = spark.createDataFrame([(i, "in Melur" if i % 2 else "ஊரில்", None, None) for i in range(50)] + [(50, None, None, None)], "id long, text string, lat double, lng double")
    registry = spark.createDataFrame([("M", 9.9, 78.1), ("U", 9.8, 78.2)], "place_id string, lat double, lng double")
    aliases = spark.createDataFrame([("M", "melur", 0), ("U", "ஊர", 1)], "place_id string, alias string, position int")
    got = {r.id: (r.place_id, r.resolution) for r in geo.geocode(rows, registry, aliases, key="id", text="text").collect()}
    assert got == {i: ("M" if i % 2 else "U", "registry") for i in range(50)} | {50: (None, "insufficient")} and seen == [2]
