"""Incidents assembled from drafts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import assembly, evidence

NOW = dt.datetime(2026, 10, 14, 9, 30)
TITLE = "Flood in Melur"
BODY = "Heavy rain on Monday. The road to Vadipatti was closed by the flood. Officials said repairs are under way. Two shops of Melur were damaged."
RECORD = "record_id string, source_id string, source_type string, source_url string, event_time timestamp, retrieved_at timestamp, district string, state string, fields array<struct<path:string,text:string>>"


def said(value, quote=None, cited="data.content", stated=None, confidence=0.9, **more):
    return {"value": value, "cited": cited, "quote": quote, "stated": stated, "confidence": confidence, **more}


@pytest.fixture(scope="module")
def build(spark):
    def run(drafts, source_type="news", title=TITLE, event_time=NOW):
        fields = [("title", title), ("data.content", BODY), ("data.price", "1,250")]
        records = spark.createDataFrame([(f"r{i}", "s", source_type, "u", event_time, NOW + dt.timedelta(hours=1), "Madurai", "TN", fields) for i in range(len(drafts))], RECORD)
        schema = assembly.T.StructType([assembly.T.StructField("record_id", assembly.S), assembly.T.StructField("draft", assembly.DRAFT)])
        blank = dict.fromkeys(assembly.DRAFT.fieldNames())
        given = spark.createDataFrame([(f"r{i}", blank | d) for i, d in enumerate(drafts)], schema)
        out = assembly.assemble(records, given).cache()
        held = {r.rule: r.documents for rules in (evidence.rules(), evidence.claim_rules()) for r in evidence.violations(out, rules).collect()}
        assert not any(held.values()), held
        return [r for r in out.orderBy("record_id").collect()]

    return run


def issues(row):
    return [(x.code, x.field) for x in row.issues]


FLOOD = {"incident_type": said("Flood", "closed by the flood"), "description": said("The road to Vadipatti was closed by the flood."), "record_kind": "incident", "event_status": said("ongoing", "repairs are under way")}


def test_grounded_incident(build):
    place = {"text": "Vadipatti", "location_type": "taluk", "role": "event_location", "taluk": "Vadipatti", "village": "Nowhere", "cited": "data.content", "quote": "Vadipatti", "confidence": 0.8}
    person = {"text": "Officials", "entity_type": "government_official", "cited": "data.content", "quote": "Officials", "confidence": None}
    row, whole = build([FLOOD | {"locations": [place], "entities": [person]}, FLOOD | {"locations": [place | {"village": None}]}])
    assert (row.record_kind, row.kind_basis, row.incident_type, row.event_status) == ("incident", "event established", "flood", "ongoing")
    assert issues(row) == [("unsupported_claim", "locations[loc-1].village")] and row.review == "review_required"
    assert row.locations[0].taluk == "Vadipatti" and row.locations[0].village is None and row.locations[0].resolution == "pending_gis"
    assert row.entities[0].entity_type == "government_official" and row.entities[0].review == "accepted"
    assert whole.review == "accepted" and whole.issues == []
    spans = {e.evidence_id: e for e in row.evidence}
    for c in row.claims:
        for i in c.evidence_ids:
            e = spans[i]
            assert e.quote is None or (dict([("title", TITLE), ("data.content", BODY)])[e.field][e.char_start : e.char_end] == e.quote)
    assert [c.field for c in row.claims] == ["description", "incident_type", "event_status", "title"]
    assert row.claims[-1].method == "source_metadata" and row.claims[-1].value == TITLE


def test_kinds_by_table(build):
    fact = [{"value": "1250", "cited": "data.price", "quote": "1,250", "confidence": 0.9}]
    drafts = [
        {"description": said("Two shops of Melur were damaged."), "event_status": said("reported", "Officials said")},
        {"description": said("Two shops of Melur were damaged.")},
        {"record_kind": "incident", "context_type": "market_price", "context_facts": fact},
        {"record_kind": "incident", "context_facts": fact},
        {"record_kind": "Forecast", "context_type": "weather_forecast", "context_facts": fact, "severity": said("high", "Heavy rain")},
        {"context_type": "general_information", "context_facts": fact},
        {"context_facts": fact},
        {},
        {"record_kind": "riot", "context_facts": fact},
    ]
    rows = build(drafts)
    assert [(r.record_kind, r.context_type) for r in rows] == [
        ("incident", None), ("unresolved", None), ("context", "market_price"), ("unresolved", None), ("forecast", "weather_forecast"), ("context", "general_information"), ("context", None), ("unresolved", None), ("context", None)
    ]
    assert issues(rows[0]) == [("provider_warning", "incident_type")]
    assert ("provider_warning", "record_kind") in issues(rows[2]) and ("provider_warning", "record_kind") in issues(rows[3])
    forecast = rows[4]
    assert forecast.severity == "unresolved" and ("unsupported_claim", "severity") in issues(forecast)
    assert {c.field: c.review for c in forecast.claims} == {"severity": "review_required", "title": "accepted"}
    assert rows[6].review == "accepted" and rows[6].context_facts[0].value == "1250"
    assert (rows[7].review, rows[7].claims, rows[7].evidence) == ("unresolved", [], [])
    assert issues(rows[8]) == [("invalid_value", "record_kind")]


def test_titles_are_copied_and_priorities_left_out(build):
    rewritten = FLOOD | {"title": said("A great flood", "closed by the flood")}
    quoted = FLOOD | {"title": said(TITLE, TITLE, cited="title")}
    urgent = FLOOD | {"priority": said("high", "never said")}
    rows = build([rewritten, quoted, urgent])
    copied = [c for c in rows[0].claims if c.field == "title"][0]
    assert (copied.value, copied.method, copied.confidence) == (TITLE, "source_metadata", None) and ("unsupported_claim", "title") in issues(rows[0]) and rows[0].review == "review_required"
    own = [c for c in rows[1].claims if c.field == "title"][0]
    assert (own.value, own.method) == (TITLE, "llm") and rows[1].review == "accepted"
    assert rows[2].priority is None and rows[2].review == "accepted" and not [c for c in rows[2].claims if c.field == "priority"]


def test_refused_answers(build):
    drafts = [
        FLOOD | {"category": said("no such thing", "Heavy rain")},
        FLOOD | {"severity": said("high", "never said anywhere")},
        FLOOD | {"department": said("police", "Officials", cited="data.other")},
        FLOOD | {"category": said("water", "on")},
        FLOOD | {"category": said("water", "")},
        FLOOD | {"context_facts": [{"value": "99", "cited": "data.price", "quote": "1,250", "confidence": 0.9}, {"value": "", "cited": "data.price", "quote": "1", "confidence": 0.9}]},
        FLOOD | {"entities": [{"text": f"n{i}", "entity_type": "person", "cited": "data.content", "quote": "Officials", "confidence": 0.9} for i in range(12)]},
    ]
    rows = build(drafts)
    assert [issues(r) for r in rows[:5]] == [[("invalid_value", "category")], [("unsupported_claim", "severity")], [("unknown_field", "department")], [("ambiguous_quote", "category")], [("unsupported_claim", "category")]]
    assert all(r.review == "review_required" and r.record_kind == "incident" for r in rows)
    assert issues(rows[5]) == [("unsupported_claim", "context_facts[fact-1]"), ("unsupported_claim", "context_facts[fact-2]")] and len(rows[5].context_facts) == 1
    assert issues(rows[6]) == [("provider_warning", "entities")] and len(rows[6].entities) == 8 and len(rows[6].evidence) == 5


def test_event_times(build):
    at = lambda value, quote="on Monday", precision="day": FLOOD | {"event_time": said(value, quote, precision=precision)}
    grounded, torn, capture, own = build([at("2026-10-12"), at("last Monday"), at("2026-10-14T10:30:00"), at("2026-10-14T09:30:00", "")])
    assert (grounded.event_time, grounded.event_time_precision, grounded.review) == (dt.datetime(2026, 10, 12), "day", "accepted")
    assert torn.event_time is None and issues(torn) == [("invalid_value", "event_time")]
    assert capture.event_time is None and issues(capture) == [("provider_warning", "event_time")]
    assert own.event_time is None and [c.review for c in own.claims if c.field == "event_time"] == ["unresolved"]  # when the page was published
    (feed,) = build([at("2026-10-14", "")], source_type="weather")
    assert feed.event_time == dt.datetime(2026, 10, 14) and [(c.method, c.review) for c in feed.claims if c.field == "event_time"] == [("source_metadata", "accepted")]


def test_inexact_citations_of_tokens_only(build):
    near = "Officials said that repairs are under way"
    loose, strict = build([FLOOD | {"event_status": said("ongoing", near)}, FLOOD | {"description": said("Officials said the repairs are all under way")}])
    assert [e.quote for e in loose.evidence if e.quote and e.quote.startswith("Officials")] == ["Officials said repairs are under way"]
    assert ("unsupported_claim", "description") in issues(strict)


def test_every_claim_rule_can_fire(spark, build):
    """One change to a sound document breaks one rule."""
    sound = FLOOD | {"severity": said("high", "Heavy rain"), "category": said("water", "closed by")}
    (row,) = build([sound])
    table = spark.createDataFrame([row], assembly_schema(spark))
    drop = lambda n: F.filter("claims", lambda x: x["field"] != n)
    doubt = F.transform("claims", lambda x: x.withField("review", F.when(x["field"] == "severity", "review_required").otherwise(x["review"])))
    broken = {
        "value_without_claim": table.withColumn("claims", drop("severity")), "event_time_without_claim": table.withColumn("event_time", F.current_timestamp()), "accepted_though_flagged": table.withColumn("claims", doubt),
        "unresolved_with_accepted_claim": table.withColumn("review", F.lit("unresolved")), "review_without_reason": table.withColumn("review", F.lit("review_required")), "context_with_happening": table.withColumn("record_kind", F.lit("context")),
        "incident_with_context": table.withColumn("context_type", F.lit("other")), "claimed_twice": table.withColumn("claims", F.concat("claims", F.slice("claims", 1, 1))),
    }
    assert set(broken) == set(evidence.claim_rules())
    for rule, rows in broken.items():
        fired = {r.rule for r in evidence.violations(rows, evidence.claim_rules()).collect() if r.documents}
        assert fired == {rule}, (rule, fired)


def assembly_schema(spark):
    records = spark.createDataFrame([], RECORD)
    drafts = spark.createDataFrame([], assembly.T.StructType([assembly.T.StructField("record_id", assembly.S), assembly.T.StructField("draft", assembly.DRAFT)]))
    return assembly.assemble(records, drafts).schema
