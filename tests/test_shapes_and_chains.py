"""Schemas of drafts, faults by path, failover over batches, and windows that move with the newest day."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import shapes
from tidemark.operators import assembly, trends
from tidemark.plans.readers import Candidate, Chain, Refused, Unreadable
from tidemark.schema import COMMON_RECORD, INCIDENT
from tidemark.streaming import anchored, commits


@pytest.mark.parametrize("kind", [INCIDENT, COMMON_RECORD, assembly.DRAFT, T.StructType([T.StructField("n", T.LongType(), False), T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.DateType(), False), False), False)])])
def test_types_come_back_from_their_schemas(kind):
    schema = json.loads(json.dumps(shapes.json_schema(kind)))
    assert shapes.data_type(schema) == (kind, False)
    closed = shapes.strict(schema)
    assert "format" not in json.dumps(closed) and shapes.strict(closed) == closed
    assert shapes.data_type(closed)[0].fieldNames() == kind.fieldNames()


def test_schemas_with_references():
    schema = {
        "$defs": {"Place": {"type": "object", "title": "Place", "properties": {"title": {"type": "string", "minLength": 1}, "kind": {"enum": ["a", "b"]}}, "required": ["title"]}},
        "type": "object", "properties": {"place": {"$ref": "#/$defs/Place"}, "n": {"anyOf": [{"type": "integer"}, {"type": "null"}], "default": None}, "many": {"type": "array", "items": {"$ref": "#/$defs/Place"}}}, "required": ["place", "many"],
    }
    place = T.StructType([T.StructField("title", T.StringType(), False), T.StructField("kind", T.StringType(), True)])
    assert shapes.data_type(schema) == (T.StructType([T.StructField("place", place, False), T.StructField("n", T.LongType(), True), T.StructField("many", T.ArrayType(place, False), False)]), False)
    closed = shapes.strict(schema)
    inner = {"type": "object", "properties": {"title": {"type": "string"}, "kind": {"enum": ["a", "b"]}}, "required": ["title", "kind"], "additionalProperties": False}
    assert closed["properties"]["place"] == inner and closed["properties"]["many"]["items"] == inner and closed["required"] == ["place", "n", "many"]
    for torn in ({"$ref": "#/$defs/X", "$defs": {"X": {"type": "array", "items": {"$ref": "#/$defs/X"}}}}, {"type": ["string", "integer"]}, {"type": "file"}, {"anyOf": [{"type": "string"}, {"type": "integer"}]}):
        with pytest.raises(shapes.SchemaError):
            shapes.data_type(torn)
    with pytest.raises(shapes.SchemaError):
        shapes.json_schema(T.BinaryType())


def test_faults_by_path(spark):
    kind = shapes.data_type({"type": "object", "properties": {
        "name": {"type": "string"}, "at": {"type": ["string", "null"], "format": "date-time"}, "n": {"type": ["integer", "null"], "format": "int32"}, "ok": {"type": ["boolean", "null"]}, "x": {"type": ["number", "null"]},
        "places": {"type": ["array", "null"], "items": {"type": "object", "properties": {"text": {"type": "string"}, "tags": {"type": ["array", "null"], "items": {"type": "string"}}}, "required": ["text"]}}, "more": {"type": ["object", "null"], "additionalProperties": {"type": "integer"}},
    }, "required": ["name"]})[0]
    cases = {
        '{"name": "a", "at": "2026-10-14T09:30:00Z", "n": 3, "ok": true, "x": 1.5, "places": [{"text": "p", "tags": ["q"]}], "more": {"k": 7}}': [], '{"name": "a", "n": null, "x": 2}': [],
        "{": [("$", "is no JSON")], "[1]": [("$", "array, not object")], '"x"': [("$", "string, not object")], "{}": [("$.name", "is missing")], '{"name": null}': [("$.name", "is missing")], '{"name": 5}': [("$.name", "number, not string")],
        '{"name": "a", "n": "3"}': [("$.n", "string, not number")], '{"name": "a", "n": 3.5}': [("$.n", "is no int32")], '{"name": "a", "n": 3000000000}': [("$.n", "is no int32")], '{"name": "a", "ok": "true", "x": "1"}': [("$.ok", "string, not boolean"), ("$.x", "string, not number")],
        '{"name": "a", "at": "soon"}': [("$.at", "is no date-time")], '{"name": "a", "b": 1, "a": 2}': [("$.a", "unknown field"), ("$.b", "unknown field")], '{"name": "a", "places": {}}': [("$.places", "object, not array")],
        '{"name": "a", "places": [{"text": "p"}, {"text": 1, "z": 0}, 7, {"tags": ["x", null, 3]}]}': [("$.places[1].z", "unknown field"), ("$.places[1].text", "number, not string"), ("$.places[2]", "number, not object"), ("$.places[3].text", "is missing"), ("$.places[3].tags[1]", "is missing"), ("$.places[3].tags[2]", "number, not string")],
        '{"name": "a", "more": {"k": 1, "l": "2"}}': [("$.more.l", "string, not number")],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = rows.select("i", shapes.read_draft(F.col("t"), kind).alias("r")).orderBy("i").collect()
    assert [[tuple(f) for f in r.r.faults] for r in got] == list(cases.values())
    assert [r.r.draft is not None for r in got] == [not v for v in cases.values()] and got[0].r.draft.places[0].tags == ["q"]
    assert spark.createDataFrame([(None,)], "t string").select(shapes.faults(F.col("t"), kind).alias("f")).first().f[0].fault == "is no JSON"


def test_drafts_round_trip(spark):
    place = {n: None for n in assembly.PLACE_DRAFT.fieldNames()} | {"text": "Melur", "stated": 3, "confidence": 0.5}
    draft = dict.fromkeys(assembly.DRAFT.fieldNames()) | {"record_kind": "incident", "title": {"value": "x", "cited": None, "quote": None, "stated": None, "confidence": 1.0}, "locations": [place]}
    held = spark.createDataFrame([(json.dumps(draft),), (json.dumps(draft | {"locations": [place | {"latitude": 9.9}]}),)], "t string").select(shapes.read_draft(F.col("t"), assembly.DRAFT).alias("r")).collect()
    assert held[0].r.faults == [] and held[0].r.draft.locations[0].text == "Melur" and held[0].r.draft.title.confidence == 1.0
    assert held[1].r.draft is None and [tuple(f) for f in held[1].r.faults] == [("$.locations[0].latitude", "unknown field")]


def rows_of(spark, n, parts=1):
    return spark.range(n).select(F.col("id").alias("k")).coalesce(parts)


def failing(kind, since=0):
    def read(row):
        if row["k"] >= since:
            raise Refused("no\n more", kind=kind)
        return {"verdict": f"early{row['k']}"}

    return read


def answering(row):
    return {"verdict": f"b{row['k']}"}


def outcomes(table):
    return {r.k: (r.state, r.answered_by, r.verdict) for r in table.collect()}


def test_a_refusal_closes_its_scope(spark):
    for kind in ("quota", "rate", "auth", "unreachable"):
        chain = Chain([Candidate("a1", failing(kind), "a"), Candidate("a2", answering, "a"), Candidate("b1", answering, "b")])
        table = chain.read(rows_of(spark, 3), "verdict string", key="k").cache()
        assert outcomes(table) == {i: ("completed", "b1", f"b{i}") for i in range(3)}
        turns = {r.k: r.turns for r in table.collect()}
        assert turns[0] == [f"a1: {kind}: no more", f"skipped a2: {kind}"] and turns[2] == [f"skipped a1: {kind}", f"skipped a2: {kind}"]
        chain.learn(table)
        assert chain.open() == ["b1"] and chain.stop_kind() is None and "a2 at a: closed with its endpoint" in chain.note()


def test_a_model_that_is_not_served_closes_itself_alone(spark):
    chain = Chain([Candidate("a1", failing("model"), "a"), Candidate("a2", answering, "a")])
    table = chain.read(rows_of(spark, 2), "verdict string", key="k").cache()
    assert outcomes(table) == {i: ("completed", "a2", f"b{i}") for i in range(2)}
    chain.learn(table)
    assert chain.open() == ["a2"] and chain.closed == {("reader", "a1", "model")}


def test_errors_pass_the_turn_and_close_nothing(spark):
    def torn(row):
        if row["k"] == 1:
            raise Unreadable("page")
        raise ValueError("no JSON")

    chain = Chain([Candidate("a", torn), Candidate("b", lambda row: None if row["k"] else answering(row))])
    table = chain.read(rows_of(spark, 3), "verdict string", key="k").cache()
    assert outcomes(table) == {0: ("completed", "b", "b0"), 1: ("failed", "a", None), 2: ("failed", None, None)}
    chain.learn(table)
    assert chain.closed == set()


def test_closings_are_carried_to_the_next_batch(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(row):
        calls.add(1)
        raise Refused("spent", kind="quota")

    chain = Chain([Candidate("a", counted, "one account"), Candidate("b", failing("rate", since=20), "another")])
    first = chain.read(rows_of(spark, 8, 4), "verdict string", key="k").cache()
    assert {s for s, _, _ in outcomes(first).values()} == {"completed"} and 1 <= calls.value <= 4
    chain.learn(first)
    asked = calls.value
    second = chain.read(rows_of(spark, 30, 4).filter("k >= 15"), "verdict string", key="k").cache()
    states = {k: s for k, (s, _, _) in outcomes(second).items()}
    assert all(states[k] == "completed" for k in range(15, 20)) and all(states[k] == "deferred" for k in range(20, 30)) and calls.value == asked
    chain.learn(second)
    assert chain.open() == [] and chain.stop_kind() == "quota"
    third = chain.read(rows_of(spark, 2), "verdict string", key="k").collect()
    assert {r.state for r in third} == {"deferred"} and third[0].turns == ["skipped a: quota", "skipped b: rate"]


def test_windows_move_with_the_newest_day(spark, tmp_path):
    rng, base = random.Random(3), dt.datetime(2026, 1, 1)
    rows = [(base + dt.timedelta(days=rng.randrange(160), hours=rng.randrange(24)), rng.choice("ab"), float(rng.randrange(9))) for _ in range(400)] + [(None, "a", 1.0)]
    schema = "event_time timestamp, record_type string, value double"
    rng.shuffle(rows)  # days come late and out of order
    store, t = commits.Store(spark, str(tmp_path / "store")), trends.Trend(recent_days=20, baseline_blocks=4)
    for n in range(3):
        spark.createDataFrame(rows[n * 134 : (n + 1) * 134], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
        stream = spark.readStream.schema(f"{schema}, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        anchored.keep_days(stream, store, checkpoint=str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        seen = spark.createDataFrame(rows[: (n + 1) * 134], schema).filter("event_time IS NOT NULL").withColumn("day", F.to_date("event_time"))
        spans = trends.windows(seen, "day", t)
        want = trends.in_windows(seen, "day", spans).groupBy("k", "since", "until", "record_type").agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("total"))
        got = anchored.anchored(store.table("days", anchored.DAYS.format(key="record_type")), t)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() >= 6
