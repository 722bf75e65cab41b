"""Grounding of quotes, brackets, and sinks."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import wording as W
from tidemark.operators import contracts, grounding, records, replies

NOTE = "Officials said that the pumps will stay until the end of the season."


@pytest.mark.parametrize(
    "fields,citation,want",
    [
        ([("a", NOTE)], "Officials said that all pumps will stay until the end", ("a", 0, 53)),
        ([("a", NOTE), ("b", NOTE)], "Officials said that all pumps will stay until the end", "tied"),
        ([("a", NOTE)], "nothing of this is in the record at all", None),
        ([("a", NOTE)], "Officials", None),
        ([("a", NOTE + " " + NOTE)], "Officials said that all pumps will stay until the end of the season.", None),
    ],
)
def test_bracketed(fields, citation, want):
    assert grounding.bracketed(fields, citation) == want


def test_ground_prefers_the_largest_share_and_refuses_ties(spark):
    rows = [
        (1, [("t", "x"), ("a", "the pump ran"), ("b", "the pump ran all day")], "t", "pump", None),
        (2, [("t", "x"), ("a", "the pump ran"), ("b", "ran the pump")], "t", "pump", None),
        (3, [("t", "pump pump")], "t", "pump", 5),
        (4, [("t", "pump pump")], "t", "pump", 4),
        (5, [("t", "aXbXc")], "t", "X", None),
        (6, [], "t", "X", None),
        (7, [("t", "மழை பெய்தது 😀 மழை")], "t", "😀", None),
    ]
    answers = spark.createDataFrame(rows, "id int, fields array<struct<path:string,text:string>>, cited string, quote string, stated int")
    got = {r.id: (r.code, r.path, r.start, r.end, r.moved) for r in grounding.ground(answers).collect()}
    assert got[1] == (None, "a", 4, 8, True) and got[2][0] == "ambiguous_quote" and got[3] == (None, "t", 5, 9, False)
    assert got[4][0] == got[5][0] == "ambiguous_quote" and got[6][0] == "unknown_field" and got[7][:4] == (None, "t", 12, 13)


def test_prompt_lines_stop_at_the_budget(spark):
    lines = spark.createDataFrame([(1, i, 1, "x" * 30) for i in range(1, 6)] + [(2, 1, None, " ")], "job_id int, line int, page int, text string")
    kept = grounding.prompt_lines(lines, most_chars=130).collect()
    assert [(r.job_id, r.line) for r in kept] == [(1, 1), (1, 2)]


def test_records_are_written_by_source_and_run(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s1", 1), ("b", "s2", 2)], "record_id string, source_id string, v int")
    records.write_records(rows, str(tmp_path / "out"), "r1")
    records.write_records(rows.filter("v = 2").withColumn("v", F.lit(9)), str(tmp_path / "out"), "r1")
    assert sorted((r.record_id, r.v) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 9)]


def test_wording_edges(spark):
    rows = spark.createDataFrame([("Straße  É",), ("é",), ("١٢ and ௩",), (None,)], "t string")
    got = rows.select(W.norm(F.col("t")), W.digit_set(F.col("t"))).collect()
    assert [r[0] for r in got] == ["strasse é", "é", "١٢ and ௩", None] and got[2][1] == ["12", "3"]
    more = spark.createDataFrame([("what rate, more detail",)], "t string")
    assert more.select(records.asks_for_more(F.col("t"), ["more", "detail"])).first()[0]
    assert rows.limit(1).select(contracts.upload_fault(F.lit("a.pdf"), F.lit(1)), replies.window_note(F.lit("none"), F.lit(1), F.lit("x"), F.lit("y"))).first()[0] is None
