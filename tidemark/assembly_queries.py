"""Queries of incidents assembled from drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import shapes
from .operators import assembly
from .registering import query
from .sources import views


def _records_and_drafts(spark, d):
    """Documents as records; a draft quotes stretches of its own text, which are blank, repeated or unique as the text has it."""
    rows = views.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    path = lambda name, text: F.struct(F.lit(name).alias("path"), text.alias("text"))
    records = rows.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("record_id"), F.col("source").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, "blog").otherwise("news").alias("source_type"), F.lit("https://example.org/d").alias("source_url"),
        F.lit(None).cast("timestamp").alias("event_time"), F.to_timestamp(F.lit("2026-10-14 09:30:00")).alias("retrieved_at"), F.lit(None).cast("string").alias("district"), F.lit(None).cast("string").alias("state"),
        F.array(path("title", F.substring("text", 1, 30)), path("data.content", F.col("text"))).alias("fields"),
    )
    none = F.lit(None)
    answer = lambda value, quote: F.struct(value.alias("value"), F.lit("data.content").alias("cited"), quote.alias("quote"), none.cast("int").alias("stated"), F.lit(0.9).alias("confidence"))
    given = {
        "description": answer(F.substring("text", 41, 60), none.cast("string")), "incident_type": answer(F.lit("flood"), F.substring("text", 11, 20)), "category": answer(F.lit("water"), F.substring("text", 101, 8)),
        "record_kind": F.when(F.col("doc_id") % 3 == 0, "incident").when(F.col("doc_id") % 3 == 1, "context"),
    }
    draft = F.struct(*[given.get(f.name, none.cast(f.dataType)).alias(f.name) for f in assembly.DRAFT])
    return records, rows.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("record_id"), draft.alias("draft"))


_ONCE = "contains(t, {0}) AND NOT contains(substr(t, strpos(t, {0}) + 1), {0})"
_CODE = "CASE WHEN trim({0}, ' ') = '' THEN 'unsupported_claim' WHEN NOT (" + _ONCE + ") THEN 'ambiguous_quote' END"


@query(
    f"""WITH texts AS (SELECT doc_id, t, substr(t, 1, 30) AS title, substr(t, 41, 60) AS account, substr(t, 11, 20) AS kind_quote, substr(t, 101, 8) AS class_quote FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
  coded AS (SELECT *, {_CODE.format('kind_quote')} AS kind_code, {_CODE.format('class_quote')} AS class_code, {_CODE.format('account')} AS account_code, account <> '' AS has_account FROM texts),
  told AS (SELECT *, kind_code IS NULL AS typed, has_account AND account_code IS NULL AS accounted, CASE doc_id % 3 WHEN 0 THEN 'incident' WHEN 1 THEN 'context' END AS said FROM coded),
  kinds AS (SELECT *, typed OR (accounted AND coalesce(said, '') = 'incident') AS established, typed OR accounted OR class_code IS NULL AS grounded FROM told),
  filed AS (SELECT *, CASE WHEN established THEN 'incident' WHEN said = 'context' THEN 'context' ELSE 'unresolved' END AS record_kind FROM kinds),
  faults AS (SELECT *, list_filter([CASE WHEN has_account AND account_code IS NOT NULL THEN account_code || ':description' END, CASE WHEN kind_code IS NOT NULL THEN kind_code || ':incident_type' END, CASE WHEN class_code IS NOT NULL THEN class_code || ':category' END,
      CASE WHEN record_kind = 'context' AND class_code IS NULL THEN 'unsupported_claim:category' END, CASE WHEN said = 'incident' AND NOT established THEN 'provider_warning:record_kind' END,
      CASE WHEN record_kind = 'incident' AND NOT has_account THEN 'provider_warning:description' END], lambda x: x IS NOT NULL) AS issues FROM filed)
  SELECT 'D' || doc_id AS record_id, record_kind, CASE WHEN established THEN 'event established' WHEN said = 'incident' THEN 'called an incident' WHEN said = 'context' THEN 'as declared' ELSE 'nothing' END AS kind_basis,
    CASE WHEN NOT grounded THEN 'unresolved' WHEN len(issues) > 0 THEN 'review_required' ELSE 'accepted' END AS review, array_to_string(issues, '|') AS issues, CASE WHEN typed THEN 'flood' ELSE 'unresolved' END AS incident_type,
    CASE WHEN class_code IS NULL AND record_kind <> 'context' THEN 'water' ELSE 'unresolved' END AS category, (typed::INTEGER + accounted::INTEGER + (class_code IS NULL)::INTEGER + (grounded AND trim(title, ' ') <> '')::INTEGER)::INTEGER AS evidence
  FROM faults""")
def assembled_incidents(spark, d):
    out = assembly.assemble(*_records_and_drafts(spark, d))
    issues = F.array_join(F.transform("issues", lambda x: F.concat(x["code"], F.lit(":"), x["field"])), "|")
    return out.select("record_id", "record_kind", "kind_basis", "review", issues.alias("issues"), "incident_type", "category", F.size("evidence").alias("evidence"))


@query(f"""SELECT 'D' || doc_id AS record_id, field, path, start::INTEGER AS char_start, start + length(quote) AS char_end, quote FROM (
    SELECT doc_id, t, 'description' AS field, substr(t, 41, 60) AS q FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) UNION ALL SELECT doc_id, t, 'incident_type', substr(t, 11, 20) FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    UNION ALL SELECT doc_id, t, 'category', substr(t, 101, 8) FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) AS x, LATERAL (SELECT q AS quote, 'data.content' AS path, strpos(t, q) - 1 AS start) WHERE trim(q, ' ') <> '' AND {_ONCE.format('q')}""")
def assembled_lineage(spark, d):
    """From each claim to the words that it rests on."""
    out = assembly.assemble(*_records_and_drafts(spark, d))
    claims = out.select("record_id", "evidence", F.explode("claims").alias("c")).select("record_id", "evidence", F.col("c.field").alias("field"), F.explode("c.evidence_ids").alias("id"))
    held = claims.withColumn("e", F.try_element_at(F.filter("evidence", lambda e: e["evidence_id"] == F.col("id")), F.lit(1))).filter("e.quote IS NOT NULL")
    return held.select("record_id", "field", F.col("e.field").alias("path"), "e.char_start", "e.char_end", "e.quote")


DRAFT_KIND = shapes.data_type({
    "type": "object", "required": ["type", "value"],
    "properties": {
        "type": {"type": "string"}, "value": {"type": "number"}, "tags": {"type": ["array", "null"], "items": {"type": "string"}},
        "record": {"type": ["object", "null"], "properties": {"k": {"type": "integer"}}, "required": ["k"]},
    },
})[0]

#: Drafts made of the events' own values; some are written as another type, some have more, some are cut off.
TORN_SQL = """texts AS (SELECT event_id, '{"type": ' || CASE WHEN user_id % 3 = 0 THEN user_id::VARCHAR ELSE '"' || event_type || '"' END || ', "value": ' || CASE WHEN user_id % 5 = 0 THEN '"' || user_id || '"' ELSE user_id::VARCHAR END
    || ', "record": ' || CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '[1, 2.5, "x"]' WHEN 2 THEN replace(props, 'k', 'j') ELSE props END || ', "tags": ["a", ' || CASE WHEN event_id % 4 = 0 THEN user_id::VARCHAR ELSE '"b"' END || ']'
    || CASE WHEN user_id % 7 = 0 THEN ', "extra": 1' ELSE '' END || CASE WHEN event_id % 11 = 0 THEN '' ELSE '}' END AS t FROM events)"""


@query("""SELECT event_id, CASE WHEN NOT json_valid(t) THEN '$ is no JSON' ELSE array_to_string(list_filter([CASE WHEN json_exists(t, '$.extra') THEN '$.extra unknown field' END, CASE WHEN json_type(t, '$.type') <> 'VARCHAR' THEN '$.type number, not string' END,
    CASE WHEN json_type(t, '$.value') = 'VARCHAR' THEN '$.value string, not number' END, CASE WHEN json_type(t, '$.tags[1]') <> 'VARCHAR' THEN '$.tags[1] number, not string' END,
    CASE WHEN json_type(t, '$.record') = 'ARRAY' THEN '$.record array, not object' WHEN json_exists(t, '$.record.j') THEN '$.record.j unknown field|$.record.k is missing' END], lambda x: x IS NOT NULL), '|') END AS faults FROM texts""", TORN_SQL)
def draft_faults(spark, d):
    """What is wrong with each draft, by path."""
    key, user, props = F.col("event_id"), F.col("user_id"), F.col("props")
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    record = F.when(key % 5 == 0, "null").when(key % 5 == 1, '[1, 2.5, "x"]').when(key % 5 == 2, F.replace(props, F.lit("k"), F.lit("j"))).otherwise(props)
    text = F.concat(
        F.lit('{"type": '), F.when(user % 3 == 0, user.cast("string")).otherwise(quoted(F.col("event_type"))), F.lit(', "value": '), F.when(user % 5 == 0, quoted(user)).otherwise(user.cast("string")), F.lit(', "record": '), record,
        F.lit(', "tags": ["a", '), F.when(key % 4 == 0, user.cast("string")).otherwise('"b"'), F.lit("]"), F.when(user % 7 == 0, ', "extra": 1').otherwise(""), F.when(key % 11 == 0, "").otherwise("}"),
    )
    rows = views.table(spark, d, "events").select("event_id", shapes.faults(text, DRAFT_KIND).alias("f"))
    return rows.select("event_id", F.array_join(F.transform("f", lambda x: F.concat_ws(" ", x["path"], x["fault"])), "|").alias("faults"))
