"""Queries over grounding, contracts of answers, and common records in detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as X
from .operators import answers, checks, contracts, filters, grounding, normalize, records, state
from .queries import POOL_SQL, _market_records
from .registering import query
from .sources import captures, views
from .sources.views import INCIDENTS_SQL, PRICES_SQL, RECORDS_SQL


def n_rows():
    return F.count(F.lit(1)).alias("n")


def joined(c):
    return F.array_join(c, "|")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Drafted quotes by order key: verbatim, repeated with and without a place, in another field, bracketed, tied, nowhere."""
    k = F.col("o_orderkey")
    title = F.concat(F.lit("Flood in ward "), k.cast("string"))
    body = F.concat(F.lit("The water rose quickly and then the water fell after the pumps of ward "), k.cast("string"), F.lit(" ran all night."))
    other = F.lit("Officials said that the pumps will stay until the end of the season.")
    fields = F.array(*[F.struct(F.lit(p).alias("path"), t.alias("text")) for p, t in (("title", title), ("data.content", body), ("data.note", other))])
    which = k % 9
    quote = F.when(which == 0, "rose quickly").when(which.isin(1, 2), "water").when(which == 3, "Officials said").when(which == 4, "Officials said that all the pumps will stay until the end").when(which == 5, "nothing of the kind")
    quote = quote.when(which == 6, "").when(which == 7, "pumps").otherwise("rose")
    cited = F.when(which == 7, "title").when(which == 8, "data.none").otherwise("data.content")
    return views.table(spark, d, "orders").select(k, fields.alias("fields"), cited.alias("cited"), quote.alias("quote"), F.when(which == 2, 36).cast("int").alias("stated"))


@query("""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 1 THEN 'ambiguous_quote' WHEN 5 THEN 'unsupported_claim' WHEN 6 THEN 'unsupported_claim' WHEN 8 THEN 'unknown_field' END AS code,
  CASE o_orderkey % 9 WHEN 0 THEN 'data.content' WHEN 2 THEN 'data.content' WHEN 3 THEN 'data.note' WHEN 4 THEN 'data.note' WHEN 7 THEN 'data.note' END AS path,
  (CASE o_orderkey % 9 WHEN 0 THEN 10 WHEN 2 THEN 36 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 7 THEN 24 ELSE -1 END)::INTEGER AS start, (CASE o_orderkey % 9 WHEN 0 THEN 22 WHEN 2 THEN 41 WHEN 3 THEN 14 WHEN 4 THEN 53 WHEN 7 THEN 29 ELSE -1 END)::INTEGER AS stop,
  o_orderkey % 9 IN (3, 4, 7) AS moved FROM orders""")
def grounded_quotes(spark, d):
    rows = grounding.ground(_answers(spark, d), inexact=True)
    return rows.select("o_orderkey", "code", "path", F.coalesce("start", F.lit(-1)).cast("int").alias("start"), F.coalesce("end", F.lit(-1)).cast("int").alias("stop"), "moved")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'out of bounds' WHEN 2 THEN 'other words' ELSE NULL END AS fault,
  CASE WHEN doc_id % 4 IN (0, 3) THEN 'ev-' || doc_id::VARCHAR || '-' || substr(sha256(concat_ws(chr(31), doc_id::VARCHAR, 'data.content', '0', '5', 'llm', substr(text, 1, 5))), 1, 12) END AS evidence_id FROM documents WHERE length(text) >= 6""")
def built_evidence(spark, d):
    k = F.col("doc_id") % 4
    rows = views.table(spark, d, "documents").filter("length(text) >= 6").select(
        "doc_id", F.col("doc_id").cast("string").alias("record_id"), F.lit("data.content").alias("path"), "text", F.when(k == 2, "~").otherwise(F.substring("text", 1, 5)).alias("quote"), F.lit(0).alias("start"), F.when(k == 1, F.length("text") + 1).otherwise(5).alias("end"),
    )
    return grounding.build_evidence(rows).select("doc_id", "fault", "evidence_id")


@query("""SELECT c_nationkey, coalesce(string_agg(DISTINCT k, '|' ORDER BY k) FILTER (k IN ('lat', 'longitude', 'geometry', 'lng')), '') AS dropped, coalesce(string_agg(DISTINCT k, '|' ORDER BY k) FILTER (k NOT IN ('lat', 'longitude', 'geometry', 'lng')), '') AS kept
  FROM (SELECT c_nationkey, (['text', 'lat', 'longitude', 'taluk', 'geometry', 'lng', 'block'])[(c_custkey % 7) + 1] AS k FROM customer WHERE c_acctbal < 500) GROUP BY c_nationkey""")
def gis_keys_dropped(spark, d):
    """Drafted places, one a nation, with the keys that its poorer customers bring."""
    names = _array("text", "lat", "longitude", "taluk", "geometry", "lng", "block")
    keyed = views.table(spark, d, "customer").filter("c_acctbal < 500").select("c_nationkey", F.element_at(names, (F.col("c_custkey") % 7 + 1).cast("int")).alias("k"))
    items = keyed.groupBy("c_nationkey").agg(F.map_from_entries(F.transform(F.collect_set("k"), lambda k: F.struct(k.alias("key"), F.lit("x").alias("value")))).alias("item"))
    rows = items.select("c_nationkey", grounding.without_gis_keys(F.col("item")).alias("g"))
    return rows.select("c_nationkey", joined("g.dropped").alias("dropped"), joined(F.array_sort(F.map_keys("g.item"))).alias("kept"))


@query("""SELECT conv_id AS job_id, count(*) AS rows FROM (SELECT conv_id, sum(length('[line_id=' || turn::VARCHAR || '; page=None] ' || trim(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn) AS chars FROM conversations WHERE trim(text, ' ') <> '') WHERE chars <= 600 GROUP BY conv_id""")
def prompt_lines(spark, d):
    lines = views.table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("line"), F.lit(None).cast("int").alias("page"), "text")
    return grounding.prompt_lines(lines, most_chars=600).groupBy("job_id").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT doc_id AS item_id, doc_id % 3 <> 1 AND trim(regexp_replace(substr(text, 1, 12), '\\s+', ' ', 'g')) <> '' AS accepted FROM documents")
def insight_verdicts(spark, d):
    rows = views.table(spark, d, "documents")
    quote = F.when(F.col("doc_id") % 3 == 1, F.lit("~ never said ~")).otherwise(F.concat(F.lit("  "), F.substring("text", 1, 12)))
    items = rows.select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("job_id"), quote.alias("quote"))
    return grounding.insight_verdicts(items, rows.select(F.col("doc_id").alias("job_id"), "text"))


@query("""SELECT page_id, CASE WHEN size <= 0 THEN 'empty' WHEN size > 10485760 THEN 'too large' WHEN NOT regexp_matches(lower(name), '[.](pdf|tif|tiff)$') THEN 'file type' END AS fault,
  CASE WHEN contains(html, '<table') THEN 'cached' WHEN NOT contains(html, '<p') THEN 'conflict' ELSE 'read' END AS answer
  FROM (SELECT page_id, html, url || (['', '.pdf', '.PDF', '.Tiff', '.doc'])[length(url) % 5 + 1] AS name, (length(html) - 500) * 4000 AS size FROM pages)""")
def uploads_and_jobs(spark, d):
    """Pages as files to be uploaded: their names and sizes are those of the pages, with an ending by the length of the address."""
    endings = _array("", ".pdf", ".PDF", ".Tiff", ".doc")
    rows = views.table(spark, d, "pages").withColumn("name", F.concat("url", F.element_at(endings, (F.length("url") % 5 + 1).cast("int")))).withColumn("size", (F.length("html") - 500) * 4000)
    answer = contracts.job_answer(F.when(F.contains("html", F.lit("<p")), "SUCCEEDED").otherwise("IN_PROGRESS"), F.contains("html", F.lit("<table")))
    return rows.select("page_id", contracts.upload_fault(F.col("name"), F.col("size")).alias("fault"), answer.alias("answer"))


def _array(*values: str):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


BRIEF_FAULTS = {"period upside down": 0, "anchor": 1, "events are counted": 2, "shown over counted": 3, "truncated": 4, "foreign event": 5, "foreign evidence": 6, "foreign quotation": 7, "unprinted item": 8, "invented number": 9, "days out of range": 10, "unknown basis": 11}


@query("SELECT rule, count_if(o_orderkey % 14 IN (k, k2)) AS rows FROM orders, (VALUES " + ", ".join(f"('{r}', {k}, {k2})" for r, k, k2 in [*[(r, k, {"anchor": 0, "truncated": 2, "days out of range": -1}.get(r, -1)) for r, k in BRIEF_FAULTS.items()], ("counted days without basis", 11, -1), *[(r, -1, -1) for r in ("open period", "named without start", "nothing counted")]]) + ") AS t(rule, k, k2) GROUP BY rule")
def briefing_contract(spark, d):
    """Briefings with one fault each, by order key."""
    k, day = F.col("o_orderkey") % 14, F.to_date("o_orderdate")
    at = lambda n, value, other: F.when(k == n, value).otherwise(other)
    rows = views.table(spark, d, "orders").select(
        at(10, 999, 7).alias("days_back"), F.date_sub(day, 6).alias("since"), F.when(k == 0, F.date_sub(day, 9)).otherwise(day).alias("until"), at(11, "guess", "record").alias("window_basis"), F.when(k == 1, F.date_sub(day, 1)).otherwise(day).alias("anchor"),
        at(2, 3, 2).alias("events"), _array("e1", "e2").alias("event_ids"), at(3, 4, 2).alias("shown_events"), F.when(k == 3, -2).when(k == 4, 7).otherwise(0).alias("truncated_events"), F.lit("told").alias("state"), at(5, _array("e9"), _array("e1")).alias("item_events"),
        at(6, _array("q9"), _array("q1")).alias("item_evidence"), _array("q1").alias("quotation_evidence"), at(7, _array("e9"), _array("e2")).alias("quotation_events"), at(8, _array("ISS-9"), _array("ISS-1")).alias("named_items"), _array("ISS-1").alias("item_ids"),
        at(9, _array("77 events"), _array("2 events")).alias("lines"), _array("2 events were counted").alias("numbers"),
    )
    return checks.violations(rows, contracts.briefing_rules())


# Common records in detail.
@query("SELECT CASE WHEN value < 10 THEN 'min: null' WHEN value < 20 THEN 'min: empty' WHEN value < 30 THEN 'min: not a scalar' ELSE '' END || CASE WHEN value < 30 THEN '|' ELSE '' END || 'max: missing' AS notes, 'extra' AS unused, count(*) AS n FROM events GROUP BY ALL")
def field_notes(spark, d):
    value = F.col("value")
    low = F.when(value < 10, F.lit(None).cast("string")).when(value < 20, " ").when(value < 30, "[1]").otherwise("3.5")
    rows = views.records(spark, d).select("record_id", "value", F.create_map(F.lit("min"), low, F.lit("extra"), F.lit("x")).alias("data"))
    return records.field_notes(rows, ["min", "max"]).groupBy(joined("notes").alias("notes"), joined("unused").alias("unused")).agg(n_rows())


@query("SELECT slot, count(*) AS n, count(DISTINCT evidence_id) AS ids FROM (SELECT 'raw_text' AS slot, 'ev-' || r || '-' || substr(sha256(concat_ws(chr(31), r, 'location.raw_text', 'source_metadata')), 1, 12) AS evidence_id FROM (SELECT DISTINCT 'MKT-' || replace(upper(market), ' ', '_') || '-' || replace(upper(commodity), ' ', '_') || '-' || price_date::VARCHAR AS r FROM prices)) GROUP BY slot", PRICES_SQL)
def source_geography(spark, d):
    return records.source_geography(_market_records(spark, d)).groupBy("slot").agg(n_rows(), F.countDistinct("evidence_id").alias("ids"))


@query("SELECT source_type, record_type, count(*) AS n, min(declared) AS first_declared FROM (SELECT DISTINCT market, commodity, price_date, 'agriculture' AS source_type, 'market_price' AS record_type, price_date AS declared FROM prices) GROUP BY ALL", PRICES_SQL)
def provenance_kinds(spark, d):
    rows = records.provenance(_market_records(spark, d))
    return rows.groupBy("provenance.source_type", "provenance.record_type").agg(n_rows(), F.to_date(F.min("provenance.declared_event_time")).alias("first_declared"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS nowhere, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS shown, (value > 50)::VARCHAR AS flag FROM events")
def paths_and_scalars(spark, d):
    rows = views.table(spark, d, "events").withColumn("flag", F.col("value") > 50)
    return rows.select("event_id", records.at_path(F.col("props"), "k").alias("k"), records.at_path(F.col("props"), "k.deep").alias("nowhere"), records.scalar_text(rows, "ts").alias("shown"), records.scalar_text(rows, "flag").alias("flag"))


@query("SELECT incident_id AS record_id, taluk AS raw_text, district FROM incidents", INCIDENTS_SQL)
def nested_locations(spark, d):
    rows = views.incidents(spark, d).select(F.col("incident_id").alias("record_id"), F.col("taluk").alias("location_raw_text"), F.col("district").alias("location_district"), F.lit(None).cast("string").alias("location_state"))
    return records.nested_location(rows).select("record_id", "location.raw_text", "location.district")


@query("SELECT n_nationkey::VARCHAR AS district_id, s_suppkey::VARCHAR AS market_id, s_name AS market FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def market_lists(spark, d):
    one = F.concat(F.lit('[{"id": "'), F.col("s_suppkey").cast("string"), F.lit('", "name": " '), "s_name", F.lit('"}, {"name": "no id"}]'))
    return records.market_list(views.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("district_id"), one.alias("payload")))


@query("SELECT CASE WHEN value > 80 THEN 'bad' ELSE 'good' END AS part, count(*) AS n, CASE WHEN value > 80 THEN CASE WHEN record_type = 'error' THEN 'too large|an error' ELSE 'too large' END ELSE '' END AS faults FROM records WHERE value > 80 OR record_type <> 'error' GROUP BY ALL UNION ALL SELECT 'bad', count(*), 'an error' FROM records WHERE value <= 80 AND record_type = 'error' HAVING count(*) > 0", RECORDS_SQL)
def corpus_split(spark, d):
    rules = {"too large": F.col("value") > 80, "an error": F.col("record_type") == "error"}
    good, bad = records.good_and_bad(views.records(spark, d), rules)
    parts = good.select(F.lit("good").alias("part"), F.lit("").alias("faults")).unionByName(bad.select(F.lit("bad").alias("part"), joined("faults").alias("faults")))
    return parts.groupBy("part", "faults").agg(n_rows())


@query("""SELECT incident_id, CASE WHEN priority IS NOT NULL THEN 'price' ELSE '' END AS names, row_number() OVER (ORDER BY event_time DESC, incident_id DESC) AS place FROM pool WHERE category = 'BUILDING' QUALIFY place <= 10""", POOL_SQL)
def eligible_values(spark, d):
    rows = views.incidents(spark, d).filter("record_kind = 'incident' AND review = 'accepted' AND category = 'BUILDING'")
    fact = lambda field, value, review: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(review).alias("review"), F.array(F.lit("e1")).alias("evidence_ids"))
    facts = F.array(fact("data.price", F.when(F.col("priority").isNotNull(), "5").otherwise(" "), "accepted"), fact("data.market_id", F.lit("9"), "accepted"), fact("data.note", F.lit("x"), "review_required"))
    rows = rows.withColumn("facts", facts).withColumn("record_kind", F.lit("context")).withColumn("context_type", F.lit("market_price"))
    found = records.eligible_values(rows, "market").limit(10)
    place = F.rank().over(Window.orderBy(F.desc("event_time"), F.desc("incident_id"))).cast("long")
    return found.select("incident_id", joined(F.array_sort(F.map_keys(records.quotable_facts(F.col("facts"), F.array(F.lit("e1")))))).alias("names"), place.alias("place"))


@query("SELECT conv_id AS question_id, 'category' AS field, 'building' AS words, count(DISTINCT incident_id) AS ids FROM incidents, (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0) WHERE category = 'BUILDING' GROUP BY conv_id", INCIDENTS_SQL)
def named_fields(spark, d):
    index = views.incidents(spark, d).select(F.lit("category").alias("field"), F.col("category").alias("word"), F.col("incident_id").alias("id"))
    asked = views.table(spark, d, "conversations").select(F.col("conv_id").alias("question_id")).distinct()
    text = F.when(F.col("question_id") % 2 == 0, "What of the Building, today?").otherwise("And buildings?")
    return records.named_fields(index, asked.withColumn("text", text)).withColumn("words", joined("words"))


@query("SELECT conv_id AS question_id, CASE conv_id % 4 WHEN 0 THEN 'no record of the place' WHEN 1 THEN 'no record holds the value' WHEN 2 THEN 'no single record holds all' END AS refusal FROM (SELECT DISTINCT conv_id FROM conversations)")
def value_refusals(spark, d):
    asked = views.table(spark, d, "conversations").select(F.col("conv_id").alias("question_id")).distinct()
    k = F.col("question_id") % 4
    found = asked.select("question_id", (k == 0).alias("place_named"), F.lit(0).alias("in_place"), (k == 1).alias("asked_word"), F.when(k >= 2, 2).otherwise(0).alias("fields"), F.when(k == 3, 4).otherwise(0).alias("matches"))
    return records.refusals(asked, found)


@query("SELECT incident_id AS event_id, incident_id, 'ev-' || record_id || '-1' AS evidence_id, category AS quote, 'https://example.org/' || record_id AS source_url FROM incidents WHERE NOT (record_kind = 'forecast' AND coalesce(priority, '') = 'critical')", INCIDENTS_SQL)
def citation_rows(spark, d):
    rows = views.incident_documents(spark, d)
    evidence = rows.select("incident_id", F.explode("evidence").alias("e")).select("incident_id", "e.evidence_id", "e.quote")
    return records.citation_rows(rows.select(F.col("incident_id").alias("event_id"), "incident_id", "source_url"), evidence)


@query("SELECT category AS item_id, count(*) AS events, count(*) FILTER (priority = 'critical') AS evidence FROM pool WHERE event_time >= DATE '2000-01-01' GROUP BY category", POOL_SQL)
def item_refs(spark, d):
    pool = filters.accepted_pool(views.incidents(spark, d)).withColumn("evidence_id", F.concat(F.lit("ev-"), "incident_id")).withColumn("event_id", F.col("incident_id"))
    period = pool.filter("event_time >= DATE '2000-01-01'")
    return records.item_refs(pool.select(F.col("category").alias("item_id"), "event_id", "evidence_id"), period, pool.filter("priority = 'critical'"))


@query("""SELECT i::INTEGER AS position, CASE i WHEN 0 THEN 'Period: ' || since::VARCHAR || ' to ' || until::VARCHAR || '.' WHEN 1 THEN 'The period holds ' || events::VARCHAR || ' distinct event(s) in ' || areas::VARCHAR || ' place(s) from ' || sources::VARCHAR || ' publisher(s).'
  WHEN 2 THEN 'Open: ' || open_events::VARCHAR || '.' ELSE outside::VARCHAR || ' dated event(s) fall outside this period and are not counted here.' END AS line
  FROM (SELECT count_if(i) AS events, count_if(i AND event_status = 'ongoing') AS open_events, count(DISTINCT taluk) FILTER (i) AS areas, count(DISTINCT source_id) FILTER (i) AS sources, count_if(NOT i) AS outside, (max(event_time)::DATE - 29)::DATE AS since, max(event_time)::DATE AS until
    FROM (SELECT *, event_time::DATE > (SELECT max(event_time)::DATE FROM pool) - 30 AS i FROM pool)), range(4) AS r(i)""", POOL_SQL)
def measured_lines(spark, d):
    return records.measured_lines(answers.measure(filters.accepted_pool(views.incidents(spark, d)), "event_time", 30))


@query("SELECT CASE WHEN record_type = 'error' THEN 'kept_awaiting' ELSE 'settled' END AS mark, CASE WHEN record_type = 'error' THEN count(*)::VARCHAR || ' record(s) stay: they are awaited.' ELSE count(*)::VARCHAR || ' record(s) settled: they arrived before the cut.' END AS line FROM (SELECT CASE WHEN record_type = 'error' THEN 'error' ELSE 'x' END AS record_type FROM records) GROUP BY record_type", RECORDS_SQL)
def baseline_report(spark, d):
    mark = F.when(F.col("record_type") == "error", "kept_awaiting").otherwise("settled")
    return records.baseline_lines(views.records(spark, d).groupBy(mark.alias("mark")).agg(n_rows()))


@query("SELECT count(*) AS total, count_if(review = 'accepted') AS accepted, count_if(severity = 'low') AS with_findings FROM incidents", INCIDENTS_SQL)
def report_counts(spark, d):
    found = F.when(F.col("severity") == "low", F.array(F.lit("f"))).otherwise(F.array().cast("array<string>"))
    return records.report_counts(views.incidents(spark, d).withColumn("findings", found), "review")


@query("SELECT conv_id AS job_id, count_if(role = 'user' AND trim(text, ' ') <> '') AS lines, count_if(role <> 'user') AS pages, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user' AND text <> ''), '')) AS digest FROM conversations GROUP BY conv_id")
def ocr_lines(spark, d):
    kind = F.when(F.col("role") == "user", "LINE").otherwise("PAGE")
    rows = views.table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("page_number"), F.array(F.struct(kind.alias("type"), F.col("text").alias("text"))).alias("blocks"))
    return captures.ocr_lines(rows).select("job_id", "lines", "pages", F.sha2("text", 256).alias("digest"))


@query("SELECT 'WX-' || strftime(ts, '%d-%b') AS record_id, 'forecast' AS record_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL")
def forecast_records(spark, d):
    rows = views.table(spark, d, "events").select(F.lit("station").alias("station"), F.date_format("ts", "dd-MMM").alias("forecast_date"), F.create_map(F.lit("max_temp_c"), F.col("value").cast("string")).alias("measures"))
    out = normalize.forecasts(rows, prefix="WX-", source="weather", year=F.lit(2024))
    return out.groupBy("record_id", "record_type", F.to_date("event_time").alias("day")).agg(n_rows())


@query("SELECT location_type, count(*) AS n FROM (SELECT DISTINCT market, commodity, price_date FROM prices), (VALUES ('unknown')) AS t(location_type) GROUP BY location_type", PRICES_SQL)
def source_places(spark, d):
    return normalize.source_places(_market_records(spark, d)).groupBy("location_type").agg(n_rows())


@query("SELECT event_id, rtrim(rtrim(printf('%.2f', value), '0'), '.') || ' °C' AS temp, rtrim(rtrim(printf('%.2f', value), '0'), '.') || ' %' AS humid, rtrim(rtrim(printf('%.2f', value), '0'), '.') || ' /kg' AS price, 4::INTEGER AS shown FROM events")
def shown_entries(spark, d):
    number = F.regexp_replace(F.format_string("%.2f", "value"), r"\.?0+$", "")
    data = F.create_map(*[x for k, v in (("max_temp_c", number), ("humidity", number), ("min_price", number), ("unit", F.lit("kg")), ("language", F.lit("ta")), ("note", F.lit(""))) for x in (F.lit(k), v)])
    rows = views.table(spark, d, "events").select("event_id", normalize.display_entries(data).alias("m"))
    return rows.select("event_id", F.col("m")["max_temp_c"].alias("temp"), F.col("m")["humidity"].alias("humid"), F.col("m")["min_price"].alias("price"), F.size("m").alias("shown"))


@query("SELECT n_nationkey, 'Bus stand ' || n_name || ', ' || r_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey WHERE NOT contains(lower('Bus stand ' || n_name), lower(r_name))")
def distinct_parts(spark, d):
    rows = views.table(spark, d, "nation").join(views.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.filter(~F.contains(F.lower(F.concat(F.lit("Bus stand "), "n_name")), F.lower("r_name")))
    parts = F.array(F.concat(F.lit("Bus stand "), "n_name"), F.lower("n_name"), F.col("r_name"), F.lit(None).cast("string"), F.lit(" "))
    return rows.select("n_nationkey", normalize.distinct_parts(parts).alias("place"))


@query("""SELECT doc_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE '' END AS fault, CASE WHEN n >= 2 THEN '' ELSE 'out_of_range' END AS second FROM (SELECT doc_id, len(list_filter(range(0, length(text) - 2), lambda i: substr(text, i + 1, 3) = 'ere')) AS n FROM documents WHERE length(text) >= 3) WHERE n > 0""")
def located_spans(spark, d):
    rows = views.table(spark, d, "documents").filter("length(text) >= 3").withColumn("spans", X.find_spans(F.col("text"), F.lit("ere"))).filter("size(spans) > 0")
    fault = lambda n: F.coalesce(X.locate(F.col("spans"), F.lit(3), n)["fault"], F.lit(""))
    return rows.select("doc_id", fault(None).alias("fault"), fault(1).alias("second"))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'day' END AS precision, count(*) AS n FROM events GROUP BY ALL")
def declared_precisions(spark, d):
    shown = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return views.table(spark, d, "events").groupBy(X.date_precision(shown).alias("precision")).agg(n_rows())


@query("SELECT record_type, count(*) AS n, count_if(record_id::BIGINT % 2 = 0) AS fresh FROM records GROUP BY record_type", RECORDS_SQL)
def store_merged(spark, d):
    old = views.records(spark, d).select("record_id", "record_type", F.lit(False).alias("new"))
    out = state.merged(old, old.filter(F.col("record_id").cast("long") % 2 == 0).withColumn("new", F.lit(True)), ["record_id"])
    return out.groupBy("record_type").agg(n_rows(), F.count_if("new").alias("fresh"))
