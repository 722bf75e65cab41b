"""Queries over map records: resolved places, wide records, features, markers, statistics, boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gis
from .registering import query
from .sources import captures, views
from .sources.views import INCIDENTS_SQL, RECORDS_SQL

def n_rows():
    return F.count(F.lit(1)).alias("n")

#: Rung of the ladder by order key: which coordinates, texts and ids an order's record carries.
RUNGS_SQL = """rungs AS (SELECT o_orderkey AS k, (o_orderkey % 12)::INTEGER AS r FROM orders)"""


def _rungs(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("o_orderkey") % 12
    at = lambda n, v: F.when(r == n, v)
    return views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"),
        at(0, "9.95").when(r == 1, "78.1").when(r == 2, "95").when(r == 3, "north").alias("latitude"),
        at(0, "78.12").when(r == 1, "9.9").when(r == 2, "78.1").when(r == 3, "78.1").alias("longitude"),
        at(4, "sholavandan").alias("canonical_id"),
        at(5, "weather").when(r == 6, "agriculture").when(r.isin(7, 8), "news").otherwise("other").alias("source_type"),
        at(5, "43360").alias("station_id"),
        at(6, "Anaiyur Market").alias("market"),
        at(6, "Madurai").when(r == 7, "near Melur bus stand").when(r == 8, "the Anna-Nagar crossing, anna nagar").when(r == 9, "MADURAI district").when(r == 10, "Vadippatti").alias("raw_text"),
    )


@query("""SELECT k, CASE WHEN r = 0 THEN 'RESOLVED_EXPLICIT' WHEN r IN (1, 2, 3) THEN 'INVALID_SOURCE_COORDINATES' WHEN r IN (4, 5, 6, 8) THEN 'RESOLVED_REGISTRY' WHEN r IN (7, 9, 10) THEN 'UNRESOLVED_AREA_ONLY'
  ELSE 'UNRESOLVED_INSUFFICIENT_DATA' END AS status, CASE r WHEN 0 THEN 9.95 WHEN 4 THEN 10.0219 WHEN 5 THEN 9.8344 WHEN 6 THEN 9.9632 WHEN 8 THEN 9.9179 END::DOUBLE AS lat,
  CASE r WHEN 4 THEN 'Vadipatti' WHEN 5 THEN 'Thiruparankundram' WHEN 6 THEN 'Madurai North' WHEN 8 THEN 'Madurai East' ELSE 'Unassigned' END AS taluk,
  CASE WHEN r = 0 THEN 'source_coordinates' WHEN r IN (4, 6, 8) THEN 'approximate_named_place' WHEN r = 5 THEN 'approximate_weather_station' WHEN r IN (7, 9, 10) THEN 'area_only' ELSE 'unavailable' END AS precision FROM rungs""", RUNGS_SQL)
def geocode_ladder(spark, d):
    c = F.col
    place = gis.resolution(latitude=c("latitude"), longitude=c("longitude"), raw_text=c("raw_text"), source_type=c("source_type"), canonical_id=c("canonical_id"), district=F.lit(None).cast("string"), market=c("market"), station_id=c("station_id"), source_id=F.lit(None).cast("string"))
    return _rungs(spark, d).select("k", place.alias("p")).select("k", "p.status", "p.lat", "p.taluk", "p.precision")


def _common(spark: SparkSession, d: str) -> DataFrame:
    """Common records for the orders' documents: every third is of the weather station, others name a market place."""
    key = F.col("o_orderkey")
    station, market = key % 3 == 0, key % 3 == 1
    data = F.create_map(F.lit("station_id"), F.when(station, "43360"), F.lit("market"), F.when(market, "Chokkikulam"), F.lit("content"), F.col("o_orderpriority"))
    location = F.struct(F.when(key % 3 == 2, "Madurai").alias("raw_text"), F.lit("Madurai").alias("district"), F.lit(None).cast("string").alias("state"))
    return views.table(spark, d, "orders").select(
        key.cast("string").alias("record_id"), F.concat(F.lit("S"), (key % 7).cast("string")).alias("source_id"), F.when(station, "Weather").when(market, "agriculture").otherwise("blog").alias("source_type"),
        F.when(station, "forecast").when(market, "market_price").otherwise("note").alias("record_type"), F.concat(F.lit("Order "), key.cast("string")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_time"),
        location.alias("location"), data.alias("data"), F.when(key % 2 == 0, "High").otherwise("moderate").alias("severity"), F.lit(None).cast("string").alias("status"), F.lit("https://example.org/r").alias("source_url"),
        F.date_format(F.col("o_orderdate"), "yyyy-MM-dd").alias("retrieved_at"), F.lit("raw").alias("raw_reference"),
    )


MAPPED_SQL = """docs AS (SELECT *, record_id::BIGINT AS k, record_kind = 'incident' AS is_incident, coalesce(priority, '') = 'critical' OR weight > 350000 AS given, coalesce(priority, '') = 'critical' AS both_given FROM incidents),
  shown AS (SELECT incident_id AS id, k, record_kind, is_incident, CASE WHEN is_incident AND severity IN ('critical', 'high', 'low') THEN severity END AS severity, CASE WHEN is_incident THEN event_status END AS status,
    CASE k % 3 WHEN 0 THEN 'weather' WHEN 1 THEN 'agriculture' ELSE 'blog' END AS source_type,
    CASE WHEN both_given THEN 'RESOLVED_EXPLICIT' WHEN given THEN 'INVALID_SOURCE_COORDINATES' WHEN k % 3 = 0 THEN 'RESOLVED_REGISTRY' WHEN k % 3 = 1 THEN 'RESOLVED_REGISTRY' ELSE 'UNRESOLVED_INSUFFICIENT_DATA' END AS resolution_status,
    CASE WHEN both_given THEN 'Unassigned' WHEN given THEN 'Unassigned' WHEN k % 3 = 0 THEN 'Thiruparankundram' WHEN k % 3 = 1 THEN 'Madurai North' ELSE 'Unassigned' END AS taluk,
    CASE WHEN severity <> 'low' THEN event_time WHEN event_status = 'ongoing' THEN event_time - INTERVAL 40 DAY END AS stamp, taluk AS raw_location_text, category, review FROM docs)"""


@query("SELECT id, record_kind, severity, status, source_type, resolution_status, taluk, coalesce(strftime(stamp, '%Y-%m-%d'), '') AS date_only, coalesce(strftime(stamp, '%d %b %Y'), '') AS display_date, raw_location_text FROM shown WHERE raw_location_text IS NOT NULL", INCIDENTS_SQL, MAPPED_SQL)
def gis_documents(spark, d):
    rows = gis.document_records(views.incident_documents(spark, d), _common(spark, d)).filter("raw_location_text <> ''")
    return rows.select("id", "record_kind", "severity", "status", "source_type", "resolution_status", "taluk", "date_only", "display_date", "raw_location_text")


@query("""SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 3 WHEN 0 THEN 'weather' WHEN 1 THEN 'agriculture' ELSE 'other' END AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'high' END AS severity,
  CASE o_orderkey % 3 WHEN 0 THEN 9.8344 WHEN 1 THEN 9.9363 END::DOUBLE AS base_lat, CASE o_orderkey % 3 WHEN 2 THEN 'UNRESOLVED_AREA_ONLY' ELSE 'RESOLVED_REGISTRY' END AS resolution_status, o_orderpriority AS summary,
  strftime(o_orderdate, '%d %b %Y') AS display_date FROM orders""")
def gis_contexts(spark, d):
    return gis.context_records(_common(spark, d)).select("id", "category", "severity", "base_lat", "resolution_status", "summary", "display_date")


@query("SELECT o_orderkey::VARCHAR AS record_id FROM orders WHERE o_orderkey % 3 < 2")
def gis_sources(spark, d):
    return gis.map_sources(_common(spark, d)).select("record_id")


@query("""SELECT o_orderkey::VARCHAR AS id, CASE WHEN record_kind = 'incident' THEN incident_id || ' ' || CASE WHEN review = 'accepted' THEN 'accepted' ELSE 'needs_review' END ELSE '' END AS outcomes
  FROM orders LEFT JOIN incidents ON record_id = o_orderkey::VARCHAR""", INCIDENTS_SQL)
def source_outcomes(spark, d):
    rows = gis.outcomes(gis.context_records(_common(spark, d)), views.incident_documents(spark, d))
    return rows.select("id", F.array_join(F.transform("outcomes", lambda o: F.concat_ws(" ", o["incident_id"], o["status"])), "|").alias("outcomes"))


def _map_rows(spark: SparkSession, d: str) -> DataFrame:
    """Incidents and contexts in one table."""
    documents = gis.document_records(views.incident_documents(spark, d), _common(spark, d)).filter("is_incident")
    return documents.unionByName(gis.context_records(_common(spark, d)), allowMissingColumns=True)


BOTH_SQL = """every AS (SELECT is_incident, severity, taluk, resolution_status IN ('RESOLVED_EXPLICIT', 'RESOLVED_REGISTRY') AS there, record_kind, id FROM shown WHERE is_incident UNION ALL
  SELECT false, NULL, CASE o_orderkey % 3 WHEN 0 THEN 'Thiruparankundram' WHEN 1 THEN 'Madurai North' ELSE 'Unassigned' END, o_orderkey % 3 < 2, 'context', o_orderkey::VARCHAR FROM orders)"""


@query("""SELECT count(*) AS map_records, count_if(is_incident) AS incidents, count_if(NOT is_incident) AS common_records, count_if(there) AS map_mapped, count_if(NOT there) AS map_unmapped, count_if(is_incident AND there) AS incident_mapped,
  count_if(is_incident AND NOT there) AS incident_unmapped, count_if(is_incident AND severity = 'high') AS high, count_if(is_incident AND severity = 'medium') AS medium,
  count(DISTINCT taluk) FILTER (is_incident AND there AND taluk <> 'Unassigned') AS active_taluks FROM every""", INCIDENTS_SQL, MAPPED_SQL, BOTH_SQL)
def map_stats(spark, d):
    return gis.map_stats(_map_rows(spark, d))


@query("SELECT record_kind, taluk, count(*) AS n FROM every WHERE NOT there GROUP BY ALL", INCIDENTS_SQL, MAPPED_SQL, BOTH_SQL)
def map_unmapped(spark, d):
    return gis.unmapped(_map_rows(spark, d)).groupBy("record_kind", "taluk").agg(n_rows())


@query("SELECT record_kind || ':' || id AS key, 'Feature' AS type, record_kind || ':' || id AS feature_id, 'Point' AS geometry, taluk FROM every WHERE there", INCIDENTS_SQL, MAPPED_SQL, BOTH_SQL)
def map_markers(spark, d):
    """Records joined to their features; what a feature holds is read back from its JSON."""
    rows = gis.mapped(_map_rows(spark, d))
    joined = gis.markers(rows, gis.feature_rows(rows, ["id", "record_kind", "taluk"]))
    part = lambda path: F.get_json_object("feature", path)
    return joined.select("key", part("$.type").alias("type"), part("$.id").alias("feature_id"), part("$.geometry.type").alias("geometry"), part("$.properties.taluk").alias("taluk"))


@query("""SELECT s_suppkey, 'Feature' AS type, '[' || (78.0 + (s_nationkey // 5) * 0.1)::DOUBLE::VARCHAR || ',' || (9.5 + (s_nationkey % 5) * 0.1)::DOUBLE::VARCHAR || ']' AS coordinates, s_name FROM supplier""")
def feature_contents(spark, d):
    lat, lng = (9.5 + (F.col("s_nationkey") % 5) * 0.1), (78.0 + F.floor(F.col("s_nationkey") / 5) * 0.1)
    rows = views.table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("id"), "s_name", F.lit("context").alias("record_kind"), F.lit(True).alias("is_geocoded"), F.round(lat, 1).alias("display_lat"), F.round(lng, 1).alias("display_lng"))
    part = lambda path: F.get_json_object("feature", path)
    found = gis.feature_rows(rows, ["s_suppkey", "s_name"])
    return found.select(part("$.properties.s_suppkey").cast("long").alias("s_suppkey"), part("$.type").alias("type"), part("$.geometry.coordinates").alias("coordinates"), part("$.properties.s_name").alias("s_name"))


@query("""SELECT n_nationkey AS file, CASE WHEN n_nationkey % 6 <> 1 THEN n_name END AS taluk, CASE n_nationkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'no name' WHEN 2 THEN 'short ring' WHEN 3 THEN 'open ring' WHEN 4 THEN 'outside' ELSE 'geometry type' END AS fault FROM nation""")
def boundary_faults(spark, d):
    k = F.col("n_nationkey") % 6
    ring = F.when(k == 2, "[[78,10],[78.1,10],[78,10]]").when(k == 3, "[[78,10],[78.1,10],[78.1,10.1],[78,10.1]]").when(k == 4, "[[78,10],[80,10],[78.1,10.1],[78,10]]").otherwise("[[78,10],[78.1,10],[78.1,10.1],[78,10]]")
    shape = F.when(k == 5, "LineString").when(F.col("n_nationkey") % 12 == 0, "MultiPolygon").otherwise("Polygon")
    coordinates = F.concat(F.when(shape == "MultiPolygon", "[[").otherwise("["), ring, F.when(shape == "MultiPolygon", "]]").otherwise("]"))
    named = F.when(k == 1, "").otherwise(F.concat(F.lit('"taluk_name": "'), "n_name", F.lit('"')))
    text = F.concat(F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {'), named, F.lit('}, "geometry": {"type": "'), shape, F.lit('", "coordinates": '), coordinates, F.lit("}}]}"))
    return gis.boundary_faults(views.table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), text.alias("text")))


@query("SELECT page_id, 2::INTEGER AS row, 'ws' || (page_id % 7)::VARCHAR || '-Oct' AS day, page_id::DOUBLE AS low, NULL::DOUBLE AS high FROM pages")
def forecast_rows(spark, d):
    """Rows of a forecast table below its heading; cells that are no numbers are null."""
    key = F.col("page_id").cast("string")
    cell = lambda *cs: F.concat(*[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cs])
    body = cell(F.concat(F.lit("ws"), (F.col("page_id") % 7).cast("string"), F.lit("-Oct")), key, F.lit("--"), F.lit("3"), F.lit("4"), F.lit("5"), F.lit("6"))
    other = F.lit("<h3>Past</h3><table><tr><td>9-Sep</td><td>1</td><td>1</td><td>1</td><td>1</td><td>1</td><td>1</td></tr></table>")
    table = F.concat(F.lit("<h3>7 Day Forecast</h3><table><tr><th>x</th></tr><tr>"), cell(*[F.lit("Date")] * 7), F.lit("</tr><tr>"), body, F.lit("</tr></table>"))
    pages = views.table(spark, d, "pages").select("page_id", F.concat("html", other, table).alias("html"))
    return captures.forecast_rows(pages, heading="7 Day Forecast").select("page_id", "row", "day", F.col("values")[0].alias("low"), F.col("values")[1].alias("high"))


@query("SELECT market, commodity, quantity, low, high FROM (SELECT record_id AS market, 'tomato' AS commodity, nullif(value, 0) AS quantity, 10::DOUBLE AS low, NULL::DOUBLE AS high FROM records WHERE value >= 0)", RECORDS_SQL)
def price_payloads(spark, d):
    payload = F.concat(F.lit('{"tomato": {"quantity": "'), F.col("value").cast("string"), F.lit('", "min_price": "10", "max_price": ""}}'))
    rows = captures.price_rows(views.records(spark, d).filter("value >= 0").select(F.col("record_id").alias("market"), payload.alias("payload")))
    return rows.select("market", "commodity", "quantity", F.col("min_price").alias("low"), F.col("max_price").alias("high"))
