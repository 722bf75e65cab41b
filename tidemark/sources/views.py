"""The analytic tables seen as the data model: orders as incidents, events as the record stream, lineitem as price facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_rank(values: list[str | None], default: str | None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for digit, value in zip("1235", values, strict=True):
        out = out.when(F.substring("o_orderpriority", 1, 1) == digit, F.lit(value))
    return out.otherwise(F.lit(default).cast("string"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat incidents with the columns of :data:`tidemark.schema.INCIDENT` that the analytic operators read."""
    orders = table(spark, sf_dir, "orders")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = orders.join(people, F.col("o_custkey") == F.col("c_custkey"), "left").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    kind = F.lower(F.substring("o_orderpriority", 3, 20))
    return rows.select(
        F.concat(F.lit("INC-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("incident_id"),
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.concat(F.lit("SRC-"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.when(F.col("o_orderstatus") == "P", "forecast").otherwise("incident").alias("record_kind"),
        F.when(F.col("o_totalprice") < 50000, "review_required").otherwise("accepted").alias("review"),
        F.when(kind == "not specified", "unresolved").otherwise(kind).alias("incident_type"),
        F.col("c_mktsegment").alias("category"),
        _by_rank(["critical", "high", "moderate", "low"], "unresolved").alias("severity"),
        _by_rank(["critical", "high", "medium", "low"], None).alias("priority"),
        F.when(F.col("o_orderstatus") == "O", "ongoing").when(F.col("o_orderstatus") == "P", "under_investigation").otherwise("resolved").alias("event_status"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.col("n_name").alias("taluk"),
        F.col("r_name").alias("district"),
        F.col("c_name").alias("person"),
        F.col("o_totalprice").alias("weight"),
    )


def incident_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents as nested documents (:data:`tidemark.schema.INCIDENT`): two places, a person, two claims and two pieces of
    evidence each. Some break the contract on purpose: a quote is missing, a reference dangles, a coordinate is given too early.
    """
    c, none = F.col, F.lit(None)
    row = incidents(spark, sf_dir)
    cited, meta = F.concat(F.lit("ev-"), "record_id", F.lit("-1")), F.concat(F.lit("ev-"), "record_id", F.lit("-2"))
    settled = F.coalesce(c("priority") == "critical", F.lit(False))
    known = F.when(settled, F.concat(F.lit("P"), F.substring("taluk", 8, 9)))
    state = F.when(settled, "resolved").otherwise("pending_gis")

    def place(kind: str, name: str, role, review, canonical, latitude, longitude, resolution):
        fields = {"text": c(name), "normalized_name": F.lower(name), "location_type": F.lit(kind), "role": role, "district": c("district"), "taluk": c("taluk") if kind == "taluk" else none.cast("string")}
        fields |= {"block": none.cast("string"), "village": none.cast("string"), "review": review, "latitude": latitude, "longitude": longitude, "resolution": resolution, "canonical_id": canonical, "evidence_ids": F.array(meta)}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    early = c("weight") > 350000
    taluk = place(
        "taluk", "taluk", F.when(c("event_status") == "resolved", "mentioned_only").otherwise("event_location"), F.when(c("severity") == "low", "review_required").otherwise("accepted"),
        known, F.when(settled | early, F.lit(9.9)), F.when(settled, F.lit(78.1)), state,
    )
    district = place("district", "district", F.lit("event_container"), F.lit("accepted"), none.cast("string"), none.cast("double"), none.cast("double"), F.lit("pending_gis"))
    person = F.struct(c("person").alias("text"), F.lower("person").alias("normalized_name"), F.lit("person").alias("entity_type"), F.when(c("weight") > 100000, "accepted").otherwise("review_required").alias("review"), F.array(cited).alias("evidence_ids"))
    reference = F.when(c("weight") > 300000, F.lit("ev-none")).otherwise(cited)
    confidence = F.when(c("priority").isNotNull(), F.lit(0.9))
    claim = lambda field, value, review, ids: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit("llm").alias("method"), confidence.alias("confidence"), review.alias("review"), ids.alias("evidence_ids"))
    claims = F.array(
        claim("incident_type", c("incident_type"), F.lit("accepted"), F.array(reference)),
        claim("event_status", c("event_status"), F.when(c("event_status") == "under_investigation", "review_required").otherwise("accepted"), F.when(c("severity") == "moderate", F.array().cast("array<string>")).otherwise(F.array(cited))),
    )
    quote = F.when(~((c("record_kind") == "forecast") & settled), c("category"))
    evidence = lambda key, field, method, text, size: F.struct(key.alias("evidence_id"), c("record_id"), F.lit(field).alias("field"), F.lit(method).alias("method"), text.alias("quote"), F.when(size.isNotNull(), F.lit(0)).alias("char_start"), size.alias("char_end"), F.when(size.isNotNull(), F.sha2(c("category"), 256)).alias("text_hash"))
    size = F.length("category") + F.when(c("severity") == "unresolved", 1).otherwise(0)
    stamp = c("event_time")
    return row.select(
        "incident_id", "record_id", "source_id", F.concat(F.lit("https://example.org/"), "record_id").alias("source_url"), "record_kind", "review", "incident_type", "category", none.cast("string").alias("department"),
        "severity", "priority", "event_status", F.when(c("severity") != "low", stamp).alias("event_time"), F.when(c("severity") == "moderate", "month").otherwise("day").alias("event_time_precision"),
        F.when(c("event_status") == "ongoing", stamp - F.expr("INTERVAL 40 DAYS")).alias("declared_event_time"), (stamp + F.expr("INTERVAL 1 DAY")).alias("retrieved_at"), c("district").alias("district_hint"), none.cast("string").alias("state_hint"),
        F.array(taluk, district).alias("locations"), F.array(person).alias("entities"), claims.alias("claims"),
        F.array(evidence(cited, "title", "llm", quote, size), evidence(meta, "data.taluk", "source_metadata", none.cast("string"), none.cast("int"))).alias("evidence"),
    )


#: The flat view of incidents for DuckDB.
INCIDENTS_SQL = """
incidents AS (
  SELECT 'INC-' || lpad(o_orderkey::VARCHAR, 9, '0') AS incident_id, o_orderkey::VARCHAR AS record_id, 'SRC-' || o_custkey::VARCHAR AS source_id,
    CASE WHEN o_orderstatus = 'P' THEN 'forecast' ELSE 'incident' END AS record_kind,
    CASE WHEN o_totalprice < 50000 THEN 'review_required' ELSE 'accepted' END AS review,
    CASE WHEN lower(substr(o_orderpriority, 3)) = 'not specified' THEN 'unresolved' ELSE lower(substr(o_orderpriority, 3)) END AS incident_type,
    c_mktsegment AS category,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'moderate' WHEN '5' THEN 'low' ELSE 'unresolved' END AS severity,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '5' THEN 'low' END AS priority,
    CASE o_orderstatus WHEN 'O' THEN 'ongoing' WHEN 'P' THEN 'under_investigation' ELSE 'resolved' END AS event_status,
    o_orderdate AS event_time, n_name AS taluk, r_name AS district, c_name AS person, o_totalprice AS weight
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record stream: ``record_id, source_id, record_type, event_time, day, data, value``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("record_id"), F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("source_id"), F.col("event_type").alias("record_type"),
        F.col("ts").cast("timestamp").alias("event_time"), F.to_date("ts").alias("day"), F.col("props").alias("data"), "value",
    )


RECORDS_SQL = """
records AS (
  SELECT event_id::VARCHAR AS record_id, 'U-' || user_id::VARCHAR AS source_id, event_type AS record_type, ts AS event_time, ts::DATE AS day, props AS data, value FROM events)
"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market price facts: ``market, commodity, price_date, quantity, min_price, max_price``."""
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    rows = item.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return rows.select(F.col("s_name").alias("market"), F.col("p_type").alias("commodity"), F.to_date("l_shipdate").alias("price_date"), F.col("l_quantity").alias("quantity"), (price * (1 - F.col("l_discount"))).alias("min_price"), price.alias("max_price"))


PRICES_SQL = """
prices AS (
  SELECT s_name AS market, p_type AS commodity, l_shipdate::DATE AS price_date, l_quantity AS quantity,
    l_extendedprice / l_quantity * (1 - l_discount) AS min_price, l_extendedprice / l_quantity AS max_price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
"""
