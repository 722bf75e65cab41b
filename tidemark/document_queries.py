"""Queries over nested incident documents, record inserts and the reader without a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import documents as D
from .operators import evidence, filters, linking
from .queries import _market_records
from .registering import query
from .sources import views
from .sources.views import INCIDENTS_SQL, PRICES_SQL, RECORDS_SQL

def n_rows():
    return F.count(F.lit(1)).alias("n")


@query("""SELECT incident_id, incident_type, category, 'unresolved' AS department, severity, priority, event_status, CASE WHEN severity <> 'low' THEN event_time END AS event_time,
  CASE WHEN severity = 'moderate' THEN 'month' ELSE 'day' END AS event_time_precision FROM incidents""", INCIDENTS_SQL)
def incident_shred(spark, d):
    facts = D.shred(views.incident_documents(spark, d))[0]
    rows = facts.select("incident_id", "incident_type", "category", "department", "severity", "priority", "event_status", "event_time", "event_time_precision")
    return rows.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query("""SELECT incident_id, i::INTEGER AS position, 'ev-' || record_id || '-' || (i + 1)::VARCHAR AS evidence_id, CASE i WHEN 0 THEN 'title' ELSE 'data.taluk' END AS field,
  CASE WHEN i = 0 AND NOT (record_kind = 'forecast' AND coalesce(priority, '') = 'critical') THEN category END AS quote FROM incidents, range(2) AS r(i)""", INCIDENTS_SQL)
def incident_evidence(spark, d):
    return D.shred(views.incident_documents(spark, d))[1].select("incident_id", "position", "evidence_id", "field", "quote")


CRITICAL = "coalesce(priority, '') = 'critical'"


@query(f"""SELECT rule, documents::BIGINT AS documents FROM (SELECT unnest([
  {{'rule': 'evidence_without_span', 'documents': count_if(record_kind = 'forecast' AND {CRITICAL})}},
  {{'rule': 'evidence_length', 'documents': count_if(severity = 'unresolved' AND NOT (record_kind = 'forecast' AND {CRITICAL}))}}, {{'rule': 'evidence_repeated', 'documents': 0}},
  {{'rule': 'dangling_reference', 'documents': count_if(weight > 300000)}}, {{'rule': 'claim_without_evidence', 'documents': count_if(severity = 'moderate' AND event_status <> 'under_investigation')}},
  {{'rule': 'claim_without_confidence', 'documents': count_if(priority IS NULL)}}, {{'rule': 'confidence_range', 'documents': 0}},
  {{'rule': 'half_coordinates', 'documents': count_if(weight > 350000 AND NOT {CRITICAL})}}, {{'rule': 'unresolved_coordinates', 'documents': count_if(weight > 350000 AND NOT {CRITICAL})}},
  {{'rule': 'incident_without_type', 'documents': count_if(record_kind = 'incident' AND review = 'accepted' AND incident_type = 'unresolved')}},
  {{'rule': 'context_with_event', 'documents': count_if(record_kind = 'forecast' AND incident_type <> 'unresolved')}},
  {{'rule': 'accepted_with_open_claim', 'documents': count_if(review = 'accepted' AND event_status = 'under_investigation')}}], recursive := true) FROM incidents)""", INCIDENTS_SQL)
def contract_violations(spark, d):
    return evidence.violations(views.incident_documents(spark, d))


@query("""SELECT incident_id, CASE WHEN event_status = 'ongoing' THEN 'duplicate' WHEN priority = 'low' AND category = 'BUILDING' THEN 'failed' ELSE 'stored' END AS outcome FROM incidents""", INCIDENTS_SQL)
def incident_submit(spark, d):
    """Two tries at most: a busy answer is tried again, an error of another kind is final, what is held stays."""
    rows = views.incidents(spark, d)
    busy, bad = F.col("priority") == "high", (F.col("priority") == "low") & (F.col("category") == "BUILDING") & (F.col("event_status") != "ongoing")
    tried = rows.withColumn("first", F.when(busy, 503).when(bad, 422).otherwise(201)).withColumn("second", F.lit(201))
    out = D.submit(tried, rows.filter("event_status = 'ongoing'"), "incident_id", "event_time", ("first", "second"))
    return out.select("incident_id", "outcome")


@query("SELECT source_id, source_id AS name, arg_min(record_type, struct_pack(t := event_time, r := record_id)) AS source_type, 'active' AS status, min(event_time) AS created_at FROM records WHERE source_id NOT IN (SELECT source_id FROM records WHERE record_type = 'signup' AND value > 100) GROUP BY source_id", RECORDS_SQL)
def sources_ensured(spark, d):
    rows = views.records(spark, d).withColumnsRenamed({"record_type": "source_type", "event_time": "created_at"})
    held = rows.filter("source_type = 'signup' AND value > 100").select("source_id").distinct()
    return D.ensure_sources(rows, held).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("SELECT record_id, event_time FROM records ORDER BY event_time DESC NULLS LAST, record_id LIMIT 50", RECORDS_SQL)
def records_newest(spark, d):
    rows = D.newest_first(views.records(spark, d), "event_time", "record_id").limit(50)
    return rows.select("record_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


@query("SELECT incident_id, category, taluk FROM incidents WHERE incident_id = 'INC-000000042'", INCIDENTS_SQL)
def incident_lookup(spark, d):
    return D.lookup(views.incidents(spark, d), "incident_id", "INC-000000042").select("incident_id", "category", "taluk")


@query("SELECT o_orderkey::VARCHAR AS record_id, record_id IS NOT NULL AS found, record_type, source_id FROM (SELECT * FROM orders WHERE o_orderkey % 3 = 0) LEFT JOIN records ON record_id = o_orderkey::VARCHAR", RECORDS_SQL)
def records_looked_up(spark, d):
    """Keys of every third order, asked of the record stream; those that it doesn't hold are told as well."""
    asked = views.table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("record_id"))
    return D.looked_up(views.records(spark, d), asked, "record_id").select("record_id", "found", "record_type", "source_id")


@query("SELECT category, count(*) AS documents, 2 * count(*) AS evidence FROM incidents WHERE NOT (severity = 'low' AND weight > 100000) AND record_id NOT IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_returnflag = 'R') GROUP BY category", INCIDENTS_SQL)
def evidence_of_the_deleted(spark, d):
    """Documents that are deleted take their evidence with them."""
    rows = views.incident_documents(spark, d)
    returned = views.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("INC-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("incident_id"))
    heavy = views.incidents(spark, d).filter("severity = 'low' AND weight > 100000").select("incident_id")
    facts, evidence = D.shred(rows)
    facts, evidence = D.deleted(facts, evidence, heavy.unionByName(returned))
    held = evidence.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"))
    return facts.join(held, "incident_id", "left").groupBy("category").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("evidence"))


@query("SELECT source_id, max(event_time) AS newest, count(*) AS n FROM records GROUP BY source_id ORDER BY newest DESC, source_id LIMIT 20", RECORDS_SQL)
def sources_newest(spark, d):
    rows = views.records(spark, d).groupBy("source_id").agg(F.max("event_time").alias("newest"), n_rows())
    return D.newest_first(rows, "newest", "source_id").limit(20).withColumn("newest", F.col("newest").cast("timestamp_ntz"))


@query("SELECT record_id, record_type FROM records WHERE record_type = 'error' AND value > 50", RECORDS_SQL)
def echo_faults(spark, d):
    sent = views.records(spark, d).select("record_id", "record_type")
    stored = views.records(spark, d).select("record_id", F.when((F.col("record_type") == "error") & (F.col("value") > 50), "changed").otherwise(F.col("record_type")).alias("record_type"))
    return D.echo_faults(sent, stored)


@query("""SELECT record_id AS position, CASE record_id::BIGINT % 5 WHEN 0 THEN 'not an object' WHEN 1 THEN 'unknown keys' WHEN 2 THEN 'version' ELSE 'missing keys' END AS fault,
  CASE record_id::BIGINT % 5 WHEN 1 THEN 'k|z' WHEN 3 THEN 'record_id|source_id' ELSE '' END AS keys FROM records WHERE record_id::BIGINT % 5 < 4""", RECORDS_SQL)
def payload_faults(spark, d):
    which = F.col("record_id").cast("long") % 5
    body = lambda text: F.concat(F.lit("{"), F.lit(text), F.lit("}"))
    strange = F.concat(F.lit('{"z": 1, '), F.substring("data", 2, 1000))
    good = '"schema_version": "2.0", "record_id": "r", "source_id": "s"'
    payload = F.when(which == 0, F.concat(F.lit("["), "data", F.lit("]"))).when(which == 1, strange).when(which == 2, body('"schema_version": "1.0", "record_id": "r", "source_id": "s"'))
    payload = payload.when(which == 3, body('"schema_version": "2.0", "record_id": " "')).otherwise(body(good))
    rows = views.records(spark, d).select(F.col("record_id").alias("position"), payload.alias("payload"))
    return D.payload_faults(rows, required=["record_id", "source_id"], allowed=["schema_version", "record_id", "source_id"], version="2.0")


@query("""SELECT incident_id, kind, context_type, claims, facts, evidence, 'accepted' AS review FROM (SELECT 'INC-MKT-' || replace(upper(market), ' ', '_') || '-' || replace(upper(commodity), ' ', '_') || '-' || price_date::VARCHAR AS incident_id,
  'context' AS kind, 'market' AS context_type, 2::INTEGER AS claims, 'fact-1|fact-2|fact-3|fact-4|fact-5|fact-6' AS facts, 7::INTEGER AS evidence FROM (SELECT DISTINCT market, commodity, price_date FROM prices))""", PRICES_SQL)
def structured_incidents(spark, d):
    rows = D.structured_documents(_market_records(spark, d))
    named = F.array_join(F.array_sort(F.transform("facts", lambda f: f["fact_id"])), "|")
    return rows.select("incident_id", "kind", "context_type", F.size("claims").alias("claims"), named.alias("facts"), F.size("evidence").alias("evidence"), "review")


PLACE_SQL = """said AS (SELECT *, severity <> 'low' AS ok, CASE WHEN event_status <> 'resolved' AND severity <> 'low' AND lower(taluk) <> lower(district) THEN lower(taluk) END AS place,
  CASE WHEN weight > 100000 THEN lower(person) END AS who FROM incidents)"""


@query("""SELECT incident_id, coalesce(place, '') AS places, coalesce(who, '') AS people, CASE WHEN coalesce(priority, '') = 'critical' THEN 'P' || substr(taluk, 8) ELSE '' END AS resolved FROM said""", INCIDENTS_SQL, PLACE_SQL)
def places_and_people(spark, d):
    join = lambda c: F.array_join(c, "|")
    return views.incident_documents(spark, d).select("incident_id", join(D.place_names()).alias("places"), join(D.people()).alias("people"), join(D.resolved_places()).alias("resolved"))


@query("""SELECT kind, count(*) AS n, count(DISTINCT value) AS kinds FROM (SELECT unnest([{'kind': 'type', 'value': CASE WHEN incident_type <> 'unresolved' THEN incident_type END}, {'kind': 'category', 'value': category},
  {'kind': 'place', 'value': place}, {'kind': 'person', 'value': who}], recursive := true) FROM said) WHERE value IS NOT NULL GROUP BY kind""", INCIDENTS_SQL, PLACE_SQL)
def document_signals(spark, d):
    return D.signals(views.incident_documents(spark, d)).groupBy("kind").agg(n_rows(), F.countDistinct("value").alias("kinds"))


@query("""SELECT incident_id, array_to_string(list_sort(list_filter([CASE WHEN ok AND event_status <> 'resolved' THEN 'taluk:' || lower(taluk) END, 'district:' || lower(district)], lambda x: x IS NOT NULL)), '|') AS keys,
  array_to_string(list_sort(list_distinct(list_filter([CASE WHEN ok THEN lower(taluk) END, lower(district)], lambda x: x IS NOT NULL))), '|') AS searchable FROM said""", INCIDENTS_SQL, PLACE_SQL)
def unit_keys(spark, d):
    rows = views.incident_documents(spark, d)
    return rows.select("incident_id", F.array_join(D.unit_keys(), "|").alias("keys"), F.array_join(D.searchable_places(), "|").alias("searchable"))


@query("""SELECT level, name, count(*) AS n FROM (SELECT 'taluk' AS level, lower(taluk) AS name FROM said WHERE ok AND event_status <> 'resolved' UNION ALL
  SELECT 'district', district FROM said WHERE ok AND event_status <> 'resolved' UNION ALL SELECT 'district', lower(district) FROM said) GROUP BY ALL""", INCIDENTS_SQL, PLACE_SQL)
def area_entries(spark, d):
    rows = views.incident_documents(spark, d).select(F.explode(D.area_entries()).alias("a"))
    return rows.groupBy("a.level", "a.name").agg(n_rows())


@query("SELECT incident_id FROM said WHERE ok AND contains(lower(taluk), 'nation_1')", INCIDENTS_SQL, PLACE_SQL)
def holds_place(spark, d):
    return views.incident_documents(spark, d).filter(D.holds_place(F.lit(" Nation_1"))).select("incident_id")


@query("""SELECT incident_id, CASE WHEN weight > 300000 OR (record_kind = 'forecast' AND coalesce(priority, '') = 'critical') THEN '' ELSE category END AS quote,
  CASE WHEN (record_kind = 'forecast' AND coalesce(priority, '') = 'critical') OR (weight > 300000 AND (severity = 'moderate' OR event_status = 'under_investigation') AND weight <= 100000) THEN 0 ELSE 1 END AS shown FROM incidents""", INCIDENTS_SQL)
def quotes_shown(spark, d):
    rows = views.incident_documents(spark, d)
    return rows.select("incident_id", D.quote_for(F.col("claims")[0]["evidence_ids"]).alias("quote"), F.size(D.shown_evidence()).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN n_name END AS taluk, r_name AS district, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'taluk' END AS dropped
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def stated_levels(spark, d):
    rows = views.incidents(spark, d).withColumn("o_orderkey", F.col("record_id").cast("long")).filter("taluk IS NOT NULL")
    text = F.concat_ws(" ", F.lit("Seen in"), F.lower("district"), F.when(F.col("o_orderkey") % 2 == 0, F.col("taluk")))
    out = D.stated_levels(rows.withColumn("text", text), "text")
    return out.select("o_orderkey", "taluk", "district", F.array_join("dropped", "|").alias("dropped"))


@query("""SELECT record_id AS relation_id, 'E-' || record_id AS source_id, CASE record_id::BIGINT % 3 WHEN 0 THEN 'L-' || record_id WHEN 1 THEN 'E-' || record_id END AS target_id,
  CASE record_id::BIGINT % 3 WHEN 1 THEN 'self' WHEN 2 THEN 'unresolved_reference' END AS fault FROM incidents WHERE taluk IS NOT NULL""", INCIDENTS_SQL)
def relation_ends(spark, d):
    rows = views.incidents(spark, d).filter("taluk IS NOT NULL")
    which = F.col("record_id").cast("long") % 3
    target = F.when(which == 0, F.upper("taluk")).when(which == 1, F.col("person")).otherwise("nobody")
    relations = rows.select(F.col("record_id").alias("relation_id"), "record_id", F.concat(F.lit(" "), "person").alias("source"), target.alias("target"))
    name = lambda c, kind, prefix, nth: rows.select("record_id", F.col(c).alias("name"), F.lit(kind).alias("kind"), F.lit(nth).alias("position"), F.concat(F.lit(prefix), "record_id").alias("item_id"))
    names = name("person", "entity", "E-", 0).unionByName(name("taluk", "location", "L-", 0)).unionByName(name("taluk", "location", "M-", 1)).unionByName(name("person", "location", "N-", 2))
    return D.resolve_endpoints(relations, names)


@query("""SELECT incident_id, CASE WHEN severity NOT IN ('moderate', 'low') THEN 'event_time' WHEN event_status = 'ongoing' THEN 'declared' ELSE 'retrieved_at' END AS basis,
  (CASE WHEN severity NOT IN ('moderate', 'low') THEN event_time WHEN event_status = 'ongoing' THEN event_time - INTERVAL 40 DAY ELSE event_time + INTERVAL 1 DAY END)::DATE AS day FROM incidents""", INCIDENTS_SQL)
def effective_days(spark, d):
    rows = views.incident_documents(spark, d).select("incident_id", linking.effective().alias("t"))
    return rows.select("incident_id", "t.basis", F.to_date("t.when").alias("day"))


@query("""SELECT event_status = 'under_investigation' AS open_claim, review, count(*) AS n FROM incidents WHERE review <> 'accepted' OR event_status = 'under_investigation' GROUP BY ALL""", INCIDENTS_SQL)
def needs_review(spark, d):
    rows = views.incident_documents(spark, d).filter(filters.needs_review())
    return rows.groupBy(F.exists("claims", lambda c: c["review"] != "accepted").alias("open_claim"), "review").agg(n_rows())


@query("SELECT incident_id FROM incidents WHERE NOT (record_kind = 'forecast' AND coalesce(priority, '') = 'critical') AND contains(lower(category), 'mach')", INCIDENTS_SQL)
def quote_search(spark, d):
    """Search over what is cited: the quotes of a document's evidence are read too."""
    rows = views.incident_documents(spark, d).withColumn("quotes", filters.quotes())
    return filters.contains_all_text(rows, ["incident_id", "quotes"], "Mach").select("incident_id")
