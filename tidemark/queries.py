"""Registered queries over the analytic tables, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .functions import text as X
from .functions.ids import article_id
from .operators import answers, checks, documents, evidence, filters, geo, linking, normalize, records, recurrence, state, trends
from .plans import passes
from .registering import query
from .sources import captures, views
from .sources.views import INCIDENTS_SQL, PRICES_SQL, RECORDS_SQL
from .storage import materialize
from .streaming import windows as streams

def rows_n():
    return F.count(F.lit(1))


TREND = trends.Trend(recent_days=30, baseline_blocks=3)
POOL_SQL = INCIDENTS_SQL + ", pool AS (SELECT * FROM incidents WHERE record_kind = 'incident' AND review = 'accepted')"


@query("SELECT incident_id, category, district, event_time::DATE AS day FROM incidents WHERE category = 'MACHINERY' AND lower(district) LIKE '%asia%' AND event_time >= DATE '1996-01-01' AND event_time < DATE '1997-01-01'", INCIDENTS_SQL)
def incidents_filtered(spark, d):
    keep = filters.Filters(category="MACHINERY", place="asia", since=dt.date(1996, 1, 1), until=dt.date(1996, 12, 31))
    return views.incidents(spark, d).filter(keep.keeps(places=F.array("district"))).select("incident_id", "category", "district", F.to_date("event_time").alias("day"))


@query("SELECT priority, count(*) AS n FROM incidents WHERE priority IN ('high', 'critical') AND severity IN ('high', 'critical') GROUP BY priority", INCIDENTS_SQL)
def filters_min_priority(spark, d):
    return views.incidents(spark, d).filter(filters.Filters(min_priority="high", min_severity="high").keeps()).groupBy("priority").agg(rows_n().alias("n"))


@query("SELECT category, count(*) AS n, count(DISTINCT source_id) AS sources FROM pool GROUP BY category", POOL_SQL)
def accepted_pool(spark, d):
    return filters.accepted_pool(views.incidents(spark, d)).groupBy("category").agg(rows_n().alias("n"), F.countDistinct("source_id").alias("sources"))


@query("SELECT CASE WHEN event_status <> 'resolved' THEN 'event_time' WHEN severity <> 'unresolved' THEN 'declared' ELSE 'retrieved_at' END AS basis, strftime(event_time, '%Y-%m') AS month, count(*) AS n FROM incidents GROUP BY ALL", INCIDENTS_SQL)
def event_time_basis(spark, d):
    t = F.col("event_time")
    precision = F.when(F.col("event_status") == "resolved", "month").otherwise("day")
    at = X.effective_time(t, precision, F.when(F.col("severity") != "unresolved", t), t)
    return views.incidents(spark, d).select(at.alias("t")).groupBy(F.col("t.basis").alias("basis"), F.date_format("t.when", "yyyy-MM").alias("month")).agg(rows_n().alias("n"))


RANK_SQL = "CASE {0} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"
SEVERE_SQL = "coalesce(CASE severity WHEN 'info' THEN 1 WHEN 'low' THEN 2 WHEN 'moderate' THEN 3 WHEN 'high' THEN 4 WHEN 'critical' THEN 5 END, 0)"


@query(f"SELECT incident_id, coalesce({RANK_SQL.format('priority')}, {SEVERE_SQL}) AS attention_rank FROM incidents ORDER BY attention_rank DESC, {SEVERE_SQL} DESC, event_time DESC NULLS LAST, incident_id LIMIT 20", INCIDENTS_SQL)
def attention_top(spark, d):
    return filters.attention(views.incidents(spark, d)).select("incident_id", "attention_rank").limit(20)


@query("SELECT record_type, record_id, event_time FROM records QUALIFY row_number() OVER (PARTITION BY record_type ORDER BY event_time DESC NULLS LAST, record_id DESC) = 1", RECORDS_SQL)
def latest_per_source(spark, d):
    rows = filters.latest_per(views.records(spark, d), "record_type", "event_time", "record_id")
    return rows.select("record_type", "record_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


@query("SELECT 'category' AS facet, category AS value, count(*) AS n FROM incidents GROUP BY category UNION ALL SELECT 'taluk', taluk, count(*) FROM incidents WHERE taluk <> '' GROUP BY taluk UNION ALL SELECT 'priority', priority, count(*) FROM incidents WHERE priority <> '' GROUP BY priority", INCIDENTS_SQL)
def facet_values(spark, d):
    return filters.facets(views.incidents(spark, d), ["category", "taluk", "priority"])


@query("SELECT category, event_status, count(*) AS n FROM incidents GROUP BY ALL", INCIDENTS_SQL)
def category_status_histogram(spark, d):
    return views.incidents(spark, d).groupBy("category", "event_status").agg(rows_n().alias("n"))


@query("SELECT count(*) AS total, count_if(coalesce(priority IN ('critical', 'high'), false) OR coalesce(severity IN ('critical', 'high'), false)) AS high_priority, count_if(review <> 'accepted') AS needs_review, count(DISTINCT source_id) AS sources FROM incidents", INCIDENTS_SQL)
def dashboard_kpis(spark, d):
    return views.incidents(spark, d).agg(rows_n().alias("total"), F.count_if(filters.high_priority()).alias("high_priority"), F.count_if(F.col("review") != "accepted").alias("needs_review"), F.countDistinct("source_id").alias("sources"))


@query("SELECT source_id, count(*) AS refs, count(DISTINCT category) AS categories, min(event_time)::DATE AS first_day FROM incidents GROUP BY source_id", INCIDENTS_SQL)
def source_index(spark, d):
    return views.incidents(spark, d).groupBy("source_id").agg(rows_n().alias("refs"), F.countDistinct("category").alias("categories"), F.to_date(F.min("event_time")).alias("first_day"))


@query("SELECT incident_id, category FROM incidents ORDER BY event_time DESC NULLS LAST, incident_id LIMIT 10 OFFSET 20", INCIDENTS_SQL)
def page_slice(spark, d):
    rows = views.incidents(spark, d).orderBy(F.desc_nulls_last("event_time"), "incident_id").select("incident_id", "category")
    return filters.page(rows, 3)


@query("SELECT count(*) AS n FROM incidents WHERE contains(lower(concat_ws(' ', incident_id, category, taluk, district)), 'nation_7')", INCIDENTS_SQL)
def text_search(spark, d):
    return filters.contains_all_text(views.incidents(spark, d), ["incident_id", "category", "taluk", "district"], "Nation_7").agg(rows_n().alias("n"))


@query("SELECT category, strftime(event_time, '%Y-%m') AS month, count(*) AS events FROM pool GROUP BY ALL", POOL_SQL)
def monthly_distribution(spark, d):
    return recurrence.monthly(filters.accepted_pool(views.incidents(spark, d)), ["category"], "event_time")


@query(
    """SELECT taluk, dated, days, count_if(late) AS recent_events, count_if(NOT late) AS previous_events, count_if(late) AS recent_incidents, count_if(NOT late) AS previous_incidents,
  count_if(late) - count_if(NOT late) AS change, NULL::VARCHAR AS reason FROM (SELECT pool.taluk, dated, days, event_time >= lo + to_days(days // 2) AS late FROM pool JOIN span ON pool.taluk = span.taluk) GROUP BY ALL""",
    POOL_SQL,
    "span AS (SELECT taluk, min(event_time) AS lo, count(*) AS dated, (date_diff('second', min(event_time), max(event_time)) // 86400)::INTEGER AS days FROM pool GROUP BY taluk)",
)
def half_period_change(spark, d):
    rows = recurrence.half_period(filters.accepted_pool(views.incidents(spark, d)), "taluk", "event_time")
    return rows.withColumn("days", F.col("days").cast("int"))


WINDOWS_SQL = """spans AS (SELECT k, (hi - (29 + k * 30)::INTEGER)::DATE AS since, (hi - (k * 30)::INTEGER)::DATE AS until FROM (
  SELECT max(event_time)::DATE AS hi, least(3, date_diff('day', min(event_time)::DATE, (max(event_time)::DATE - 29)::DATE) // 30) AS usable FROM pool), range(0, 4) AS r(k) WHERE k <= usable AND usable >= 2)"""
POOLED_SQL = "cover AS (SELECT k, since, until, count(DISTINCT record_id) AS pool_records, count(DISTINCT source_id) AS pool_sources FROM spans LEFT JOIN incidents ON event_time::DATE BETWEEN since AND until GROUP BY ALL)"
GROUPED_SQL = """g AS (SELECT incident_id, record_id, source_id, event_time::DATE AS day, unnest([{'d': 'category', 'v': lower(category)}, {'d': 'incident_type', 'v': lower(incident_type)}, {'d': 'place', 'v': lower('taluk:' || taluk)}], recursive := true) FROM pool),
  block AS (SELECT d AS dimension, v AS value, k, count(DISTINCT incident_id) AS events, count(DISTINCT incident_id) AS incidents, count(DISTINCT record_id) AS records, count(DISTINCT source_id) AS sources, list(DISTINCT source_id) AS ids FROM g JOIN spans ON day BETWEEN since AND until WHERE v IS NOT NULL GROUP BY ALL)"""
ARITH_SQL = """one AS (SELECT max(k) AS usable, max(pool_records) FILTER (k = 0) AS pool_0, sum(pool_records) FILTER (k > 0) AS pool_base, count(*) FILTER (k > 0 AND pool_records > 0) AS pooled, count_if(pool_records = 0) AS empty_windows FROM cover),
  s AS (SELECT dimension, value, coalesce(sum(events) FILTER (b.k = 0), 0) AS e0, coalesce(sum(incidents) FILTER (b.k = 0), 0) AS i0, coalesce(sum(events) FILTER (b.k > 0), 0) AS eb, coalesce(sum(incidents) FILTER (b.k > 0), 0) AS ib,
    coalesce(max(events) FILTER (b.k > 0), 0) AS baseline_max, coalesce(sum(events / pool_records) FILTER (b.k > 0 AND pool_records > 0), 0) AS shares, flatten(list(ids) FILTER (b.k = 0)) AS nowl, coalesce(flatten(list(ids) FILTER (b.k > 0)), []) AS thenl
    FROM block AS b JOIN cover ON b.k = cover.k GROUP BY ALL),
  arith AS (SELECT dimension, value, e0::BIGINT AS recent_events, i0::BIGINT AS recent_incidents, round_even((eb / usable)::DOUBLE, 4) AS baseline_mean, baseline_max, round_even((pool_base / usable)::DOUBLE, 4) AS pool_mean,
    round_even((e0 - eb / usable)::DOUBLE, 4) AS change, CASE WHEN eb > 0 THEN round_even((e0 / (eb / usable))::DOUBLE, 4) END AS ratio, round_even((i0 / e0)::DOUBLE, 4) AS per_event_recent, CASE WHEN eb > 0 THEN round_even((ib / eb)::DOUBLE, 4) ELSE 0 END AS per_event_baseline,
    round_even((e0 / pool_0)::DOUBLE, 4) AS share_recent, round_even((shares / pooled)::DOUBLE, 4) AS share_baseline, CASE WHEN shares > 0 THEN round_even((e0 / pool_0 / (shares / pooled))::DOUBLE, 4) END AS share_ratio,
    empty_windows, len(list_filter(list_distinct(nowl), lambda x: NOT list_contains(thenl, x))) AS new_sources FROM s, one WHERE e0 >= 3 AND (eb = 0 OR e0 > eb / usable)),
  found AS (SELECT *, array_to_string(list_filter([CASE WHEN empty_windows > 0 THEN 'empty_window' END, CASE WHEN baseline_mean = 0 THEN 'zero_baseline' END, CASE WHEN baseline_mean > 0 AND ratio < 2 THEN 'low_ratio' END, CASE WHEN recent_events < 3 THEN 'few_events' END,
    CASE WHEN share_baseline > 0 AND share_ratio < 2 THEN 'coverage' END, CASE WHEN per_event_baseline > 0 AND per_event_recent >= 1.5 * per_event_baseline THEN 'reports_per_event' END, CASE WHEN new_sources > 0 AND baseline_mean > 0 THEN 'new_sources' END], lambda x: x IS NOT NULL), '|') AS findings FROM arith)"""
TREND_CTES = (POOL_SQL, WINDOWS_SQL, POOLED_SQL, GROUPED_SQL, ARITH_SQL)


def _trend_parts(spark, d):
    every = views.incidents(spark, d).withColumn("day", F.to_date("event_time"))
    pool = filters.accepted_pool(every)
    spans = trends.windows(pool, "day", TREND)
    rows = pool.select(F.col("incident_id").alias("event_id"), "incident_id", "record_id", "source_id", "day", "category", "incident_type", "taluk")
    grouped = trends.dimensions(rows, {"category": F.array("category"), "incident_type": F.array("incident_type"), "place": F.array(F.concat(F.lit("taluk:"), "taluk"))})
    return every, spans, grouped


@query("SELECT k::INTEGER AS k, since, until FROM spans", *TREND_CTES[:2])
def trend_windows(spark, d):
    return _trend_parts(spark, d)[1]


@query("SELECT k::INTEGER AS k, since, until, pool_records, pool_sources FROM cover", *TREND_CTES[:3])
def trend_coverage(spark, d):
    every, spans, _ = _trend_parts(spark, d)
    return trends.coverage(every, "day", spans)


@query("SELECT d AS dimension, v AS value, count(DISTINCT incident_id) AS events FROM g WHERE v IS NOT NULL GROUP BY ALL", *TREND_CTES[:4])
def dimension_groups(spark, d):
    return _trend_parts(spark, d)[2].groupBy("dimension", "value").agg(F.countDistinct("event_id").alias("events"))


@query("SELECT dimension, value, k::INTEGER AS k, events, incidents, records, sources FROM block", *TREND_CTES[:4])
def trend_blocks(spark, d):
    _, spans, grouped = _trend_parts(spark, d)
    return trends.blocks(grouped, "day", spans)


def _arithmetic(spark, d):
    every, spans, grouped = _trend_parts(spark, d)
    return trends.arithmetic(trends.blocks(grouped, "day", spans), trends.coverage(every, "day", spans), TREND, trends.new_sources(grouped, "day", spans))


@query("SELECT * FROM arith", *TREND_CTES)
def trend_arithmetic(spark, d):
    return _arithmetic(spark, d)


@query("SELECT dimension, value, findings, findings = '' AS alert_eligible FROM found", *TREND_CTES)
def trend_findings(spark, d):
    return trends.findings(_arithmetic(spark, d), TREND).select("dimension", "value", F.array_join("findings", "|").alias("findings"), "alert_eligible")


@query("SELECT dimension, value, ratio, recent_events, findings FROM found ORDER BY coalesce(ratio, 0) DESC, recent_events DESC, dimension, value LIMIT 6", *TREND_CTES)
def trend_rank(spark, d):
    ranked = trends.ranked(trends.findings(_arithmetic(spark, d), TREND))
    return ranked.limit(6).select("dimension", "value", "ratio", "recent_events", F.array_join("findings", "|").alias("findings"))


@query(
    """SELECT count_if(k = 0) AS recent, count_if(k = 1) AS before, count_if(k = 0) - count_if(k = 1) AS change,
  coalesce((SELECT string_agg(taluk, '|' ORDER BY taluk) FROM (SELECT taluk FROM p WHERE k = 0 EXCEPT SELECT taluk FROM p WHERE k = 1)), '') AS new_areas,
  coalesce((SELECT string_agg(taluk, '|' ORDER BY taluk) FROM (SELECT taluk FROM p WHERE k = 1 EXCEPT SELECT taluk FROM p WHERE k = 0)), '') AS gone_areas FROM p""",
    POOL_SQL,
    "p AS (SELECT taluk, date_diff('day', event_time::DATE, (SELECT max(event_time)::DATE FROM pool)) // 5 AS k FROM pool)",
)
def period_compare(spark, d):
    return trends.compare(filters.accepted_pool(views.incidents(spark, d)), "event_time", 5, "taluk")


@query("SELECT CASE WHEN event_status IN ('ongoing', 'under_investigation') THEN 'open' ELSE 'recorded' END AS state, count(*) AS events FROM incidents GROUP BY ALL", INCIDENTS_SQL)
def status_split(spark, d):
    return answers.status_split(views.incidents(spark, d))


@query("""SELECT count_if(i) AS events, count_if(i AND event_status = 'ongoing') AS open_events, count(DISTINCT taluk) FILTER (i) AS areas, count(DISTINCT source_id) FILTER (i) AS sources, 0::BIGINT AS undated, count_if(NOT i) AS dated_outside,
  (max(event_time)::DATE - 29)::DATE AS since, max(event_time)::DATE AS until FROM (SELECT *, event_time::DATE > (SELECT max(event_time)::DATE FROM pool) - 30 AS i FROM pool)""", POOL_SQL)
def briefing_measure(spark, d):
    return passes.briefing_pass(views.incidents(spark, d), 30)[0]


PAIRS_SQL = """sig AS (SELECT incident_id AS id, record_id AS rec, epoch(event_time)::BIGINT AS t, unnest([{'kind': 'type', 'value': CASE WHEN incident_type NOT IN ('unresolved', 'other', 'unknown') THEN incident_type END}, {'kind': 'category', 'value': category}, {'kind': 'place', 'value': taluk}, {'kind': 'person', 'value': person}], recursive := true) FROM pool),
  pr AS (SELECT a.id AS a, b.id AS b, count(*) AS n, any_value(abs(a.t - b.t)) AS gap, 'LNK-' || substr(sha256(a.id || '|' || b.id), 1, 16) AS link FROM sig AS a JOIN sig AS b ON a.kind = b.kind AND a.value = b.value AND a.id < b.id AND a.rec <> b.rec AND abs(a.t - b.t) <= 604800 GROUP BY a.id, b.id),
  ends AS (SELECT a AS e, * FROM pr UNION ALL SELECT b AS e, * FROM pr),
  best AS (SELECT DISTINCT a, b, n, gap, link FROM (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY e ORDER BY n DESC, gap, link) <= 5))"""


@query("SELECT a AS low_id, b AS high_id, n AS shared, gap AS gap_seconds, link AS link_id FROM best", POOL_SQL, PAIRS_SQL)
def candidate_pairs(spark, d):
    return linking.candidate_pairs(linking.signals(filters.accepted_pool(views.incidents(spark, d))))


def _links(spark, d):
    pool = materialize(filters.accepted_pool(views.incidents(spark, d)))  # read for signals, both sides and events
    pairs = linking.candidate_pairs(linking.signals(pool))
    side = lambda n: pool.select(F.col("incident_id").alias(f"{n}_id"), F.struct("event_time", "incident_type", "taluk").alias(n))
    return pool, pairs.join(side("low"), "low_id").join(side("high"), "high_id").withColumn("conflicts", linking.conflicts("low", "high"))


CONFLICT_SQL = """drafts AS (SELECT best.*, array_to_string(list_filter([CASE WHEN x.event_time::DATE <> y.event_time::DATE THEN 'day' END, CASE WHEN x.taluk <> y.taluk THEN 'place' END,
  CASE WHEN x.incident_type <> y.incident_type AND x.incident_type <> 'unresolved' AND y.incident_type <> 'unresolved' THEN 'type' END], lambda v: v IS NOT NULL), '|') AS conflicts FROM best JOIN pool AS x ON a = x.incident_id JOIN pool AS y ON b = y.incident_id)"""


@query("SELECT link AS link_id, conflicts FROM drafts", POOL_SQL, PAIRS_SQL, CONFLICT_SQL)
def pair_conflicts(spark, d):
    return _links(spark, d)[1].select("link_id", F.array_join("conflicts", "|").alias("conflicts"))


@query("""SELECT link AS link_id, array_to_string(list_sort(list_filter(['category ' || x.category, CASE WHEN x.incident_type <> 'unresolved' THEN 'type ' || x.incident_type END, 'place ' || x.taluk], lambda v: list_contains(['category ' || y.category, CASE WHEN y.incident_type <> 'unresolved' THEN 'type ' || y.incident_type END, 'place ' || y.taluk], v))), '|') AS shared,
  coalesce(x.category = y.category, false) OR coalesce(x.incident_type = y.incident_type AND x.incident_type <> 'unresolved', false) AS problem FROM best JOIN pool AS x ON a = x.incident_id JOIN pool AS y ON b = y.incident_id""", POOL_SQL, PAIRS_SQL)
def pair_signals(spark, d):
    """What the two reports of a pair share in words, and whether that is a problem of one kind."""
    pool, links = _links(spark, d)
    kind = F.when(X.known(F.col("incident_type")), F.col("incident_type"))
    said = F.array_compact(F.array(F.concat(F.lit("category "), "category"), F.concat(F.lit("type "), kind), F.concat(F.lit("place "), "taluk")))
    side = lambda n: pool.select(F.col("incident_id").alias(f"{n}_id"), F.struct(said.alias("signals"), F.array_compact(F.array(kind)).alias("types"), F.array_compact(F.array("category")).alias("categories")).alias(n))
    rows = links.select("link_id", "low_id", "high_id").join(side("low"), "low_id").join(side("high"), "high_id")
    return rows.select("link_id", F.array_join(documents.shared_signals(F.col("low.signals"), F.col("high.signals")), "|").alias("shared"), records.shares_problem("low", "high").alias("problem"))


def _groups(spark, d):
    """The scripted reader links pairs that share two signals and don't differ in place."""
    pool, links = _links(spark, d)
    same = (F.col("shared") >= 2) & ~F.array_contains("conflicts", "place")
    read = links.withColumn("verdict", F.when(same, "same_event").otherwise("undetermined"))
    read = read.withColumn("conflicts", F.array().cast("array<string>")).withColumn("confidence", F.lit(0.9)).withColumn("quotes_low", F.lit(1)).withColumn("quotes_high", F.lit(1))
    return pool, linking.event_groups(pool, linking.decide(read))


COMPONENT_SQL = """edge AS (SELECT a, b FROM drafts WHERE n >= 2 AND conflicts NOT LIKE '%place%' UNION SELECT b, a FROM drafts WHERE n >= 2 AND conflicts NOT LIKE '%place%'),
  reach(v, w) AS (SELECT incident_id, incident_id FROM pool UNION SELECT v, edge.b FROM reach JOIN edge ON w = edge.a),
  root AS (SELECT v, min(w) AS root FROM reach GROUP BY v),
  ev AS (SELECT root, 'EVT-' || substr(sha256(string_agg(v, '|' ORDER BY v)), 1, 16) AS event_id, count(*) AS size FROM root GROUP BY root)"""


@query("SELECT v AS incident_id, root.root, event_id, size, 'accepted' AS review FROM root JOIN ev ON root.root = ev.root", POOL_SQL, PAIRS_SQL, CONFLICT_SQL, COMPONENT_SQL, recursive=True)
def event_components(spark, d):
    return _groups(spark, d)[1]


@query("""SELECT event_id, min(event_time)::DATE AS day, count(*) AS incidents, coalesce(string_agg(DISTINCT category, '|' ORDER BY category), '') AS categories, coalesce(string_agg(DISTINCT taluk, '|' ORDER BY taluk), '') AS taluks
  FROM pool JOIN root ON incident_id = v JOIN ev ON root.root = ev.root GROUP BY event_id""", POOL_SQL, PAIRS_SQL, CONFLICT_SQL, COMPONENT_SQL, recursive=True)
def event_units(spark, d):
    units = linking.event_units(*_groups(spark, d))
    return units.select("event_id", F.to_date("when").alias("day"), "incidents", F.array_join("categories", "|").alias("categories"), F.array_join("taluks", "|").alias("taluks"))


def _single_units(spark, d):
    pool = filters.accepted_pool(views.incidents(spark, d))
    return pool.select(F.col("incident_id").alias("event_id"), F.col("event_time").alias("when"), F.array_compact(F.array(F.when(X.known(F.col("incident_type")), F.col("incident_type")))).alias("types"), F.array("category").alias("categories"), F.array("taluk").alias("taluks"), F.array("district").alias("districts"))


BUCKET_SQL = """k AS (SELECT incident_id AS e, event_time AS t, unnest(['taluk:' || lower(taluk), 'district:' || lower(district)]) AS place, incident_type, category FROM pool),
  kp AS (SELECT DISTINCT e, t, 'P' || place || '/' || problem AS key FROM k, unnest(list_filter([CASE WHEN incident_type <> 'unresolved' THEN 'type:' || incident_type END, 'category:' || category], lambda x: x IS NOT NULL)) AS u(problem)),
  pairs AS (SELECT min(e) OVER (PARTITION BY key) AS x, e AS y FROM kp),
  lbl AS (SELECT e, min(x) AS l1 FROM (SELECT y AS e, x FROM pairs UNION ALL SELECT x, y FROM pairs) GROUP BY e),
  hop AS (SELECT DISTINCT a.l1 AS x, b.l1 AS y FROM pairs JOIN lbl AS a ON pairs.x = a.e JOIN lbl AS b ON pairs.y = b.e),
  both_hop AS (SELECT x, y FROM hop UNION SELECT y, x FROM hop),
  rr(v, w) AS (SELECT DISTINCT x, x FROM both_hop UNION SELECT v, y FROM rr JOIN both_hop ON w = x),
  top AS (SELECT v, min(w) AS root FROM rr GROUP BY v),
  member AS (SELECT DISTINCT kp.e, kp.t, root FROM kp JOIN lbl ON kp.e = lbl.e JOIN top ON lbl.l1 = top.v)"""


@query(
    """SELECT 'BKT-' || substr(sha256(string_agg(e, '|' ORDER BY e)), 1, 16) AS bucket_id, max(size) AS size, greatest(max(size) - 8, 0) AS truncated, string_agg(e, '|' ORDER BY e) AS event_ids FROM (
  SELECT *, row_number() OVER (PARTITION BY root ORDER BY t DESC NULLS LAST, e DESC) AS n, count(*) OVER (PARTITION BY root) AS size FROM member) WHERE n <= 8 AND size >= 2 GROUP BY root""",
    POOL_SQL,
    BUCKET_SQL,
    recursive=True,
)
def recurrence_buckets(spark, d):
    return recurrence.buckets(_single_units(spark, d)).withColumn("event_ids", F.array_join("event_ids", "|"))


@query("SELECT category AS family, count(DISTINCT level || name) AS areas, 'taluk' AS precision FROM (SELECT category, unnest(['district', 'taluk']) AS level, unnest([district, taluk]) AS name FROM pool) GROUP BY category", POOL_SQL)
def areas_precision(spark, d):
    pool = filters.accepted_pool(views.incidents(spark, d))
    area = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("name")) for c in ("district", "taluk")]))
    return recurrence.area_precision(pool.select(F.col("category").alias("family"), F.col("incident_id").alias("event_id"), area.alias("a")).select("family", "event_id", "a.level", "a.name"))


@query("SELECT field, word, count(DISTINCT incident_id) AS ids FROM (SELECT incident_id, unnest(['category', 'taluk', 'event_status']) AS field, unnest([lower(category), lower(taluk), lower(event_status)]) AS word FROM incidents) GROUP BY ALL", INCIDENTS_SQL)
def value_index(spark, d):
    return answers.value_index(views.incidents(spark, d).withColumnRenamed("incident_id", "id"), ["category", "taluk", "event_status", "source_id"])


@query("SELECT incident_id FROM incidents WHERE category = 'BUILDING' AND event_status = 'ongoing'", INCIDENTS_SQL)
def value_match(spark, d):
    return answers.value_match(views.incidents(spark, d), ["category", "taluk", "event_status"], "which building cases are ongoing today").select("incident_id")


@query("SELECT round(min(min_price), 6) AS low, round(max(max_price), 6) AS high, count(*) AS rows, (count(DISTINCT market))::VARCHAR || ' markets' AS market, string_agg(DISTINCT commodity, ', ' ORDER BY commodity) AS commodity FROM prices WHERE commodity IN ('PROMO', 'SMALL')", PRICES_SQL)
def price_range(spark, d):
    rows = answers.price_range(views.prices(spark, d).filter(F.col("commodity").isin("PROMO", "SMALL")))
    return rows.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@query("SELECT market, count(*) AS rows, string_agg(DISTINCT commodity, '|' ORDER BY commodity) AS commodities, round(min(min_price), 6) AS low, round(max(max_price), 6) AS high FROM prices GROUP BY market", PRICES_SQL)
def market_groups(spark, d):
    return geo.grouped_markets(views.prices(spark, d)).withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


POINTS_SQL = "points AS (SELECT s_suppkey, s_name, 9.5 + (s_nationkey % 5) * 0.1 AS lat, 78.0 + (s_nationkey // 5) * 0.1 AS lng FROM supplier)"


def _points(spark, d):
    return views.table(spark, d, "supplier").select("s_suppkey", "s_name", (9.5 + (F.col("s_nationkey") % 5) * 0.1).alias("lat"), (78.0 + F.floor(F.col("s_nationkey") / 5) * 0.1).alias("lng"))


@query("""SELECT s_suppkey, i AS place_index, n AS place_count, round(CASE WHEN n > 1 THEN lat + (16 + 7 * sqrt(i)) * cos(i * pi() * (3 - sqrt(5))) / 111320 ELSE lat END, 7) AS display_lat,
  round(CASE WHEN n > 1 THEN lng + (16 + 7 * sqrt(i)) * sin(i * pi() * (3 - sqrt(5))) / (111320 * cos(radians(lat))) ELSE lng END, 7) AS display_lng
  FROM (SELECT s_suppkey, lat::DOUBLE AS lat, lng::DOUBLE AS lng, row_number() OVER (PARTITION BY lat, lng ORDER BY s_name) - 1 AS i, count(*) OVER (PARTITION BY lat, lng) AS n FROM points)""", POINTS_SQL)
def co_location(spark, d):
    rows = geo.disperse(_points(spark, d), lat="lat", lng="lng", order=["s_name"])
    return rows.select("s_suppkey", F.col("place_index").cast("long"), "place_count", F.round("display_lat", 7).alias("display_lat"), F.round("display_lng", 7).alias("display_lng"))


@query("SELECT incident_id, CASE WHEN taluk IN ('NATION_1', 'NATION_2', 'NATION_12') THEN 'P' || substr(taluk, 8) END AS place_id, CASE WHEN taluk IN ('NATION_1', 'NATION_2', 'NATION_12') THEN 'registry' ELSE 'insufficient' END AS resolution FROM incidents", INCIDENTS_SQL)
def geocode_registry(spark, d):
    places = [("P1", 9.91, 78.15), ("P2", 9.93, 78.13), ("P12", 10.03, 78.33)]
    registry = spark.createDataFrame(places, "place_id string, lat double, lng double")
    names = spark.createDataFrame([("P1", "nation 1", 0), ("P2", "nation 2", 1), ("P12", "nation 12", 2)], "place_id string, alias string, position int")
    rows = views.incidents(spark, d).select("incident_id", "taluk").withColumn("lat", F.lit(None).cast("double")).withColumn("lng", F.lit(None).cast("double"))
    return geo.geocode(rows, registry, names, key="incident_id", text="taluk").select("incident_id", "place_id", "resolution")


@query("SELECT n_name AS taluk, count(incident_id) AS incidents, count(incident_id) FILTER (severity = 'high') AS high, 0::BIGINT AS medium, count(incident_id) FILTER (severity <> 'high') AS low, CASE WHEN count_if(severity = 'high') > 0 THEN 'high' WHEN count_if(severity = 'low') > 0 THEN 'low' ELSE 'unknown' END AS severity FROM nation LEFT JOIN (SELECT * FROM incidents WHERE record_kind = 'incident') ON n_name = taluk GROUP BY n_name", INCIDENTS_SQL)
def taluk_severity(spark, d):
    areas = views.table(spark, d, "nation").select(F.col("n_name").alias("taluk"))
    return geo.areas_joined(areas, geo.area_rollup(views.incidents(spark, d), "taluk"), "taluk")


@query("SELECT count(*) AS records, count_if(record_kind = 'incident') AS incidents, count_if(review <> 'accepted') AS review_required, count_if(severity IN ('critical', 'high', 'medium', 'low')) AS shown_severity, count(DISTINCT taluk) AS taluks FROM incidents", INCIDENTS_SQL)
def gis_stats(spark, d):
    rows = views.incidents(spark, d)
    return rows.agg(rows_n().alias("records"), F.count_if(F.col("record_kind") == "incident").alias("incidents"), F.count_if(F.col("review") != "accepted").alias("review_required"), F.count_if(geo.map_severity(F.col("severity")).isNotNull()).alias("shown_severity"), F.countDistinct("taluk").alias("taluks"))


@query("SELECT count(*) AS features FROM points", POINTS_SQL)
def geojson_features(spark, d):
    return geo.features(_points(spark, d), lat="lat", lng="lng", properties=["s_suppkey", "s_name"]).agg(rows_n().alias("features"))


@query("SELECT e.record_id, min(CASE WHEN review = 'accepted' THEN 1 WHEN review = 'review_required' THEN 2 ELSE 3 END)::INTEGER AS outcome FROM records AS e LEFT JOIN incidents AS i ON e.record_id = i.record_id GROUP BY e.record_id", INCIDENTS_SQL, RECORDS_SQL)
def news_outcome(spark, d):
    rank = F.when(F.col("review") == "accepted", 1).when(F.col("review") == "review_required", 2).otherwise(3)
    return views.records(spark, d).select("record_id").join(views.incidents(spark, d).select("record_id", "review"), "record_id", "left").groupBy("record_id").agg(F.min(rank).alias("outcome"))


@query("SELECT record_type, count(*) AS n FROM records WHERE day >= DATE '2024-01-20' GROUP BY record_type", RECORDS_SQL)
def ingest_delta(spark, d):
    rows = views.records(spark, d)
    return state.newly_ingested(rows, rows.filter("day < DATE '2024-01-20'")).groupBy("record_type").agg(rows_n().alias("n"))


@query("SELECT CASE WHEN record_type = 'error' THEN 'kept_awaiting' WHEN day >= DATE '2024-01-15' THEN 'kept_recent' ELSE 'settled' END AS mark, count(*) AS n FROM records GROUP BY ALL", RECORDS_SQL)
def baseline_mark(spark, d):
    rows = views.records(spark, d)
    marked = state.baseline_mark(rows, rows.filter("record_type = 'error'"), F.lit("2024-01-15").cast("date"), settle_undated=False)
    return marked.groupBy("mark").agg(rows_n().alias("n"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_status = 'ongoing' THEN 'absent' WHEN review = 'review_required' THEN 'mode' WHEN category = 'MACHINERY' THEN 'input_hash' END AS reason FROM incidents) GROUP BY reason", INCIDENTS_SQL)
def checkpoint_reuse(spark, d):
    rows = views.incidents(spark, d)
    jobs = rows.select("record_id", F.lit("structured").alias("mode"), F.sha2("category", 256).alias("input_hash"))
    saved = rows.filter("event_status <> 'ongoing'").select("record_id", F.when(F.col("review") == "review_required", "semantic").otherwise("structured").alias("mode"), F.sha2(F.when(F.col("category") == "MACHINERY", "older").otherwise(F.col("category")), 256).alias("input_hash"))
    return state.reuse_reason(jobs, saved, ["mode", "input_hash"]).groupBy("reason").agg(rows_n().alias("n"))


@query("SELECT CASE WHEN category = 'BUILDING' THEN 'unchanged' WHEN event_status = 'ongoing' THEN 'duplicate' ELSE 'created' END AS outcome, count(*) AS n, count(DISTINCT CASE WHEN category = 'BUILDING' OR event_status <> 'ongoing' OR review <> 'accepted' THEN sha256(category) ELSE 'old' END) AS digests FROM incidents GROUP BY ALL", INCIDENTS_SQL)
def post_ledger(spark, d):
    rows = views.incidents(spark, d)
    batch = rows.select("incident_id", F.sha2("category", 256).alias("digest"))
    same = rows.filter("category = 'BUILDING'").select("incident_id", F.sha2("category", 256).alias("digest"))
    old = rows.filter("category <> 'BUILDING' AND event_status = 'ongoing' AND review = 'accepted'").select("incident_id", F.lit("old").alias("digest"))
    out = state.post_outcomes(batch, same.unionByName(old), rows.filter("event_status = 'ongoing'"))
    return out.groupBy("outcome").agg(rows_n().alias("n"), F.countDistinct("digest").alias("digests"))


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY source_id ORDER BY event_time, record_id) > 1 THEN 'duplicate' ELSE 'stored' END AS outcome FROM records WHERE source_id NOT IN (SELECT source_id FROM records WHERE record_type = 'view' AND value > 60)) GROUP BY outcome", RECORDS_SQL)
def record_upsert_outcome(spark, d):
    rows = views.records(spark, d)
    old = rows.filter("record_type = 'view' AND value > 60").select("source_id").distinct()
    fresh = rows.join(old, "source_id", "left_anti").withColumn("sequence", F.struct("event_time", "record_id"))
    return state.upsert_outcomes(fresh, old.limit(0), "source_id").groupBy("outcome").agg(rows_n().alias("n"))


@query("SELECT source_id, min(event_time) AS first_seen, count(*) AS records FROM records GROUP BY source_id", RECORDS_SQL)
def source_dimension(spark, d):
    return views.records(spark, d).groupBy("source_id").agg(F.min("event_time").cast("timestamp_ntz").alias("first_seen"), rows_n().alias("records"))


@query("SELECT source_id, max(asked) AS most, count_if(asked > 3) AS limited FROM (SELECT source_id, count(*) OVER (PARTITION BY source_id ORDER BY event_time RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS asked FROM records) GROUP BY source_id", RECORDS_SQL)
def rate_limit(spark, d):
    rows = state.rate_limited(views.records(spark, d), session="source_id", time="event_time", most=3, seconds=21600)
    return rows.groupBy("source_id").agg(F.max("asked").alias("most"), F.count_if("limited").alias("limited"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w AS n, sum(length(text)) OVER w AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE n <= 6 AND c <= 1200")
def history_trim(spark, d):
    return state.trimmed_history(views.table(spark, d, "conversations"), session="conv_id", order="turn", text="text").select("conv_id", "turn")


@query("SELECT page_id, count(*) AS links, string_agg(u, ' ' ORDER BY i) AS urls FROM (SELECT page_id, u, min(i) AS i FROM (SELECT page_id, unnest(us) AS u, unnest(range(len(us))) AS i FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1), lambda x: CASE WHEN x LIKE '/%' THEN 'http://example.org' || x ELSE x END) AS us FROM pages)) GROUP BY ALL) GROUP BY page_id")
def html_links(spark, d):
    rows = captures.links(views.table(spark, d, "pages"), base="http://example.org/")
    return rows.groupBy("page_id").agg(rows_n().alias("links"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "url"))), lambda x: x["url"]), " ").alias("urls"))


STRIP = "trim(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {STRIP.format(chr(39).join(['regexp_extract(html, ', '(?s)<h1[^>]*>(.*?)</h1>', ', 1)']))} AS title, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: {STRIP.format('x')}), lambda x: x <> ''), ' ') AS content FROM pages")
def html_article(spark, d):
    return captures.articles(views.table(spark, d, "pages"))


@query("SELECT 'k' AS name, count(*) AS n, sum(json_extract_string(props, '$.k')::DOUBLE) AS total FROM events")
def json_facts(spark, d):
    return captures.json_measures(views.records(spark, d), "data").groupBy("name").agg(rows_n().alias("n"), F.sum("measure").alias("total"))


@query("SELECT 'WEB-' || substr(sha1(url), 1, 16) AS record_id, 'article' AS record_type, length(html)::INTEGER AS size FROM pages")
def records_normalized(spark, d):
    return views.table(spark, d, "pages").select(article_id(F.col("url"), "WEB-").alias("record_id"), F.lit("article").alias("record_type"), F.length("html").alias("size"))


@query("SELECT CASE WHEN record_type IN ('view', 'click') THEN 'semantic' ELSE 'structured' END AS mode, count(*) AS n FROM records GROUP BY ALL", RECORDS_SQL)
def route_mode_counts(spark, d):
    kind = F.when(F.col("record_type").isin("view", "click"), " News ").when(F.col("record_type") == "error", "weather")
    rows = views.records(spark, d).select(X.route_mode(kind, F.col("record_type"), F.col("source_id")).alias("mode"))
    return rows.groupBy("mode").agg(rows_n().alias("n"))


@query("SELECT CASE WHEN value < 10 THEN 'max_temp|warning' ELSE 'warning' END AS missing, count(*) AS n FROM events GROUP BY ALL")
def valueless_fields(spark, d):
    data = F.create_map(F.lit("warning"), F.lit(""), F.lit("language"), F.lit(None).cast("string"), F.lit("max_temp"), F.when(F.col("value") >= 10, F.col("value").cast("string")))
    return views.records(spark, d).select(F.array_join(X.valueless(data), "|").alias("missing")).groupBy("missing").agg(rows_n().alias("n"))


@query("SELECT doc_id, n AS spans FROM (SELECT doc_id, len(list_filter(range(0, length(text) - 2), lambda i: substr(text, i + 1, 3) = 'ere')) AS n FROM documents WHERE length(text) >= 3) WHERE n > 0")
def span_occurrences(spark, d):
    spans = F.size(X.find_spans(F.col("text"), F.lit("ere"))).cast("long")
    return views.table(spark, d, "documents").select("doc_id", spans.alias("spans")).filter("spans > 0")


@query("SELECT d.doc_id AS field_id, b.item_id AS quote_id, count(*) AS n FROM documents AS d JOIN benchmark AS b ON contains(d.text, b.text), unnest(range(0, length(d.text) - length(b.text) + 1)) AS t(i) WHERE substr(d.text, i + 1, length(b.text)) = b.text GROUP BY ALL")
def quote_occurrences(spark, d):
    fields, quotes = views.table(spark, d, "documents").select(F.col("doc_id").alias("field_id"), "text"), views.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return evidence.quote_spans(fields, quotes).groupBy("field_id", "quote_id").agg(rows_n().alias("n"))


@query("SELECT CASE WHEN source = 'src0' THEN 'not_applicable' WHEN source = 'src1' THEN 'unvalidated' WHEN source = 'src2' THEN 'mismatch' ELSE 'validated' END AS outcome, count(*) AS n FROM documents GROUP BY ALL")
def evidence_verify(spark, d):
    end = F.least(F.length("text"), F.lit(20))
    start = F.when(F.col("source") != "src0", F.lit(0))
    hash_ = F.when(F.col("source") != "src1", F.sha2("text", 256))
    quote = F.when(F.col("source") == "src2", F.lit("~")).otherwise(F.substring("text", 1, 20))
    return views.table(spark, d, "documents").select(evidence.verified(F.col("text"), hash_, quote, start, end).alias("outcome")).groupBy("outcome").agg(rows_n().alias("n"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')))), '|') AS runs FROM documents WHERE regexp_matches(text, '[0-9]')")
def digit_runs(spark, d):
    rows = views.table(spark, d, "documents").filter(F.col("text").rlike("[0-9]"))
    return rows.select("doc_id", F.array_join(F.array_sort(X.digit_runs(F.col("text"))), "|").alias("runs"))


@query("SELECT lang, 'latin' AS script, count(*) AS n FROM documents GROUP BY ALL")
def script_mix(spark, d):
    return views.table(spark, d, "documents").select("lang", X.script(F.col("text")).alias("script")).groupBy("lang", "script").agg(rows_n().alias("n"))


@query("SELECT o_orderkey, (o_orderdate::DATE - 6)::DATE AS since, o_orderdate::DATE AS until FROM orders")
def question_windows(spark, d):
    rows = views.table(spark, d, "orders").withColumn("today", F.to_date("o_orderdate"))
    asked = answers.question_window(F.lit("What happened in the last 7 days?"), F.col("today"))
    return rows.select("o_orderkey", asked.alias("w")).select("o_orderkey", "w.since", "w.until")


@query("SELECT category AS family_id, count(DISTINCT incident_id) AS shared FROM pool WHERE event_time::DATE > (SELECT max(event_time)::DATE FROM pool) - 30 GROUP BY category", POOL_SQL)
def family_overlap(spark, d):
    pool = filters.accepted_pool(views.incidents(spark, d))
    families = pool.groupBy(F.col("category").alias("family_id"), "taluk").agg(F.collect_list("incident_id").alias("event_ids")).drop("taluk")
    inside = answers.period(pool, "event_time", 30).filter("in_period").select(F.col("incident_id").alias("event_id"))
    return answers.overlapping(families, inside)


@query("SELECT time_bucket(INTERVAL 7 DAY, event_time, TIMESTAMP '1970-01-01') AS since, record_type, count(*) AS records, round(sum(value), 4) AS total FROM records GROUP BY ALL", RECORDS_SQL)
def stream_tumbling(spark, d):
    rows = streams.tumbling(views.records(spark, d))
    return rows.select(F.col("since").cast("timestamp_ntz").alias("since"), "record_type", "records", F.round("total", 4).alias("total"))


@query("SELECT source_id, min(event_time) AS since, count(*) AS records FROM (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY event_time, record_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN event_time >= lag(event_time) OVER (PARTITION BY source_id ORDER BY event_time, record_id) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM records)) GROUP BY source_id, s", RECORDS_SQL)
def stream_session(spark, d):
    return streams.sessions(views.records(spark, d)).select("source_id", F.col("since").cast("timestamp_ntz").alias("since"), "records")


def _market_records(spark, d):
    return normalize.market_prices(views.prices(spark, d).dropDuplicates(["market", "commodity", "price_date"]).select("market", "commodity", "price_date", "quantity", "min_price", "max_price"), prefix="MKT-", source="markets")


@query("SELECT DISTINCT 'MKT-' || replace(upper(market), ' ', '_') || '-' || replace(upper(commodity), ' ', '_') || '-' || price_date::VARCHAR AS record_id, commodity || ' at ' || market AS title FROM prices", PRICES_SQL)
def market_records(spark, d):
    return _market_records(spark, d).select("record_id", "title")


@query("SELECT name, count(*) AS facts FROM (SELECT DISTINCT market, commodity, price_date FROM prices), unnest(['market', 'commodity', 'quantity', 'min_price', 'max_price', 'unit']) AS u(name) GROUP BY name", PRICES_SQL)
def structured_facts(spark, d):
    return normalize.structured_facts(_market_records(spark, d)).groupBy("name").agg(rows_n().alias("facts"))


@query("SELECT 'WEB-' || substr(sha1(url), 1, 16) AS record_id, p.i::INTEGER AS position, p.path, p.text, sha256(p.text) AS text_hash FROM pages, unnest([{'i': 0, 'path': 'title', 'text': trim(url)}, {'i': 1, 'path': 'data.content', 'text': html}, {'i': 2, 'path': 'data.language', 'text': 'ta'}]) AS u(p)")
def citable_fields(spark, d):
    pages = views.table(spark, d, "pages").select("url", F.col("url").alias("title"), F.lit(None).cast("timestamp").alias("published_at"), F.col("html").alias("content"))
    return normalize.citable_fields(normalize.articles(pages, prefix="WEB-", source="web"))


@query("SELECT kind, context_type, count(*) AS n FROM (SELECT CASE WHEN record_type IN ('view', 'error') THEN 'forecast' ELSE 'context' END AS kind, CASE WHEN record_type IN ('view', 'error') THEN 'weather' WHEN record_type = 'purchase' THEN 'market' ELSE 'other' END AS context_type FROM records) GROUP BY ALL", RECORDS_SQL)
def record_kinds(spark, d):
    kind = F.when(F.col("record_type") == "view", "forecast").when(F.col("record_type") == "purchase", "market_price")
    source = F.when(F.col("record_type") == "error", " Weather ")
    return views.records(spark, d).select(normalize.record_kind(kind, source).alias("k")).groupBy("k.kind", "k.context_type").agg(rows_n().alias("n"))


@query("SELECT key, severity, date_shown, review_required FROM (SELECT record_kind || ':' || incident_id AS key, CASE WHEN severity IN ('critical', 'high', 'low') THEN severity END AS severity, strftime(event_time, '%d %b %Y') AS date_shown, review <> 'accepted' AS review_required, record_kind, taluk, event_time FROM incidents) WHERE record_kind = 'incident' AND severity = 'high' AND event_time >= DATE '2000-01-01' AND contains(lower(taluk), 'nation_2')", INCIDENTS_SQL)
def map_records(spark, d):
    rows = geo.map_filter(geo.display_records(views.incidents(spark, d)), since="2000-01-01", search="Nation_2", record_kind="Incident", severity="HIGH", review="all")
    return rows.select("key", "severity", "date_shown", "review_required")


@query("SELECT incident_id, event_time::DATE AS day FROM pool WHERE category = 'FURNITURE' AND event_time::DATE > (SELECT max(event_time)::DATE FROM pool WHERE category = 'FURNITURE') - 90 ORDER BY event_time DESC, incident_id DESC LIMIT 8", POOL_SQL)
def search_newest(spark, d):
    pool = filters.accepted_pool(views.incidents(spark, d))
    return answers.search(pool, filters.Filters(category="FURNITURE").keeps(), "event_time", days=90).select("incident_id", F.to_date("event_time").alias("day"))


@query("""SELECT rule, rows FROM (SELECT unnest([{'rule': 'few_events', 'rows': count_if(dimension = 'place')}, {'rule': 'no_rise', 'rows': count_if(dimension = 'place' AND baseline_mean >= 1)},
  {'rule': 'ratio_presence', 'rows': count_if(dimension = 'category' AND baseline_mean > 0)}, {'rule': 'mean_over_max', 'rows': count_if(dimension = 'category' AND baseline_mean > 0)},
  {'rule': 'negative', 'rows': count_if(dimension = 'incident_type')}, {'rule': 'eligible_with_findings', 'rows': count_if(dimension = 'incident_type' AND findings <> '')}], recursive := true) FROM found)""", *TREND_CTES)
def trend_rule_violations(spark, d):
    """The rules over rows with faults put in by dimension."""
    rows = trends.findings(_arithmetic(spark, d), TREND)
    place, category, kind = (F.col("dimension") == x for x in ("place", "category", "incident_type"))
    rows = rows.withColumn("recent_events", F.when(place, 1).otherwise(F.col("recent_events"))).withColumn("new_sources", F.when(kind, -1).otherwise(F.col("new_sources")))
    rows = rows.withColumn("ratio", F.when(~category, F.col("ratio"))).withColumn("baseline_max", F.when(category, 0).otherwise(F.col("baseline_max")))
    return checks.violations(rows.withColumn("alert_eligible", kind | F.col("alert_eligible")), checks.trend_rules())


@query("""SELECT rule, CASE WHEN rule IN ('truncated', 'repeated') THEN n ELSE 0 END AS rows FROM (SELECT count(*) AS n FROM (SELECT root FROM member GROUP BY root HAVING count(DISTINCT e) >= 2)),
  (VALUES ('size'), ('shown'), ('truncated'), ('repeated')) AS t(rule)""", POOL_SQL, BUCKET_SQL, recursive=True)
def family_rule_violations(spark, d):
    """The rules over buckets with a wrong count of what isn't shown and an event that is shown twice."""
    rows = recurrence.buckets(_single_units(spark, d)).withColumn("truncated", F.col("truncated") + 1)
    twice = F.concat(F.slice("event_ids", 1, F.size("event_ids") - 1), F.slice("event_ids", 1, 1))
    return checks.violations(rows.withColumn("event_ids", twice), checks.family_rules())


@query("""SELECT rule, rows FROM (SELECT unnest([{'rule': 'order', 'rows': count_if(k = 0)}, {'rule': 'id', 'rows': count_if(k = 0)}, {'rule': 'accepted_without_confidence', 'rows': count_if(k = 1)},
  {'rule': 'accepted_without_quotes', 'rows': count_if(k = 2)}, {'rule': 'accepted_with_conflict', 'rows': count_if(k = 3)}, {'rule': 'accepted_undetermined', 'rows': count_if(k = 4)}], recursive := true)
  FROM (SELECT ascii(substr(link, 5)) % 6 AS k FROM best))""", POOL_SQL, PAIRS_SQL)
def link_rule_violations(spark, d):
    """The rules over accepted links with one fault each, by their id; one in six has none."""
    k = F.ascii(F.substring("link_id", 5, 1)) % 6
    pairs = linking.candidate_pairs(linking.signals(filters.accepted_pool(views.incidents(spark, d))))
    rows = pairs.select(
        F.when(k == 0, F.col("high_id")).otherwise(F.col("low_id")).alias("low_id"), F.when(k == 0, F.col("low_id")).otherwise(F.col("high_id")).alias("high_id"), "link_id", F.lit(True).alias("accepted"),
        F.when(k == 4, "undetermined").otherwise("same_event").alias("verdict"), F.when(k == 1, 0.5).otherwise(0.9).alias("confidence"), F.when(k == 2, 0).otherwise(1).alias("quotes_low"), F.lit(1).alias("quotes_high"),
        F.when(k == 3, F.array(F.lit("day"))).otherwise(F.array().cast("array<string>")).alias("conflicts"),
    )
    return checks.violations(rows, checks.link_rules())


@query("""SELECT quote_id, any_value(field_id) AS field_id FROM (SELECT *, max(share) OVER (PARTITION BY quote_id) AS top FROM (SELECT d.doc_id AS field_id, b.item_id AS quote_id, length(b.text) / length(d.text) AS share
    FROM documents AS d JOIN benchmark AS b ON contains(d.text, b.text) AND NOT contains(substr(d.text, strpos(d.text, b.text) + 1), b.text))) WHERE share = top GROUP BY quote_id HAVING count(*) = 1""")
def quote_unique_field(spark, d):
    fields, quotes = views.table(spark, d, "documents").select(F.col("doc_id").alias("field_id"), "text"), views.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return evidence.unique_field(fields, quotes)
