"""Queries of the cube of periods and the lines that read from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import filters, measures
from .queries import POOL_SQL
from .registering import query
from .sources import views
from .storage import materialize

DAYS = {"month": 30, "quarter": 90, "week": 7}
CELLS_SQL = """reports AS (SELECT *, CASE WHEN severity <> 'low' THEN event_time::DATE END AS day, CASE WHEN event_status IN ('unknown', 'unresolved') THEN 'unstated' WHEN weight < 80000 THEN 'unquoted' WHEN event_status IN ('ongoing', 'under_investigation') THEN 'open' WHEN event_status IN ('action_taken', 'resolved') THEN 'recorded' ELSE 'other' END AS standing FROM pool),
  periods AS (SELECT p.period_id, p.days, (until - (p.days - 1))::DATE AS since, until FROM (SELECT max(day) AS until FROM reports), (VALUES ('month', 30), ('quarter', 90), ('week', 7)) AS p(period_id, days)),
  sided AS (SELECT period_id, CASE WHEN day IS NULL THEN 'undated' WHEN day BETWEEN since AND until THEN 'inside' ELSE 'outside' END AS side, reports.* FROM reports, periods),
  valued AS (SELECT * FROM (SELECT *, unnest([{'dimension': 'area', 'value': taluk}, {'dimension': 'area', 'value': district}, {'dimension': 'category', 'value': category}, {'dimension': 'severity', 'value': severity}, {'dimension': 'standing', 'value': standing}, {'dimension': 'type', 'value': incident_type}], recursive := true) FROM sided) WHERE value IS NOT NULL),
  cells AS (SELECT period_id, side, dimension, value, count(DISTINCT source_id) AS events, count(DISTINCT incident_id) AS incidents, count(DISTINCT record_id) AS records, count(DISTINCT substr(source_id, 5)) AS sources
    FROM valued GROUP BY GROUPING SETS ((period_id, side), (period_id, side, dimension, value)))"""

STANDS_SQL = """stands AS (SELECT period_id, """ + ", ".join(f"coalesce(max(incidents) FILTER (value = '{s}'), 0) AS s_{s}" for s in ("open", "recorded", "unstated", "unquoted")) + """
  FROM cells WHERE side = 'inside' AND dimension = 'standing' GROUP BY period_id)"""


def _cells(spark, d):
    """Reports of one publisher are one event here."""
    pool = filters.accepted_pool(views.incidents(spark, d)).withColumn("day", F.when(F.col("severity") != "low", F.to_date("event_time")))
    reports = pool.withColumn("event_id", F.col("source_id")).withColumn("source_id", F.substring("source_id", 5, 99))
    periods = materialize(measures.counted_back(reports, DAYS))
    facets = {
        "area": F.array("taluk", "district"), "category": F.array("category"), "severity": F.array("severity"), "type": F.array("incident_type"),
        "standing": F.array(measures.standing(F.col("event_status"), F.col("weight") >= 80000)),
    }
    return reports, periods, materialize(measures.cube(reports, periods, facets))


@query("SELECT * FROM cells", POOL_SQL, CELLS_SQL)
def period_cube(spark, d):
    return _cells(spark, d)[2]


@query("""SELECT period_id, (row_number() OVER (PARTITION BY period_id ORDER BY k) - 1)::INTEGER AS position, line FROM (
    SELECT period_id, 0 AS k, 'Period: ' || since || ' to ' || until || ' - ' || days || ' day(s) counted back from ' || until || ', the newest dated record here (its date read from event_time).' AS line FROM periods
    UNION ALL SELECT period_id, 1, 'The period holds ' || events || ' distinct event(s) from ' || incidents || ' accepted incident(s) in ' || records || ' record(s) filed by ' || sources || ' publisher(s).' FROM cells WHERE dimension IS NULL AND side = 'inside'
    UNION ALL SELECT period_id, 2, 'Places in the period: ' || string_agg(value || ' (' || events || ' event(s))', ', ' ORDER BY value || ' (' || events) || '.' FROM cells WHERE dimension = 'area' AND side = 'inside' GROUP BY period_id
    UNION ALL SELECT period_id, CASE dimension WHEN 'category' THEN 3 WHEN 'type' THEN 4 ELSE 5 END, CASE dimension WHEN 'category' THEN 'Categories here: ' WHEN 'type' THEN 'Event types here: ' ELSE 'Severities here: ' END || string_agg(value, ', ' ORDER BY value) || '.'
      FROM cells WHERE dimension IN ('category', 'type', 'severity') AND side = 'inside' GROUP BY period_id, dimension
    UNION ALL SELECT period_id, 6, 'Open with a quote: ' || s_open || ', action or resolution recorded: ' || s_recorded || ', no status evidenced: ' || s_unstated || ', a status stated with no words to quote: ' || s_unquoted || '.' FROM stands
    UNION ALL SELECT period_id, 7, events || ' distinct event(s) in these records carry no date, so they fall in no period.' FROM cells WHERE dimension IS NULL AND side = 'undated'
    UNION ALL SELECT period_id, 8, events || ' dated event(s) fall outside this period and are not counted here.' FROM cells WHERE dimension IS NULL AND side = 'outside'
    UNION ALL SELECT period_id, 9 + row_number() OVER (PARTITION BY period_id ORDER BY 'Saved recurring issue ' || category || ' counts ' || shared), 'Saved recurring issue ' || category || ' counts ' || shared || ' of its ' || events || ' event(s) in this period.'
      FROM (SELECT period_id, category, count(DISTINCT source_id) AS events, count(DISTINCT source_id) FILTER (side = 'inside') AS shared FROM sided GROUP BY period_id, category))""", POOL_SQL, CELLS_SQL, STANDS_SQL)
def briefing_lines(spark, d):
    reports, periods, cells = _cells(spark, d)
    read = reports.count()
    reasons = measures.emptiness(cells, periods, read=read, kept=read)
    families = reports.groupBy(F.col("category").alias("item_id")).agg(F.countDistinct("event_id").alias("events"))
    held = cells.filter("side = 'inside' AND dimension = 'category'").select("period_id", F.col("value").alias("item_id"), F.col("events").alias("shared"))
    overlaps = families.crossJoin(periods.select("period_id")).join(held, ["period_id", "item_id"], "left").select("period_id", "item_id", F.lit("family").alias("kind"), "events", F.coalesce("shared", F.lit(0)).alias("shared"))
    return measures.lines(cells, periods, reasons, overlaps)
