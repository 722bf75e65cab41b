"""Queries over keyed state and commits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import state
from .operators.trends import Trend
from .registering import query
from .sources import views
from .storage import materialize, shared_dir
from .streaming import anchored, commits, keyed

RUNS_SQL = """runs AS (SELECT 'C' || o_custkey::VARCHAR AS record_id, o_orderkey AS sequence, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'review_required' ELSE 'failed' END AS state, o_orderkey % 3 AS batch FROM orders)"""


def _runs(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "review_required").otherwise("failed")
    return views.table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("record_id"), F.col("o_orderkey").alias("sequence"), state.alias("state"), (F.col("o_orderkey") % 3).alias("batch"))


@query("""SELECT record_id, unnest(CASE WHEN state = 'review_required' THEN CASE WHEN before IS DISTINCT FROM state THEN ['awaiting'] ELSE [] END
    ELSE list_concat(CASE WHEN before = 'review_required' THEN ['released'] ELSE [] END, CASE WHEN earlier = 0 THEN ['seen'] ELSE [] END) END) AS change
  FROM (SELECT *, lag(state) OVER w AS before, count_if(state = 'completed') OVER w - (state = 'completed')::BIGINT AS earlier FROM runs WHERE state <> 'failed' WINDOW w AS (PARTITION BY record_id ORDER BY sequence))""", RUNS_SQL)
def settled_changes(spark, d):
    """The stateful operator over a table: every key's rows go through its state in order."""
    for k, v in keyed.STATE_STORE.items():
        spark.conf.set(k, v)
    return keyed.settling(_runs(spark, d).drop("batch"))


COMMITTED_SQL = """newest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY record_id, batch ORDER BY sequence DESC) = 1),
  final AS (SELECT * FROM newest QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY state <> 'failed' DESC, batch DESC) = 1)"""


def _committed(spark, d):
    """Three batches through one store; each is asked to flush twice, as after a crash."""
    rows = materialize(_runs(spark, d).withColumn("digest", F.sha2(F.col("sequence").cast("string"), 256)))
    store = commits.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    for batch in range(3):
        for _ in range(2):
            commits.flush_results(store, rows.filter(F.col("batch") == batch), writer="orders", batch=batch)
    return store


@query("SELECT record_id, sequence, state, sha256(sequence::VARCHAR) AS digest FROM final", RUNS_SQL, COMMITTED_SQL)
def committed_results(spark, d):
    return _committed(spark, d).table("results", commits.RESULTS)


@query("""SELECT record_id, 'seen' AS standing FROM (SELECT DISTINCT record_id FROM newest WHERE state = 'completed') UNION ALL
  SELECT record_id, 'awaiting' FROM (SELECT record_id, max(batch) FILTER (state = 'review_required') AS owed, coalesce(max(batch) FILTER (state = 'completed'), -1) AS done FROM newest GROUP BY record_id) WHERE owed > done""", RUNS_SQL, COMMITTED_SQL)
def committed_standing(spark, d):
    store = _committed(spark, d)
    return store.table("seen", commits.IDS).withColumn("standing", F.lit("seen")).unionByName(store.table("awaiting", commits.IDS).withColumn("standing", F.lit("awaiting")))


@query("""SELECT k, since, until, record_type, count(*) AS records, round(sum(value), 4) AS total FROM (SELECT k::INTEGER AS k, (hi - (9 + k * 10)::INTEGER)::DATE AS since, (hi - (k * 10)::INTEGER)::DATE AS until
    FROM (SELECT max(day) AS hi, min(day) AS lo FROM records), range(0, 4) AS r(k) WHERE k <= least(3, floor((hi - 9 - lo) / 10)) AND least(3, floor((hi - 9 - lo) / 10)) >= 2) JOIN records ON day BETWEEN since AND until GROUP BY ALL""", views.RECORDS_SQL)
def anchored_windows(spark, d):
    """Windows counted back from the newest day, cut from sums of days."""
    days = anchored.day_sums(views.records(spark, d))
    return anchored.anchored(days, Trend(recent_days=10, baseline_blocks=3)).select("k", "since", "until", "record_type", "records", F.round("total", 4).alias("total"))


@query("""SELECT user_id AS record_id, CASE WHEN s.state NOT IN ('completed', 'review_required') THEN 'absent' WHEN s.mode <> j.mode THEN 'mode' WHEN s.prompt_version <> j.prompt_version THEN 'prompt version' WHEN s.schema_version <> 'c1' THEN 'contract'
    WHEN j.input_hash IS NULL THEN 'not fingerprinted' WHEN s.input_hash IS DISTINCT FROM j.input_hash THEN 'input' WHEN j.mode <> 'semantic' THEN NULL WHEN j.prompt_digest <> '' AND s.prompt_digest = '' THEN 'prompt unknown'
    WHEN j.prompt_digest <> '' AND s.prompt_digest <> j.prompt_digest THEN 'prompt' WHEN NOT list_contains(['p0/m0', 'p1/m1', 'p0/m1'], s.provider || '/' || s.model) THEN 'not a candidate' END AS reason
  FROM (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) AS s JOIN (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) AS j USING (user_id)""",
  """entries AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'review_required' ELSE 'completed' END AS state, CASE WHEN n % 4 = 0 THEN 'structured' ELSE 'semantic' END AS mode, 'v' || (n // 80) AS prompt_version, 'c' || CASE WHEN n % 9 = 0 THEN 2 ELSE 1 END AS schema_version,
    CASE WHEN n % 13 > 0 THEN sha256((n // 50)::VARCHAR) END AS input_hash, CASE WHEN n % 5 = 0 THEN '' ELSE 'd' || (n // 60) END AS prompt_digest, 'p' || (n % 3) AS provider, 'm' || (n % 2) AS model FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS n FROM events))""")
def reuse_reasons(spark, d):
    """Of each user the first event is a saved result and the last one a job: whether the one still serves the other."""
    n = F.get_json_object("props", "$.k").cast("long")
    rows = views.table(spark, d, "events").withColumn("n", n).select(
        F.col("user_id").alias("record_id"), "event_id", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "review_required").otherwise("completed").alias("state"), F.when(F.col("n") % 4 == 0, "structured").otherwise("semantic").alias("mode"),
        F.concat(F.lit("v"), F.floor(F.col("n") / 80).cast("string")).alias("prompt_version"), F.when(F.col("n") % 9 == 0, "c2").otherwise("c1").alias("schema_version"), F.when(F.col("n") % 13 > 0, F.sha2(F.floor(F.col("n") / 50).cast("string"), 256)).alias("input_hash"),
        F.when(F.col("n") % 5 == 0, "").otherwise(F.concat(F.lit("d"), F.floor(F.col("n") / 60).cast("string"))).alias("prompt_digest"), F.concat(F.lit("p"), (F.col("n") % 3).cast("string")).alias("provider"), F.concat(F.lit("m"), (F.col("n") % 2).cast("string")).alias("model"),
    )
    whole = F.struct(*[F.col(c) for c in rows.columns if c not in ("record_id", "event_id")])
    ends = rows.groupBy("record_id").agg(F.min_by(whole, "event_id").alias("s"), F.max_by(whole, "event_id").alias("j"))
    jobs = ends.select("record_id", "j.mode", "j.prompt_version", "j.input_hash", "j.prompt_digest")
    return state.reuse_reasons(jobs, ends.select("record_id", "s.*"), schema_version="c1", candidates=[("p0", "m0"), ("p1", "m1"), ("p0", "m1")])
