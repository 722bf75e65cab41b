"""Resumable runs: batches, saved results, manifests, settled ids, and the counts that a run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STATES
from .state import counts_by_state, last_write_wins

#: Saved results that a failed or deferred re-read must not replace.
REUSABLE = ["completed", "review_required"]


def decoded_lines(lines: DataFrame, required: list[str]) -> DataFrame:
    """``line, body, fault`` of JSON lines (``line, text``): an object with all required keys, else why not."""
    body = F.from_json("text", "map<string,string>")
    rows = lines.select("line", F.when(F.substring(F.trim("text"), 1, 1) == "{", body).alias("body"))
    absent = F.filter(F.array(*map(F.lit, required)), lambda k: F.try_element_at("body", k).isNull())
    fault = F.when(F.col("body").isNull(), "not an object").when(F.size(absent) > 0, F.concat(F.lit("lacks "), F.array_join(absent, ", ")))
    return rows.select("line", "body", fault.alias("fault"))


def batches(jobs: DataFrame, order: str, size: int) -> DataFrame:
    """Add ``batch``: jobs in fixed slices of ``size``. ``order`` is a gapless 0-based number, so no sort is needed."""
    return jobs.withColumn("batch", F.floor(F.col(order) / size))


def merged_results(saved: DataFrame, fresh: DataFrame, key: str = "record_id") -> DataFrame:
    """The store after a batch: a fresh result replaces a saved one, but a failed or deferred one no good one.

    Both hold one row a key with ``state``.
    """
    old = saved.select(F.col(key).alias("_key"), F.struct(*saved.columns).alias("_old"))
    new = fresh.select(F.col(key).alias("_new_key"), F.struct(*saved.columns).alias("_new"))
    rows = old.join(new, F.col("_key") == F.col("_new_key"), "full")
    keep = F.col("_new").isNull() | (F.col("_old.state").isin(REUSABLE) & ~F.col("_new.state").isin(REUSABLE))
    return rows.select(F.when(F.coalesce(keep, F.lit(False)), F.col("_old")).otherwise(F.col("_new")).alias("r")).select("r.*")


def manifest(entries: DataFrame, *, key: str = "record_id") -> DataFrame:
    """One row: entries, counts of all states, and a digest that any changed, lost or added entry alters.

    The digest is of sums of entry hashes, so no task has to hold or sort the whole log.
    """
    line = F.sha2(F.to_json(F.struct(*sorted(entries.columns))), 256)
    word = lambda i: F.sum(F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    states = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    digest = F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[word(i).cast("string") for i in range(4)]), 256)
    return entries.agg(F.count(key).alias("entries"), *states, digest.alias("digest"))


def reconcile(written: DataFrame, found: DataFrame) -> DataFrame:
    """``fault``: whether a log still is what its manifest says: ``lost entries``, ``incomplete manifest``, ``state counts``, ``digest`` or null."""
    a = written.select(*[F.col(c).alias(f"w_{c}") for c in written.columns])
    states = F.lit(False)
    for s in STATES:
        states |= F.col(f"w_{s}") != F.col(s)
    fault = F.when(F.col("w_entries") > F.col("entries"), "lost entries").when(F.col("w_entries") < F.col("entries"), "incomplete manifest").when(states, "state counts").when(F.col("w_digest") != F.col("digest"), "digest")
    return a.crossJoin(found).select(fault.alias("fault"))  # one row each


def settle(seen: DataFrame, awaiting: DataFrame, done: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """``(seen, awaiting)`` after a run: completed ids are seen and no longer awaited, other ids of the run are awaited.

    ``done``: ``key, state``.
    """
    completed = done.filter("state = 'completed'").select(key)
    after = seen.select(key).union(done.select(key)).distinct()
    waits = awaiting.select(key).union(done.filter("state <> 'completed'").select(key)).distinct().join(completed, key, "left_anti")
    return after, waits


def reusable_corpus(log: DataFrame, key: str = "record_id", sequence: str = "line") -> DataFrame:
    """The newest line of each record, where it can be used again."""
    return last_write_wins(log, key, sequence).filter(F.col("state").isin(REUSABLE))


def added_to_corpus(corpus: DataFrame, more: DataFrame, key: str = "incident_id") -> DataFrame:
    """Union by id; what the corpus holds stays as it is."""
    return corpus.unionByName(more.dropDuplicates([key]).join(corpus.select(key), key, "left_anti"), allowMissingColumns=True)


def run_counts(results: DataFrame) -> DataFrame:
    """One row: accepted incidents and contexts, reviews, failures, deferrals, and whether they add up to what was fetched."""
    c = F.col
    done = c("state") == "completed"
    out = results.agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(done & (c("record_kind") == "incident")).alias("incidents"), F.count_if(done & (c("record_kind") != "incident")).alias("contexts"),
        F.count_if(c("state") == "review_required").alias("review"), F.count_if(c("state") == "failed").alias("failed"), F.count_if(c("state") == "deferred").alias("deferred"),
    )
    return out.withColumn("closed", c("fetched") == c("incidents") + c("contexts") + c("review") + c("failed") + c("deferred"))


def counts_by_reader(results: DataFrame) -> DataFrame:
    return results.groupBy("answered_by").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "answered_by")


def link_counts(links: DataFrame) -> DataFrame:
    """``verdict, review, n`` with every pair of the two, zeros included."""
    pairs = [f"{v}/{r}" for v in ("same_event", "separate_event", "undetermined") for r in ("accepted", "review_required")]
    counted = counts_by_state(links.select(F.concat_ws("/", "verdict", "review").alias("pair")), "pair", pairs)
    part = F.split("pair", "/")
    return counted.select(part[0].alias("verdict"), part[1].alias("review"), "n")


def postable(outcomes: DataFrame) -> DataFrame:
    """Accepted incidents to post, one row an id: this run's result (``origin`` 0) before a reused one (1)."""
    rows = outcomes.filter("record_kind = 'incident' AND review = 'accepted'")
    return rows.groupBy("incident_id").agg(F.min(F.struct("origin", "record_id")).alias("f")).select("incident_id", "f.origin", "f.record_id")


def totals(results: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Counters by source, and over all sources in the row whose source is null."""
    return results.rollup(key).agg(*[F.sum(c).alias(c) for c in counters])


def least_confidence(confidence: Column) -> Column:
    return F.coalesce(F.min(confidence), F.lit(1.0))
