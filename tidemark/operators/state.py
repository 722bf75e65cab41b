"""Incremental state: new records, cut-offs, reuse of results, ledgers, rate limits, histories, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newly_ingested(records: DataFrame, seen: DataFrame, *, key: str = "record_id", arrival: str = "event_time") -> DataFrame:
    """Records whose id was never seen, each id once, in order of arrival."""
    first = Window.partitionBy(key).orderBy(F.asc_nulls_last(arrival))
    return records.join(seen.select(key), key, "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def baseline_mark(records: DataFrame, awaiting: DataFrame, cutoff: Column, *, settle_undated: bool) -> DataFrame:
    """Add ``mark``: ``kept_awaiting, kept_recent, kept_undated`` or ``settled``. Stamps without a day are ambiguous."""
    rows = records.join(awaiting.select("record_id").distinct().withColumn("_w", F.lit(True)), "record_id", "left")
    undated = F.col("day").isNull()
    mark = F.when(F.col("_w"), "kept_awaiting").when(undated & F.lit(not settle_undated), "kept_undated").when(~undated & (F.col("day") >= cutoff), "kept_recent").otherwise("settled")
    return rows.withColumn("mark", mark).drop("_w")


def reuse_reason(jobs: DataFrame, saved: DataFrame, fields: list[str], *, key: str = "record_id") -> DataFrame:
    """``key, reason``: null if the saved result can be used again, else the first field in order that differs, or ``absent``."""
    named = saved.select(key, F.lit(True).alias("_there"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = jobs.join(named, key, "left")
    reason = F.when(F.col("_there").isNull(), "absent")
    for f in fields:
        reason = reason.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f)
    return rows.select(key, reason.alias("reason"))


def post_outcomes(batch: DataFrame, ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """``incident_id, outcome, digest``: what an idempotent post of a batch does, and the digest the ledger then holds.

    An unchanged digest isn't sent. A new id is created. An id that the store has already is a duplicate: it isn't
    overwritten, and the ledger keeps the digest it had.
    """
    rows = batch.join(ledger.select("incident_id", F.col("digest").alias("old")), "incident_id", "left")
    rows = rows.join(stored.select("incident_id").distinct().withColumn("_s", F.lit(True)), "incident_id", "left")
    outcome = F.when(F.col("old").eqNullSafe(F.col("digest")), "unchanged").when(F.col("_s"), "duplicate").otherwise("created")
    kept = F.when(outcome == "duplicate", F.coalesce("old", "digest")).otherwise(F.col("digest"))
    return rows.select("incident_id", outcome.alias("outcome"), kept.alias("digest"))


def upsert_outcomes(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Add ``outcome``: ``stored`` for the first row of a new key, else ``duplicate``. Needs a ``sequence`` column."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("sequence"))
    there = existing.select(key).distinct().withColumn("_e", F.lit(True))
    return rows.withColumn("_n", n).join(there, key, "left").withColumn("outcome", F.when(F.col("_e") | (F.col("_n") > 1), "duplicate").otherwise("stored")).drop("_n", "_e")


def rate_limited(asks: DataFrame, *, session: str, time: str, most: int = 20, seconds: int = 600) -> DataFrame:
    """Add ``asked`` (asks of the session in the last ``seconds``, this one included) and ``limited``."""
    last = Window.partitionBy(session).orderBy(F.unix_micros(time)).rangeBetween(-seconds * 1_000_000, 0)
    return asks.withColumn("asked", F.count(F.lit(1)).over(last)).withColumn("limited", F.col("asked") > most)


def trimmed_history(turns: DataFrame, *, session: str, order: str, text: str, most_turns: int = 6, most_chars: int = 1200) -> DataFrame:
    """The newest turns of each session: ``most_turns`` and ``most_chars`` at most, the oldest dropped first."""
    back = Window.partitionBy(session).orderBy(F.desc(order))
    rows = turns.withColumn("_n", F.row_number().over(back)).withColumn("_c", F.sum(F.length(text)).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("_n") <= most_turns) & (F.col("_c") <= most_chars)).drop("_n", "_c")


def last_write_wins(log: DataFrame, key: str, sequence: str) -> DataFrame:
    """The newest line of each key, with ``superseded``: how many older ones it replaces."""
    by = Window.partitionBy(key)
    rows = log.withColumn("_n", F.row_number().over(by.orderBy(F.desc(sequence)))).withColumn("superseded", F.count(F.lit(1)).over(by) - 1)
    return rows.filter("_n = 1").drop("_n")


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A store after a save: rows of ``new``, and those of ``old`` that it doesn't replace."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def counts_by_state(rows: DataFrame, state: str, states: list[str]) -> DataFrame:
    """Counts with all ``states`` present, those without rows as zero."""
    every = rows.sparkSession.createDataFrame([(s,) for s in states], f"{state} string")
    return every.join(rows.groupBy(state).agg(F.count(F.lit(1)).alias("n")), state, "left").select(state, F.coalesce("n", F.lit(0)).alias("n"))


#: States whose result can be used again (fixed values).
REUSABLE = ["completed", "review_required"]


def reuse_reasons(jobs: DataFrame, saved: DataFrame, *, schema_version: str, candidates: list[tuple[str, str]] | None = None, provider: str | None = None, model: str | None = None, key: str = "record_id") -> DataFrame:
    """``key, reason``: null where the saved result of a job can be used again, else why not, by the first reason that holds.

    ``jobs``: ``key, mode, prompt_version, input_hash, prompt_digest``; ``saved``: those and ``state, schema_version, provider, model``. What read a record
    counts for ``semantic`` jobs alone: their prompt, and that a candidate of this run (or the one provider and model) has read it.
    """
    c = F.col
    named = saved.select(key, F.lit(True).alias("_there"), *[F.col(f).alias(f"s_{f}") for f in ("state", "mode", "prompt_version", "schema_version", "input_hash", "prompt_digest", "provider", "model")])
    differs = lambda name: ~c(name).eqNullSafe(c(f"s_{name}"))
    blank = lambda name: F.coalesce(c(name), F.lit("")) == ""
    other = lambda name, wanted: F.lit(bool(wanted)) & ~blank(f"s_{name}") & (c(f"s_{name}") != F.lit(wanted or ""))
    readers = F.array(*[F.concat(F.lit(p), F.lit("/"), F.lit(m)) for p, m in candidates or [("", "")]])
    read_by = F.concat(F.coalesce("s_provider", F.lit("")), F.lit("/"), F.coalesce("s_model", F.lit("")))
    table = [
        ("absent", c("_there").isNull() | ~F.coalesce(c("s_state").isin(REUSABLE), F.lit(False))), ("mode", differs("mode")), ("prompt version", differs("prompt_version")), ("contract", ~c("s_schema_version").eqNullSafe(F.lit(schema_version))), ("not fingerprinted", c("input_hash").isNull()),
        ("input", differs("input_hash")), (None, c("mode") != "semantic"), ("prompt unknown", ~blank("prompt_digest") & blank("s_prompt_digest")), ("prompt", ~blank("prompt_digest") & differs("prompt_digest")),
        ("not a candidate", F.lit(bool(candidates)) & ~F.array_contains(readers, read_by)), (None, F.lit(bool(candidates))), ("model", other("model", model)), ("provider", other("provider", provider)),
    ]
    reason = None
    for said, held in table:
        held = F.coalesce(held, F.lit(False))
        reason = F.when(held, F.lit(said).cast("string")) if reason is None else reason.when(held, F.lit(said).cast("string"))
    return jobs.join(named, key, "left").select(key, reason.alias("reason"))
