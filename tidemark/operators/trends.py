"""Emerging trends: back-to-back windows, counts per pattern, coverage correction, rules and rank.

Windows are counted back from the newest day: ``k = 0`` is the recent one, ``k >= 1`` the baseline. Two shuffles do all the
work: distinct counts by (pattern, window), then one row a pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import short_hash


@dataclass(frozen=True)
class Trend:
    recent_days: int = 30
    baseline_blocks: int = 3
    min_events: int = 3
    min_ratio: float = 2.0
    coverage_drift: float = 1.5


def windows(rows: DataFrame, day: str, t: Trend) -> DataFrame:
    """``k, since, until`` of the usable windows; no rows if the history holds fewer than two baseline windows."""
    ends = rows.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).filter("hi IS NOT NULL")
    recent = F.date_sub("hi", t.recent_days - 1)
    usable = F.least(F.lit(t.baseline_blocks), F.floor(F.datediff(recent, F.col("lo")) / t.recent_days))
    spans = ends.withColumn("usable", usable).filter("usable >= 2").select("hi", F.explode(F.sequence(F.lit(0), F.col("usable").cast("int"))).alias("k"))
    since = F.date_sub("hi", t.recent_days - 1 + F.col("k") * t.recent_days)
    return spans.select("k", since.alias("since"), F.date_add(since, t.recent_days - 1).alias("until"))


def in_windows(rows: DataFrame, day: str, spans: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(spans), (F.col(day) >= F.col("since")) & (F.col(day) <= F.col("until")))  # baseline_blocks + 1 rows


def coverage(records: DataFrame, day: str, spans: DataFrame) -> DataFrame:
    """``k, since, until, pool_records, pool_sources`` over records of all kinds; windows without any have zeros."""
    n = in_windows(records, day, spans).groupBy("k").agg(F.countDistinct("record_id").alias("r"), F.countDistinct("source_id").alias("s"))
    return spans.join(n, "k", "left").select("k", "since", "until", F.coalesce("r", F.lit(0)).alias("pool_records"), F.coalesce("s", F.lit(0)).alias("pool_sources"))


def dimensions(units: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Each unit once under every value of every dimension: grouping sets over multi-valued columns. Columns are arrays."""
    def tagged(dimension: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(dimension).alias("dimension"), F.lower(v).alias("value")))

    groups = F.concat(*[tagged(d, c) for d, c in columns.items()])
    return units.select("*", F.explode(F.array_distinct(groups)).alias("_g")).select(*units.columns, "_g.dimension", "_g.value").filter("value IS NOT NULL")


def blocks(grouped: DataFrame, day: str, spans: DataFrame) -> DataFrame:
    """``dimension, value, k, events, incidents, records, sources``; all columns but the day are counted distinct."""
    return in_windows(grouped, day, spans).groupBy("dimension", "value", "k").agg(
        F.countDistinct("event_id").alias("events"), F.countDistinct("incident_id").alias("incidents"), F.countDistinct("record_id").alias("records"), F.countDistinct("source_id").alias("sources"),
    )


def new_sources(grouped: DataFrame, day: str, spans: DataFrame) -> DataFrame:
    """``dimension, value, new_sources``: sources of the recent window that no baseline window of the pattern has."""
    seen = in_windows(grouped, day, spans).groupBy("dimension", "value", "source_id").agg(F.max("k").alias("oldest"))
    return seen.groupBy("dimension", "value").agg(F.count_if(F.col("oldest") == 0).alias("new_sources"))


def named(trends: DataFrame, grouped: DataFrame, day: str, spans: DataFrame) -> DataFrame:
    """Add ``trend_id``: of the pattern, its period and the set of its events.

    The set goes in as its size and four sums of hash words, which any other set alters, so no task holds all ids of a pattern.
    """
    word = lambda i: F.sum(F.conv(F.substring(F.sha2("event_id", 256), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    events = in_windows(grouped, day, spans).select("dimension", "value", "event_id").distinct()
    sums = events.groupBy("dimension", "value").agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *map(word, range(4))).alias("_events"))
    period = F.broadcast(spans.agg(F.min("since").cast("string").alias("_since"), F.max("until").cast("string").alias("_until")))
    out = trends.join(sums, ["dimension", "value"]).crossJoin(period)  # period: one row
    made = F.concat(F.lit("TRD-"), short_hash(F.concat_ws("|", "dimension", "value", "_since", "_until", "_events")))
    return out.withColumn("trend_id", made).drop("_events", "_since", "_until")


def arithmetic(block: DataFrame, pool: DataFrame, t: Trend, fresh: DataFrame) -> DataFrame:
    """One row a pattern that passes the gate: enough recent events, and more than the baseline mean.

    ``block``: :func:`blocks`; ``pool``: :func:`coverage`; ``fresh``: :func:`new_sources`.
    """
    usable = F.broadcast(pool.agg(F.max("k").alias("usable"), F.max(F.when(F.col("k") == 0, F.col("pool_records"))).alias("pool_0"), F.sum(F.when(F.col("k") > 0, F.col("pool_records"))).alias("pool_base"), F.count_if((F.col("k") > 0) & (F.col("pool_records") > 0)).alias("pooled"), F.count_if(F.col("pool_records") == 0).alias("empty_windows")))
    base, now = F.col("k") > 0, F.col("k") == 0
    rows = block.join(F.broadcast(pool.select("k", "pool_records")), "k")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    sums = rows.groupBy("dimension", "value").agg(
        total("events", now).alias("e0"), total("incidents", now).alias("i0"), total("events", base).alias("eb"), total("incidents", base).alias("ib"), F.coalesce(F.max(F.when(base, F.col("events"))), F.lit(0)).alias("baseline_max"),
        F.coalesce(F.sum(F.when(base & (F.col("pool_records") > 0), F.col("events") / F.col("pool_records"))), F.lit(0.0)).alias("shares"),
    )
    mean = F.col("eb") / F.col("usable")
    share = F.col("shares") / F.col("pooled")
    r4 = lambda c: F.bround(c, 4)
    gated = sums.join(fresh, ["dimension", "value"], "left").crossJoin(usable).filter((F.col("e0") >= t.min_events) & ((mean == 0) | (F.col("e0") > mean)))  # usable: one row
    return gated.select(
        "dimension", "value", F.col("e0").alias("recent_events"), F.col("i0").alias("recent_incidents"), r4(mean).alias("baseline_mean"), "baseline_max", r4(F.col("pool_base") / F.col("usable")).alias("pool_mean"),
        r4(F.col("e0") - mean).alias("change"), F.when(mean > 0, r4(F.col("e0") / mean)).alias("ratio"), r4(F.col("i0") / F.col("e0")).alias("per_event_recent"),
        F.when(F.col("eb") > 0, r4(F.col("ib") / F.col("eb"))).otherwise(0.0).alias("per_event_baseline"), F.when(F.col("pool_0") > 0, r4(F.col("e0") / F.col("pool_0"))).otherwise(0.0).alias("share_recent"),
        F.when(F.col("pooled") > 0, r4(share)).otherwise(0.0).alias("share_baseline"), F.when((share > 0) & (F.col("pool_0") > 0), r4(F.col("e0") / F.col("pool_0") / share)).alias("share_ratio"),
        "empty_windows", F.coalesce("new_sources", F.lit(0)).alias("new_sources"),
    )


def findings(trends: DataFrame, t: Trend, *, deduplicated: bool = True, undecided_links: int = 0) -> DataFrame:
    """Add ``findings`` (what speaks against an alert, in order) and ``alert_eligible``."""
    c = F.col
    rules = [
        (F.lit(not deduplicated), "not_deduplicated"),
        (F.lit(undecided_links > 0), "undecided_links"),
        (c("empty_windows") > 0, "empty_window"),
        (c("baseline_mean") == 0, "zero_baseline"),
        ((c("baseline_mean") > 0) & (c("ratio") < t.min_ratio), "low_ratio"),
        (c("recent_events") < t.min_events, "few_events"),
        ((c("share_baseline") > 0) & (c("share_ratio") < t.min_ratio), "coverage"),
        ((c("per_event_baseline") > 0) & (c("per_event_recent") >= t.coverage_drift * c("per_event_baseline")), "reports_per_event"),
        ((c("new_sources") > 0) & (c("baseline_mean") > 0), "new_sources"),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    return trends.withColumn("findings", found).withColumn("alert_eligible", F.size("findings") == 0)


def evidence_findings(t: Trend, *, confidence: float = 0.8, quoted: int = 2) -> Column:
    """What the evidence of a pattern lacks for an alert, in order.

    Columns ``quoted_events`` (events with a quote of their own) and, of a reading if there was one, ``one_problem``,
    ``reading_confidence`` (null without a reading) and ``cited_events``.
    """
    c = F.col
    read = c("reading_confidence").isNotNull()
    rules = [
        (c("quoted_events") < max(quoted, t.min_events), "few quoted events"),
        (read & (c("one_problem") == F.lit(False)), "different problems"),
        (read & (c("reading_confidence") < confidence), "low confidence"),
        (read & (c("cited_events") < quoted), "fewer than two cited"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))


def ranked(trends: DataFrame) -> DataFrame:
    """By ratio, then recent events, then id (without ids: dimension and value)."""
    last = ["trend_id"] if "trend_id" in trends.columns else ["dimension", "value"]
    return trends.orderBy(F.desc(F.coalesce("ratio", F.lit(0.0))), F.desc("recent_events"), *last)


def compare(rows: DataFrame, day: str, days: int, area: str) -> DataFrame:
    """The newest ``days`` against the ``days`` before: counts, and areas new and gone."""
    anchor = F.broadcast(rows.agg(F.max(day).alias("anchor")))
    k = F.floor(F.datediff(F.col("anchor"), F.col(day)) / days)
    pair = rows.crossJoin(anchor).withColumn("k", k).filter("k IN (0, 1)")
    by_area = pair.groupBy(area).agg(F.count_if(F.col("k") == 0).alias("now"), F.count_if(F.col("k") == 1).alias("then"))
    only = lambda a, b: F.array_join(F.array_sort(F.collect_list(F.when((F.col(a) > 0) & (F.col(b) == 0), F.col(area)))), "|")
    return by_area.agg(F.sum("now").alias("recent"), F.sum("then").alias("before"), F.sum(F.col("now") - F.col("then")).alias("change"), only("now", "then").alias("new_areas"), only("then", "now").alias("gone_areas"))
