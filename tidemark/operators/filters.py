"""Filters, sorts, pages and facets over incidents."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold, priority_rank, severity_rank


@dataclass(frozen=True)
class Filters:
    """Analytic filters. A minimum rank drops rows without a rank; a bounded window drops undated rows."""

    category: str | None = None
    incident_type: str | None = None
    department: str | None = None
    event_status: str | None = None
    min_severity: str | None = None
    min_priority: str | None = None
    place: str | None = None
    since: dt.date | None = None
    until: dt.date | None = None

    def __post_init__(self):
        if self.since and self.until and self.since > self.until:
            raise ValueError("since is after until")

    def keeps(self, places: Column | None = None, time: Column | None = None) -> Column:
        out = F.lit(True)
        for name in ("category", "incident_type", "department", "event_status"):
            if (value := getattr(self, name)) is not None:
                out &= F.col(name).eqNullSafe(F.lit(value))
        if self.min_severity:
            out &= F.coalesce(severity_rank(F.col("severity")) >= severity_rank(F.lit(self.min_severity)), F.lit(False))
        if self.min_priority:
            out &= F.coalesce(priority_rank(F.col("priority")) >= priority_rank(F.lit(self.min_priority)), F.lit(False))
        if self.place is not None:
            wanted = fold(F.lit(self.place))
            out &= F.exists(places if places is not None else F.array("taluk", "district"), lambda p: F.coalesce(fold(p).contains(wanted), F.lit(False)))
        return out & in_window(time if time is not None else F.col("event_time"), self.since, self.until)


def in_window(time: Column, since: dt.date | None, until: dt.date | None) -> Column:
    """Inclusive UTC days; undated rows pass only if neither bound is set."""
    if since is None and until is None:
        return F.lit(True)
    out = time.isNotNull()
    if since is not None:
        out &= time >= F.lit(dt.datetime.combine(since, dt.time())).cast("timestamp")
    if until is not None:
        out &= time < F.lit(dt.datetime.combine(until + dt.timedelta(1), dt.time())).cast("timestamp")
    return out


def accepted_pool(incidents: DataFrame) -> DataFrame:
    """Accepted incidents, one row an id: the one that was reported first (then the least record id)."""
    rows = incidents.filter((F.col("record_kind") == "incident") & (F.col("review") == "accepted"))
    order = [F.asc_nulls_last("event_time"), F.asc("record_id")]
    nth = F.row_number().over(Window.partitionBy("incident_id").orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def attention(incidents: DataFrame) -> DataFrame:
    """With ``attention_rank`` and ``severity_rank``, the most pressing first; undated rows sort as the oldest."""
    severe = F.coalesce(severity_rank(F.col("severity")), F.lit(0))
    pressing = F.coalesce(priority_rank(F.col("priority")), severe)
    ranked = incidents.withColumn("attention_rank", pressing).withColumn("severity_rank", severe)
    return ranked.orderBy(F.desc("attention_rank"), F.desc("severity_rank"), F.desc_nulls_last("event_time"), "incident_id")


def high_priority() -> Column:
    return F.coalesce(F.col("priority").isin("critical", "high"), F.lit(False)) | F.coalesce(F.col("severity").isin("critical", "high"), F.lit(False))


def needs_review() -> Column:
    """A document that isn't accepted, or that holds a claim that isn't."""
    return (F.col("review") != "accepted") | F.exists("claims", lambda c: c["review"] != "accepted")


def quotes() -> Column:
    return F.array_join(F.transform("evidence", lambda e: e["quote"]), " ")


def page(rows: DataFrame, number: int, size: int = 10) -> DataFrame:
    """A page of sorted rows; numbers past the end give the last page."""
    if number <= 1:
        return rows.limit(size)
    pages = max(1, -(-rows.count() // size))
    return rows.offset((min(number, pages) - 1) * size).limit(size)


def latest_per(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(time), F.desc(tie)))).filter("_n = 1").drop("_n")


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``facet, value, n`` of the non-empty values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).select("p.facet", "p.value").filter("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def contains_all_text(rows: DataFrame, columns: list[str], words: str) -> DataFrame:
    """Case-insensitive substring search over several columns."""
    return rows.filter(F.lower(F.concat_ws(" ", *columns)).contains(words.strip().lower()))
