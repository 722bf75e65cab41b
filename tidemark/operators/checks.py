"""Consistency rules of derived rows: name to "is violated", and counts over a table in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import link_id
from .linking import ACCEPTED


def link_rules() -> dict[str, Column]:
    c, same = F.col, F.col("verdict") == "same_event"
    return {
        "order": c("low_id") >= c("high_id"),
        "id": c("link_id") != link_id(c("low_id"), c("high_id")),
        "accepted_without_confidence": c("accepted") & (c("confidence") < ACCEPTED),
        "accepted_without_quotes": c("accepted") & same & (F.least("quotes_low", "quotes_high") < 1),
        "accepted_with_conflict": c("accepted") & same & (F.size("conflicts") > 0),
        "accepted_undetermined": c("accepted") & ~c("verdict").isin("same_event", "separate_event"),
    }


def trend_rules(min_events: int = 3) -> dict[str, Column]:
    c = F.col
    return {
        "few_events": c("recent_events") < min_events,
        "no_rise": (c("baseline_mean") > 0) & (c("recent_events") <= c("baseline_mean")),
        "ratio_presence": c("ratio").isNull() != (c("baseline_mean") == 0),
        "mean_over_max": c("baseline_mean") > c("baseline_max"),
        "negative": F.least("recent_events", "recent_incidents", "new_sources") < 0,
        "eligible_with_findings": c("alert_eligible") & (F.size("findings") > 0),
    }


def family_rules() -> dict[str, Column]:
    c = F.col
    return {
        "size": c("size") < 2,
        "shown": F.size("event_ids") != F.least(c("size"), F.lit(8)),
        "truncated": c("truncated") != F.greatest(c("size") - 8, F.lit(0)),
        "repeated": F.size(F.array_distinct("event_ids")) < F.size("event_ids"),
    }


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, rows``: how many rows violate each rule, zeros included."""
    sums = rows.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(n) for n, v in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])).alias("r")).select("r.rule", "r.rows")
