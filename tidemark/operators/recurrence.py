"""Recurring issues over events: buckets, monthly distribution, half-period change, area precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import short_hash
from ..storage import materialize
from .components import connected_components

SHOWN, LEAST_DAYS = 8, 61


def connections(units: DataFrame) -> DataFrame:
    """``src, dst`` of a graph with the components of "shares a place and a type or category".

    Events that share a (place, problem) key are one clique; a star around its least event has the same component, so
    a district that holds a third of all events costs one edge an event.
    """
    places = F.array_distinct(F.concat(F.transform("taluks", lambda x: F.concat(F.lit("taluk:"), F.lower(x))), F.transform("districts", lambda x: F.concat(F.lit("district:"), F.lower(x)))))
    problems = F.concat(F.transform("types", lambda x: F.concat(F.lit("type:"), x)), F.transform("categories", lambda x: F.concat(F.lit("category:"), x)))
    keys = units.select("event_id", F.explode(places).alias("place"), problems.alias("p")).select("event_id", "place", F.explode("p").alias("problem"))
    head = keys.groupBy("place", "problem").agg(F.min("event_id").alias("src"))
    return keys.join(head, ["place", "problem"]).select("src", F.col("event_id").alias("dst")).filter("src <> dst").distinct()


def buckets(units: DataFrame, *, shown: int = SHOWN) -> DataFrame:
    """``bucket_id, size, truncated, event_ids``: components of two events or more, the newest ``shown`` of each."""
    said = ["taluks", "districts", "types", "categories"]
    alike = units.select("event_id", "when", *[F.array_sort(F.array_distinct(c)).alias(c) for c in said])
    # events that say the same share all keys: the least of them stands for them in the graph
    heads = materialize(alike.groupBy(*said).agg(F.min("event_id").alias("event_id")))
    keyed = heads.filter((F.size(F.array_compact(F.concat("taluks", "districts"))) > 0) & (F.size(F.array_compact(F.concat("types", "categories"))) > 0))
    part = connected_components(connections(heads))
    named = keyed.join(part, F.col("event_id") == F.col("id"), "left").select(*[F.col(c).alias(f"_{c}") for c in said], F.coalesce("component", "event_id").alias("component"))
    same = F.lit(True)
    for c in said:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = alike.join(named, same).select("event_id", "when", "component")
    newest = Window.partitionBy("component").orderBy(F.desc_nulls_last("when"), F.desc("event_id"))
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    top = rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= shown)
    ids = top.groupBy("component").agg(F.array_sort(F.collect_list("event_id")).alias("event_ids"))
    named = ids.join(sizes, "component").withColumn("bucket_id", F.concat(F.lit("BKT-"), short_hash(F.array_join("event_ids", "|"))))
    return named.select("bucket_id", "size", F.greatest(F.col("size") - shown, F.lit(0)).alias("truncated"), "event_ids")


def monthly(rows: DataFrame, key: list[str], time: str) -> DataFrame:
    month = F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("undated")).alias("month")
    return rows.groupBy(*key, month).agg(F.count(F.lit(1)).alias("events"))


def half_period(rows: DataFrame, key: str, time: str, weight: Column | None = None, *, least_days: int = LEAST_DAYS) -> DataFrame:
    """Events and incidents in the later and earlier half of each family's own span, and the change.

    The middle is the first time plus half of the whole days between first and last. Families with fewer than two dated
    events or a span under ``least_days`` get nulls and a reason.
    """
    n = weight if weight is not None else F.lit(1)
    dated = rows.filter(F.col(time).isNotNull())
    span = dated.groupBy(key).agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count(F.lit(1)).alias("dated"))
    days = F.floor((F.unix_timestamp("hi") - F.unix_timestamp("lo")) / 86400)
    span = span.withColumn("days", days).withColumn("mid", F.timestamp_seconds(F.unix_timestamp("lo") + F.floor(F.col("days") / 2) * 86400))
    late = F.col(time) >= F.col("mid")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = dated.join(span, key).groupBy(key, "dated", "days").agg(count(late).alias("recent_events"), count(~late).alias("previous_events"), F.sum(F.when(late, n).otherwise(0)).alias("recent_incidents"), F.sum(F.when(~late, n).otherwise(0)).alias("previous_incidents"))
    reason = F.when(F.col("dated") < 2, "fewer than two dated events").when(F.col("days") < least_days, F.concat(F.lit("shorter than the "), F.lit(str(least_days)), F.lit(" days")))
    fine = reason.isNull()
    return out.select(key, "dated", "days", *[F.when(fine, F.col(c)).alias(c) for c in ("recent_events", "previous_events", "recent_incidents", "previous_incidents")], F.when(fine, F.col("recent_events") - F.col("previous_events")).alias("change"), reason.alias("reason"))


def area_precision(areas: DataFrame) -> DataFrame:
    """``family, areas, precision``: over a family's events the least of their finest levels. ``areas``: family, event_id, level, name."""
    level = F.when(F.col("level") == "district", 2).when(F.col("level") == "taluk", 3).when(F.col("level") == "block", 4).when(F.col("level") == "village", 5).otherwise(1)
    finest = areas.groupBy("family", "event_id").agg(F.max(level).alias("finest"))
    name = F.element_at(F.array(*map(F.lit, ["state", "district", "taluk", "block", "village"])), F.col("low"))
    count = areas.groupBy("family").agg(F.countDistinct("level", "name").alias("areas"))
    return finest.groupBy("family").agg(F.min("finest").alias("low")).join(count, "family").select("family", "areas", name.alias("precision"))
