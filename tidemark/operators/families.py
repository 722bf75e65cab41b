"""Drafted families of recurring events: assessment of the drafts, and the family rows that come of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import short_hash
from ..storage import materialize
from ..vocabularies import DEPARTMENTS
from .components import connected_components

LEAST_EVENTS, ACCEPTED, DEFAULT_CONFIDENCE = 2, 0.8, 0.5


def picked_events(drafts: DataFrame, members: DataFrame) -> DataFrame:
    """``bucket_id, family, event_id, fault`` of the events that drafts name.

    ``drafts``: ``bucket_id, family, events`` (numbers of the shown events, from 1); ``members``: ``bucket_id, number,
    event_id``. A number that was not shown, or that an earlier family of the bucket took, is a fault; a repeat is passed over.
    """
    named = drafts.select("bucket_id", "family", F.explode(F.array_distinct("events")).alias("number"))
    first = named.groupBy("bucket_id", "number").agg(F.min("family").alias("owner"))
    rows = named.join(first, ["bucket_id", "number"]).join(members, ["bucket_id", "number"], "left")
    fault = F.when(F.col("event_id").isNull(), "not shown").when(F.col("owner") != F.col("family"), "reused")
    return rows.select("bucket_id", "family", "number", "event_id", fault.alias("fault"))


def _connected(picked: DataFrame, keys: DataFrame) -> DataFrame:
    """``bucket_id, family, parts``: into how many parts the events of a family fall, linked by a shared key."""
    by = ["bucket_id", "family"]
    sizes = picked.groupBy(*by).agg(F.countDistinct("event_id").alias("parts"))
    said = picked.join(keys, "event_id").select(*by, "event_id", "key").distinct()
    star = said.groupBy(*by, "key").agg(F.min("event_id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    widest = star.groupBy(*by).agg(F.max("n").alias("n"))
    known = sizes.join(widest, by, "left")
    # a key that all events have makes one part, and without a key of two events each is its own; only the others need components
    plain = known.filter("n IS NULL OR n = parts").select(*by, F.when(F.col("n").isNull(), F.col("parts")).otherwise(F.lit(1).cast("long")).alias("parts"))
    rest = materialize(known.filter("n < parts").select(*by))
    node = lambda c: F.struct("bucket_id", "family", F.col(c).alias("event_id"))
    edges = said.join(star, [*by, "key"]).join(rest, by, "left_semi").select(node("hub").alias("src"), node("event_id").alias("dst"))
    if rest.isEmpty():
        return plain
    parts = connected_components(edges)
    rows = picked.join(rest, by, "left_semi").select(*by, "event_id").join(parts.select("id.*", "component"), [*by, "event_id"], "left")
    return plain.unionByName(rows.groupBy(*by).agg(F.countDistinct(F.coalesce(F.col("component.event_id"), F.col("event_id"))).alias("parts")))


def assess(drafts: DataFrame, members: DataFrame, units: DataFrame, keys: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row a family with two events or more: counts, days, categories, confidence, findings and review.

    ``drafts``: ``bucket_id, family, label, description, department, confidence, events, cited`` (evidence ids), ``differences``,
    ``truncated``. ``units``: ``event_id, when, incidents, categories``. ``keys``: ``event_id, key`` (place and problem together).
    ``quotes``: ``event_id, evidence_id`` of shown quotes. A family with any finding waits for a person.
    """
    picked = picked_events(drafts, members)
    faults = picked.groupBy("bucket_id", "family").agg(F.count_if(F.col("fault") == "reused").alias("reused"), F.count_if(F.col("fault") == "not shown").alias("strange"))
    held = picked.filter("fault IS NULL")
    sized = held.groupBy("bucket_id", "family").agg(F.count(F.lit(1)).alias("events"), F.array_sort(F.collect_list("event_id")).alias("event_ids"))
    sized = sized.filter(F.col("events") >= LEAST_EVENTS)
    rows = held.join(units, "event_id")
    measured = rows.groupBy("bucket_id", "family").agg(F.sum("incidents").alias("incidents"), F.to_date(F.min("when")).alias("first_event"), F.to_date(F.max("when")).alias("last_event"))
    kinds = rows.select("bucket_id", "family", F.explode_outer("categories").alias("c")).groupBy("bucket_id", "family").agg(F.array_sort(F.collect_set("c")).alias("categories"))
    cites = drafts.select("bucket_id", "family", F.explode(F.array_distinct("cited")).alias("evidence_id")).join(quotes, "evidence_id", "left")
    own = cites.join(held.select("bucket_id", "family", "event_id"), ["bucket_id", "family", "event_id"], "left_semi")
    cited = own.groupBy("bucket_id", "family").agg(F.countDistinct("event_id").alias("quoted"))
    unknown = cites.groupBy("bucket_id", "family").agg(F.count_if(F.col("event_id").isNull()).alias("unknown_quotes"))

    by = ["bucket_id", "family"]
    out = sized.join(drafts.drop("events"), by).join(measured, by).join(kinds, by).join(faults, by).join(_connected(held, keys), by)
    out = out.join(cited, by, "left").join(unknown, by, "left").na.fill({"quoted": 0, "unknown_quotes": 0})
    sound = F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False))
    confidence = F.when(sound, F.col("confidence")).otherwise(F.lit(DEFAULT_CONFIDENCE))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = [
        ("reused event", F.col("reused") > 0), ("event not shown", F.col("strange") > 0), ("quote not shown", F.col("unknown_quotes") > 0), ("quotes of fewer than two events", F.col("quoted") < LEAST_EVENTS),
        ("not linked", F.col("parts") > 1), ("several categories", F.size("categories") > 1), ("events not shown", F.col("truncated") > 0), ("differences named", F.size("differences") > 0),
        ("no label or description", blank("label") | blank("description")), ("bad confidence", ~sound), ("low confidence", confidence < ACCEPTED),
        ("unknown department", ~blank("department") & ~F.lower(F.trim("department")).isin(DEPARTMENTS)),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(n)) for n, v in checks]))
    family = F.concat(F.lit("ISS-"), short_hash(F.array_join("event_ids", "|")))
    out = out.withColumn("findings", found).withColumn("confidence", confidence)
    return out.select(
        family.alias("family_id"), "bucket_id", "family", "events", "incidents", "first_event", "last_event", F.date_diff("last_event", "first_event").alias("span_days"), "categories", "confidence", "findings",
        F.when(F.size("findings") == 0, "accepted").otherwise("review_required").alias("review"), "event_ids",
    )


def rules() -> dict:
    """What a family row must hold: name to "is violated"."""
    c = F.col
    return {
        "events are counted": c("events") != F.size("event_ids"), "recurrence": c("events") < LEAST_EVENTS, "family id": c("family_id") != F.concat(F.lit("ISS-"), short_hash(F.array_join(F.array_sort("event_ids"), "|"))),
        "span": c("span_days") != F.date_diff("last_event", "first_event"), "order of days": c("last_event") < c("first_event"), "silent acceptance": (c("review") == "accepted") & (F.size("findings") > 0),
        "review without reason": (c("review") != "accepted") & (F.size("findings") == 0), "accepted without confidence": (c("review") == "accepted") & (c("confidence") < ACCEPTED),
    }
