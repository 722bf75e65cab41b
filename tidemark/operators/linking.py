"""Repeated reports of one happening: candidate pairs, link decisions, events and their units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import event_id, link_id
from ..functions.text import effective_time, known
from ..storage import materialize
from .components import connected_components
from .neighbours import nearest_pairs

PAIRS, GAP_DAYS, ACCEPTED = 5, 7, 0.8


def effective() -> Column:
    """``struct(when, basis)`` of a document: see :func:`tidemark.functions.text.effective_time`."""
    return effective_time(F.col("event_time"), F.col("event_time_precision"), F.col("declared_event_time"), F.col("retrieved_at"))


def signals(incidents: DataFrame, place: str = "taluk", person: str = "person") -> DataFrame:
    """``incident_id, record_id, reported_at, kind, value``: what two reports may share."""
    pairs = F.array(
        F.struct(F.lit("type").alias("kind"), F.when(known(F.col("incident_type")), F.col("incident_type")).alias("value")),
        F.struct(F.lit("category").alias("kind"), F.when(known(F.col("category")), F.col("category")).alias("value")),
        F.struct(F.lit("place").alias("kind"), F.col(place).alias("value")),
        F.struct(F.lit("person").alias("kind"), F.col(person).alias("value")),
    )
    return incidents.select("incident_id", "record_id", F.col("event_time").alias("reported_at"), F.explode(pairs).alias("s")).select("incident_id", "record_id", "reported_at", "s.kind", "s.value").filter("value IS NOT NULL")


def candidate_pairs(sig: DataFrame, *, pairs: int = PAIRS, gap_days: int = GAP_DAYS) -> DataFrame:
    """``low_id, high_id, shared, gap_seconds, link_id``: for each incident its best pairs, both ends' choices together.

    A pair shares a signal, comes of two records and was reported at most ``gap_days`` apart; a pair with an unknown gap
    counts, after all others. Found by sorted neighbours: see :mod:`tidemark.operators.neighbours`.
    """
    return nearest_pairs(sig, pairs=pairs, gap_days=gap_days)


def conflicts(left: str, right: str) -> Column:
    """Why two sides can't be one happening: sorted words, empty if nothing speaks against it."""
    day = (F.to_date(f"{left}.event_time") != F.to_date(f"{right}.event_time")) & F.col(f"{left}.event_time").isNotNull() & F.col(f"{right}.event_time").isNotNull()
    kind = known(F.col(f"{left}.incident_type")) & known(F.col(f"{right}.incident_type")) & (F.col(f"{left}.incident_type") != F.col(f"{right}.incident_type"))
    place = F.col(f"{left}.taluk") != F.col(f"{right}.taluk")
    return F.array_compact(F.array(F.when(day, F.lit("day")), F.when(place, F.lit("place")), F.when(kind, F.lit("type"))))


def decide(links: DataFrame) -> DataFrame:
    """Add ``findings`` and ``accepted`` to drafts with ``verdict, confidence, quotes_low, quotes_high, conflicts``.

    A draft without a usable confidence counts as 0.5. ``same_event`` needs a quote from both sides and no conflict.
    """
    verdict = F.col("verdict")
    sound = F.col("confidence").isNotNull() & ~F.isnan("confidence") & F.col("confidence").between(0, 1)
    confidence = F.when(sound, F.col("confidence")).otherwise(F.lit(0.5))
    same = verdict == "same_event"
    found = F.array_compact(F.array(
        F.when(~F.coalesce(verdict.isin("same_event", "separate_event", "undetermined"), F.lit(False)), F.lit("bad verdict")),
        F.when(~sound, F.lit("bad confidence")),
        F.when(verdict == "undetermined", F.lit("undetermined")),
        F.when(same & ((F.col("quotes_low") < 1) | (F.col("quotes_high") < 1)), F.lit("no quote from both sides")),
        F.when(same & (F.size("conflicts") > 0), F.lit("conflict")),
        F.when(confidence < ACCEPTED, F.lit("low confidence")),
    ))
    return links.withColumn("findings", found).withColumn("confidence", confidence).withColumn("accepted", F.size("findings") == 0)


def event_groups(pool: DataFrame, links: DataFrame) -> DataFrame:
    """``incident_id, root, event_id, size, review``: components of accepted ``same_event`` links inside ``pool``.

    Incidents without links are events of one. An accepted ``separate_event`` link inside a component sends it to review.
    """
    ids = pool.select("incident_id")
    # links come partitioned by their high end, so that end is looked up first
    inside = links.filter("accepted").join(ids.withColumnRenamed("incident_id", "high_id"), "high_id", "left_semi").join(ids.withColumnRenamed("incident_id", "low_id"), "low_id", "left_semi").select("low_id", "high_id", "verdict")
    parts = connected_components(inside.filter("verdict = 'same_event'"), "low_id", "high_id")
    rooted = ids.join(parts, F.col("incident_id") == F.col("id"), "left").select("incident_id", F.coalesce("component", "incident_id").alias("root"))
    rooted = materialize(rooted)
    low, high = rooted.select(F.col("incident_id").alias("low_id"), F.col("root").alias("low_root")), rooted.select(F.col("incident_id").alias("high_id"), F.col("root").alias("high_root"))
    torn = inside.filter("verdict = 'separate_event'").join(low, "low_id").join(high, "high_id").filter("low_root = high_root").select(F.col("low_root").alias("root")).distinct().withColumn("torn", F.lit(True))
    named = rooted.groupBy("root").agg(event_id(F.collect_list("incident_id")).alias("event_id"), F.count(F.lit(1)).alias("size"))
    state = F.when(F.col("torn"), "review_required").otherwise("accepted")
    return rooted.join(named.join(torn, "root", "left").select("root", "event_id", "size", state.alias("review")), "root").select("incident_id", "root", "event_id", "size", "review")


def event_units(pool: DataFrame, groups: DataFrame) -> DataFrame:
    """One row an event: earliest time, and the sorted sets of what its reports say."""
    rows = pool.join(groups.select("incident_id", "event_id"), "incident_id")
    said = lambda c: F.array_sort(F.collect_set(F.when(known(F.col(c)), F.col(c))))
    return rows.groupBy("event_id").agg(
        F.min("event_time").alias("when"), F.count(F.lit(1)).alias("incidents"), said("incident_type").alias("types"), said("category").alias("categories"), said("severity").alias("severities"), said("priority").alias("priorities"),
        F.array_sort(F.collect_set("taluk")).alias("taluks"), F.array_sort(F.collect_set("district")).alias("districts"), F.array_sort(F.collect_set("source_id")).alias("sources"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("incident_id", "event_status")))).alias("statuses"),
    )
