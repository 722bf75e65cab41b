"""Whole passes: link, recurrence, trend and briefing, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import known
from ..operators import answers, filters, linking, recurrence, trends


def read_links(pool: DataFrame, pairs: DataFrame, decisions: DataFrame, *, only_place: bool = False) -> DataFrame:
    """Links of ``pairs`` (:func:`linking.candidate_pairs` of ``pool``) as decided. ``decisions``: ``link_id, verdict, confidence, quotes_low, quotes_high`` of any reader.

    With ``only_place``, no conflict but a differing place speaks against a link.
    """
    side = lambda n: pool.select(F.col("incident_id").alias(f"{n}_id"), F.struct("event_time", "incident_type", "taluk").alias(n))
    drafts = pairs.join(decisions, "link_id").join(side("low"), "low_id").join(side("high"), "high_id").withColumn("conflicts", linking.conflicts("low", "high"))
    if only_place:
        drafts = drafts.withColumn("conflicts", F.array_intersect("conflicts", F.array(F.lit("place"))))
    return linking.decide(drafts).drop("low", "high")


def link_pass(incidents: DataFrame, decisions: DataFrame, *, only_place: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(links, groups, units)``: :func:`read_links` of the accepted incidents, and the events that they make."""
    pool = filters.accepted_pool(incidents)
    links = read_links(pool, linking.candidate_pairs(linking.signals(pool)), decisions, only_place=only_place)
    groups = linking.event_groups(pool, links)
    return links, groups, linking.event_units(pool, groups)


PATTERNS = ["category", "incident_type", "place"]


def event_rows(pool: DataFrame, groups: DataFrame, t: trends.Trend) -> tuple[DataFrame, DataFrame]:
    """``(spans, grouped)``: windows over the events' days, and one row a report and pattern with its event.

    An event is dated by its earliest report, so all its reports fall in one window.
    """
    first = pool.join(groups.select("incident_id", "event_id"), "incident_id")
    days = first.groupBy("event_id").agg(F.to_date(F.min("event_time")).alias("day"))
    rows = first.join(days, "event_id").select("event_id", "incident_id", "record_id", "source_id", "day", "category", F.when(known(F.col("incident_type")), F.col("incident_type")).alias("incident_type"), "taluk")
    grouped = trends.dimensions(rows, {"category": F.array_compact(F.array("category")), "incident_type": F.array_compact(F.array("incident_type")), "place": F.array_compact(F.array(F.concat(F.lit("taluk:"), "taluk")))})
    return trends.windows(days, "day", t), grouped


def trend_pass(incidents: DataFrame, records: DataFrame, t: trends.Trend, keep: filters.Filters | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Ranked patterns with findings and ids. Events are counted, not reports: ``groups`` (:func:`linking.event_groups`)
    says which reports are one event; without it each report is an event of its own, which is a finding of every pattern. Coverage counts all
    records, whatever the filters keep.
    """
    pool = filters.accepted_pool(incidents)
    pool = pool.filter(keep.keeps()) if keep else pool
    told = groups if groups is not None else pool.select("incident_id", F.col("incident_id").alias("event_id"))
    spans, grouped = event_rows(pool, told, t)
    block = trends.blocks(grouped, "day", spans)
    found = trends.findings(trends.arithmetic(block, trends.coverage(records, "day", spans), t, trends.new_sources(grouped, "day", spans)), t)
    if groups is None:
        found = found.withColumn("findings", F.concat(F.array(F.lit("not_deduplicated")), "findings")).withColumn("alert_eligible", F.lit(False))
    return trends.ranked(trends.named(found, grouped, "day", spans))


def recurrence_pass(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(buckets, months)`` of the events in buckets."""
    found = recurrence.buckets(units)
    inside = found.select("bucket_id", F.explode("event_ids").alias("event_id")).join(units.select("event_id", "when"), "event_id")
    return found, recurrence.monthly(inside, ["bucket_id"], "when")


def briefing_pass(incidents: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """``(measures, status split)`` of the newest ``days``."""
    pool = filters.accepted_pool(incidents)
    return answers.measure(pool, "event_time", days), answers.status_split(answers.period(pool, "event_time", days).filter("in_period"))
