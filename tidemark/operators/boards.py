"""Lists, filters and profiles behind dashboards: record search, map filters, facets, sorts, corpus profiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, known, priority_rank, severity_rank
from .filters import in_window

LABELS = {"article": "News", "forecast": "Weather", "market_price": "Market price"}


def common_record_search(rows: DataFrame, words: str) -> DataFrame:
    """Case-insensitive search in ids, title, places and the data as JSON."""
    text = F.lower(F.concat_ws(" ", "record_id", "source_id", "title", "location.raw_text", "location.district", F.to_json("data")))
    return rows.filter(F.contains(text, F.lit(words.strip().lower())))


def incident_filter(rows: DataFrame, *, place: str | None = None, since: dt.date | None = None, until: dt.date | None = None, **equal: str | None) -> DataFrame:
    """Equality on columns, a place that equals any of an incident's place names, and UTC days; case is ignored."""
    out = rows
    for name, value in equal.items():
        if value:
            out = out.filter(F.lower(name) == value.lower())
    if place:
        names = F.flatten(F.transform("locations", lambda p: F.array(p["text"], p["normalized_name"], p["village"], p["taluk"], p["block"], p["district"])))
        out = out.filter(F.exists(names, lambda n: F.coalesce(F.lower(n) == place.lower(), F.lit(False))))
    return out.filter(in_window(F.col("event_time"), since, until))


def kind_filter(rows: DataFrame, *, kind: str | None = None, category: str | None = None, severity: str | None = None, commodity: str | None = None, alert: str | None = None) -> DataFrame:
    """Map filter that knows kinds: category and severity ask of incidents alone, ``alert`` (``warning`` or ``none``) of weather alone, ``commodity`` of markets."""
    incident, weather, market = F.col("record_kind") == "incident", F.col("source_type") == "weather", F.col("source_type") == "agriculture"
    out = rows.filter(F.col("record_kind") == kind) if kind else rows
    if category:
        out = out.filter(~incident | (F.col("category") == category))
    if severity:
        out = out.filter(~incident | F.coalesce(F.col("severity") == severity, F.lit(False)))
    if commodity:
        out = out.filter(~market | F.coalesce(F.lower("commodity") == commodity.lower(), F.lit(False)))
    if alert:
        warned = F.coalesce(F.trim("warning"), F.lit("")) != ""
        out = out.filter(~weather | (warned if alert == "warning" else ~warned))
    return out


def facet_filter(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows of a list by exact facets; a facet that is not asked for lets everything pass."""
    out = rows
    for name, value in wanted.items():
        if value:
            out = out.filter(F.col(name).cast("string") == value)
    return out


def in_domain(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words as a word of its own, whatever the case."""
    return text.rlike(r"(?i)\b(?:" + "|".join(words) + r")\b")


def table_sort(rows: DataFrame, how: str) -> DataFrame:
    """``priority`` (then severity), ``oldest`` or ``recent``; undated rows sort as the oldest of all."""
    at = F.coalesce("event_time", F.lit("1970-01-01").cast("timestamp"))
    rank = [F.desc(F.coalesce(priority_rank(F.col("priority")), severity_rank(F.col("severity")), F.lit(0))), F.desc(F.coalesce(severity_rank(F.col("severity")), F.lit(0)))]
    order = {"priority": [*rank, at.desc()], "oldest": [at.asc(), *rank], "recent": [at.desc(), *rank]}[how]
    return rows.orderBy(*order, "incident_id")


def record_sort(rows: DataFrame, how: str) -> DataFrame:
    order = {"recent": [F.desc_nulls_last("event_time")], "oldest": [F.asc_nulls_last("event_time")], "source": [F.asc("source_id"), F.desc_nulls_last("event_time")]}[how]
    return rows.orderBy(*order, "record_id")


def briefing_order(units: DataFrame, whole: bool) -> DataFrame:
    """By id if the whole corpus is told, else the newest first."""
    return units.orderBy("event_id") if whole else units.orderBy(F.desc_nulls_last("when"), F.desc("event_id"))


def display_kind(record_kind: Column, context_type: Column) -> Column:
    """The kind that is said, else a context if it has a context type, else an incident."""
    return F.coalesce(record_kind, F.when(context_type.isNotNull(), "context").otherwise("incident"))


def record_label(record_type: Column, source_type: Column, source_id: Column) -> Column:
    """News, Weather, Market price or Other record: by the record type, else by what its source is or is called."""
    said = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    source = F.lower(F.coalesce(source_type, source_id, F.lit("")))
    guess = F.when(source.rlike("news|dina"), "News").when(source.rlike("weather|imd"), "Weather").when(source.rlike("agri|market"), "Market price").otherwise("Other record")
    return F.coalesce(F.try_element_at(said, F.lower(F.trim(record_type))), guess)


def incident_place(locations: Column, hint: Column) -> Column:
    """The first place of an incident, finest level first and without repeats, else the hint of its source."""
    first = F.try_element_at(locations, F.lit(1))
    parts = F.array(first["village"], first["taluk"], first["block"], first["normalized_name"], first["district"])
    kept = F.array_distinct(F.filter(parts, lambda p: F.coalesce(F.trim(p), F.lit("")) != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(hint)


def corpus_profile(rows: DataFrame) -> DataFrame:
    """One row: first and last day, basis of the newest, undated rows, and how many distinct values each vocabulary has."""
    said = lambda c: F.countDistinct(F.when(known(F.col(c)), F.col(c)))
    at = F.col("t.when")
    return rows.agg(
        F.to_date(F.min(at)).alias("since"), F.to_date(F.max(at)).alias("until"), F.max_by("t.basis", F.struct(at, "incident_id")).alias("newest_basis"), F.count_if(at.isNull()).alias("undated"),
        said("category").alias("categories"), said("incident_type").alias("types"), F.countDistinct("source_id").alias("sources"),
    )


def place_vocabulary(rows: DataFrame, names: str) -> DataFrame:
    """``name, rows``: the folded names of an array column, each once."""
    each = rows.select(F.explode(F.array_distinct(F.transform(names, fold))).alias("name")).filter("name <> ''")
    return each.groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


def said_by_units(units: DataFrame, column: str) -> DataFrame:
    """The distinct values of a set column over all units."""
    return units.select(F.explode(column).alias("value")).distinct()


def quoted_events(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct(F.when(F.coalesce(F.col("quote"), F.lit("")) != "", F.col("event_id"))).alias("quoted_events"))
