"""Geocoding by registry, display points, GeoJSON features and area rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import contains_alias, fold
from ..schema import MAP_SEVERITIES
from .patterns import occurrences

EARTH_METRES, FIRST_METRES, STEP_METRES = 111320.0, 16.0, 7.0


def coordinates_fault(lat: Column, lng: Column, lat_box: tuple[float, float], lng_box: tuple[float, float]) -> Column:
    """Null if both are usable, else why not: ``absent, incomplete, not_finite, out_of_range, swapped``."""
    bad = F.isnan(lat) | F.isnan(lng) | (F.abs(lat) == float("inf")) | (F.abs(lng) == float("inf"))
    swapped = lat.between(*lng_box) & lng.between(*lat_box)
    return F.when(lat.isNull() & lng.isNull(), "absent").when(lat.isNull() | lng.isNull(), "incomplete").when(bad, "not_finite").when(~lat.between(-90, 90) | ~lng.between(-180, 180), "out_of_range").when(swapped, "swapped")


def geocode(rows: DataFrame, registry: DataFrame, aliases: DataFrame, *, key: str, text: str, lat_box: tuple[float, float] = (0.0, 0.0), lng_box: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Add ``lat_out, lng_out, place_id, resolution`` to rows with ``lat, lng`` and a text.

    Given coordinates decide, even wrong ones (a text never repairs them). Else the first alias in ``aliases``
    (``place_id, alias, position``) that the text contains, at word edges for ASCII, gives the point of ``registry``
    (``place_id, lat, lng``). A text without an alias is ``insufficient``. ASCII aliases are met by their first word and then
    compared; others may sit inside a word and are found by their grams (:mod:`tidemark.operators.patterns`).
    """
    fault = coordinates_fault(F.col("lat"), F.col("lng"), lat_box, lng_box)
    key, rows = "_t", rows.withColumn("_t", fold(F.col(text)))  # a text that many rows have is looked up once
    words = rows.select("_t").filter("_t <> ''").distinct()
    plain = ~F.col("alias").rlike(r"[^\x00-\x7F]")
    tokens = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    keyed = aliases.filter(plain).withColumn("_w", F.get(tokens(F.col("alias")), 0))
    met = words.withColumn("_w", F.explode(F.array_distinct(tokens(F.col("_t"))))).join(keyed, "_w").drop("_w")
    inside = aliases.filter(~plain).select("place_id", "position", F.lower("alias").alias("alias"))
    held = occurrences(words.withColumn("_k", F.col("_t")), inside, key="_k", text="_t", pattern="alias").withColumnRenamed("_k", "_t")
    hit = met.filter(contains_alias(F.col("_t"), F.col("alias"))).select(key, "place_id", "position").unionByName(held.select(key, "place_id", "position"))
    first = hit.groupBy(key).agg(F.min_by("place_id", "position").alias("place_id"))
    points = registry.select("place_id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    out = rows.withColumn("_fault", fault).join(first, key, "left").join(points, "place_id", "left")
    given, found = F.col("_fault").isNull(), (F.col("_fault") == "absent") & F.col("place_id").isNotNull()
    resolution = F.when(given, "explicit").when(F.col("_fault") != "absent", F.concat(F.lit("rejected_"), F.col("_fault"))).when(found, "registry").otherwise("insufficient")
    pick = lambda own, theirs: F.when(given, F.col(own)).when(found, F.col(theirs))
    return out.select(*[c for c in rows.columns if c != "_t"], pick("lat", "_lat").alias("lat_out"), pick("lng", "_lng").alias("lng_out"), F.when(found, F.col("place_id")).alias("place_id"), resolution.alias("resolution"))


def disperse(points: DataFrame, *, lat: str, lng: str, order: list[str]) -> DataFrame:
    """Add ``place_index, place_count, display_lat, display_lng``: rows on one spot are laid out on a golden-angle spiral."""
    spot = [F.format_number(F.col(lat), 7), F.format_number(F.col(lng), 7)]
    by = Window.partitionBy(*spot)
    i, n = F.col("place_index"), F.col("place_count")
    out = points.withColumn("place_index", F.row_number().over(by.orderBy(*order)) - 1).withColumn("place_count", F.count(F.lit(1)).over(by))
    angle = i * F.pi() * (3 - F.sqrt(F.lit(5.0)))
    radius = FIRST_METRES + STEP_METRES * F.sqrt(i)
    north = radius * F.cos(angle) / EARTH_METRES
    east = radius * F.sin(angle) / F.greatest(EARTH_METRES * F.cos(F.radians(F.col(lat))), F.lit(1.0))
    return out.withColumn("display_lat", F.when(n > 1, F.col(lat) + north).otherwise(F.col(lat))).withColumn("display_lng", F.when(n > 1, F.col(lng) + east).otherwise(F.col(lng)))


def features(rows: DataFrame, *, lat: str, lng: str, properties: list[str]) -> DataFrame:
    """``feature``: a GeoJSON Point a row; rows without a finite point in range give none."""
    y, x = F.col(lat), F.col(lng)
    fine = y.isNotNull() & x.isNotNull() & y.between(-90, 90) & x.between(-180, 180)
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return rows.filter(fine).select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def map_severity(value: Column) -> Column:
    """The four severities that maps show; others are null."""
    return F.when(F.lower(value).isin(MAP_SEVERITIES), F.lower(value))


def area_rollup(rows: DataFrame, area: str) -> DataFrame:
    """Per area, incidents alone: counts of high and medium, all others as low, and the highest of the three found."""
    s = F.lower(F.coalesce("severity", F.lit("")))
    rank = F.when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)
    label = F.element_at(F.array(*map(F.lit, ["unknown", "low", "medium", "high"])), F.max(rank) + 1)
    return rows.filter("record_kind = 'incident'").groupBy(area).agg(F.count(F.lit(1)).alias("incidents"), F.count_if(s == "high").alias("high"), F.count_if(s == "medium").alias("medium"), F.count_if(~s.isin("high", "medium")).alias("low"), label.alias("severity"))


def areas_joined(areas: DataFrame, rollup: DataFrame, name: str) -> DataFrame:
    """Every area of a boundary list; those without incidents have zeros and ``unknown``."""
    zero = {"incidents": 0, "high": 0, "medium": 0, "low": 0}
    return areas.join(rollup, name, "left").na.fill(zero).na.fill({"severity": "unknown"})


def grouped_markets(rows: DataFrame) -> DataFrame:
    """Per market its rows, its commodities and their price range."""
    return rows.groupBy("market").agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.array_sort(F.collect_set("commodity")), "|").alias("commodities"), F.min("min_price").alias("low"), F.max("max_price").alias("high"))


def display_records(rows: DataFrame) -> DataFrame:
    """Incidents as a map shows them: short date, shown severity, review flag and one text to search in."""
    kind = F.coalesce("record_kind", F.lit("incident"))
    text = F.lower(F.concat_ws(" ", "incident_id", "category", "incident_type", "taluk", "district", "source_id"))
    return rows.select(
        F.concat(kind, F.lit(":"), "incident_id").alias("key"), kind.alias("record_kind"), map_severity(F.col("severity")).alias("severity"), F.date_format("event_time", "dd MMM yyyy").alias("date_shown"),
        F.date_format("event_time", "yyyy-MM-dd").alias("date_iso"), (F.col("review") != "accepted").alias("review_required"), text.alias("search_string"),
    )


def map_filter(rows: DataFrame, *, since: str | None = None, until: str | None = None, search: str | None = None, **equal: str) -> DataFrame:
    """Case-insensitive equality ("all" lets everything pass), ISO date bounds (undated rows fall out) and substring search."""
    out = rows
    for name, value in equal.items():
        if value and value.lower() != "all":
            out = out.filter(F.lower(name) == value.lower())
    if since:
        out = out.filter(F.col("date_iso") >= since)
    if until:
        out = out.filter(F.col("date_iso") <= until)
    return out.filter(F.col("search_string").contains(search.strip().lower())) if search else out
