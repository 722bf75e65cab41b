"""Documents and source records as map records: places resolved by a ladder of rules, one wide row each, features, boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import places as P
from ..functions.ids import short_hash
from ..vocabularies import TALUK_SPELLINGS
from .geo import map_severity

SOURCE_TYPES, RECORD_TYPES = ["news", "weather", "agriculture"], ["article", "forecast", "market_price"]
UNRESOLVED = "Unassigned"


def map_sources(records: DataFrame) -> DataFrame:
    """Source records that a map shows: of a known source type or a known record type."""
    return records.filter(F.lower("source_type").isin(SOURCE_TYPES) | F.lower("record_type").isin(RECORD_TYPES))


def contains_alias(text: Column, alias: str) -> Column:
    """An ASCII alias between characters that are no letters or digits, another anywhere; ``text`` is lower case."""
    if not alias.isascii():
        return F.contains(text, F.lit(alias))
    return text.rlike(rf"(?<![a-z0-9])\Q{alias}\E(?![a-z0-9])")


def coordinates(top: tuple[Column, Column], short: tuple[Column, Column], location: tuple[Column, Column], data: tuple[Column, Column]) -> Column:
    """``struct(latitude, longitude)`` as given, by precedence: own fields, their short names, the location's, the data's."""
    pick = lambda i: F.coalesce(top[i], short[i], location[i], data[i])
    return F.struct(pick(0).alias("latitude"), pick(1).alias("longitude"))


def resolution(*, latitude: Column, longitude: Column, raw_text: Column, source_type: Column, canonical_id: Column, district: Column, market: Column, station_id: Column, source_id: Column) -> Column:
    """``struct(status, lat, lng, taluk, name, level, origin, precision)`` of a place, by the first rung that holds.

    Coordinates that are given decide, right or wrong; then a known id, the weather station, the first alias in the text
    (in the market's name for market records; for news a town that shares its name with a road is passed over). Districts and taluks
    are areas: they give no point. The registry is small and fixed, so it is part of the expression; nothing is joined.
    """
    none = F.lit(None)
    number = lambda c: c.try_cast("double")
    lat, lng, raw = number(latitude), number(longitude), F.coalesce(F.trim(raw_text), F.lit(""))

    def out(status: str, lat=none, lng=none, taluk=F.lit(UNRESOLVED), name=None, level=F.lit("Unresolved"), origin=none, precision="unavailable") -> Column:
        fallback = F.when(raw != "", raw).otherwise("Unresolved location")
        cols = {"status": F.lit(status), "lat": lat.cast("double"), "lng": lng.cast("double"), "taluk": taluk, "name": fallback if name is None else name, "level": level, "origin": origin.cast("string"), "precision": F.lit(precision)}
        return F.struct(*[v.alias(k) for k, v in cols.items()])

    def point(place: str, precision: str = "approximate_named_place") -> Column:
        _, name, y, x, taluk, level = next(r for r in P.REGISTRY if r[0] == place)
        return out("RESOLVED_REGISTRY", F.lit(y), F.lit(x), F.lit(taluk), F.lit(name), F.lit(level), F.lit("registry_approximate"), precision)

    given = latitude.isNotNull() | longitude.isNotNull()
    wrong = lat.isNull() | lng.isNull() | F.isnan(lat) | F.isnan(lng) | ~lat.between(-90, 90) | ~lng.between(-180, 180)
    swapped = lat.between(*P.LONGITUDES) & lng.between(*P.LATITUDES)
    named = F.when(raw != "", raw).otherwise("Source coordinates")
    explicit = out("RESOLVED_EXPLICIT", lat, lng, name=named, level=F.lit("Direct source coordinates"), origin=F.lit("source"), precision="source_coordinates")
    kind = F.lower(F.trim(F.coalesce(source_type, F.lit(""))))
    station = (kind == "weather") & F.coalesce((F.trim(station_id) == P.STATION) | (F.lower(F.trim(source_id)) == P.STATION_SOURCE), F.lit(False))
    candidate = F.lower(F.when((kind == "agriculture") & (F.coalesce(F.trim(market), F.lit("")) != ""), F.trim(market)).otherwise(raw))
    text = F.lower(raw)

    ladder = F.when(given & wrong, out("INVALID_SOURCE_COORDINATES")).when(given & swapped, out("INVALID_SOURCE_COORDINATES")).when(given, explicit)
    for place, *_ in P.REGISTRY:
        ladder = ladder.when(canonical_id == place, point(place))
    ladder = ladder.when(station, point(P.STATION_PLACE, "approximate_weather_station"))
    for place, aliases in P.ALIASES.items():
        held = F.lit(False)
        for alias in aliases:
            held |= contains_alias(candidate, alias)
        ladder = ladder.when(held & ~((kind == "news") & F.lit(place == "melur")), point(place))
    area = F.coalesce(text == F.lower(F.trim(district)), F.lit(False)) & (text != "")
    for alias in [*P.DISTRICT_ALIASES, *TALUK_SPELLINGS]:
        area |= contains_alias(text, alias)
    return ladder.when(area, out("UNRESOLVED_AREA_ONLY", precision="area_only")).otherwise(out("UNRESOLVED_INSUFFICIENT_DATA"))


def date_display(stamp: Column) -> Column:
    """``struct(shown, day)`` of a stamp as text; what is no stamp shows its first ten characters, nothing shows nothing."""
    at = F.try_to_timestamp(stamp)
    rest = F.substring(F.coalesce(stamp, F.lit("")), 1, 10)
    return F.struct(F.coalesce(F.date_format(at, "dd MMM yyyy"), rest).alias("shown"), F.coalesce(F.date_format(at, "yyyy-MM-dd"), rest).alias("day"))


def _column(rows: DataFrame, name: str, kind: str = "string") -> Column:
    """A column of ``rows``, or null where it has none of that name."""
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def _fields(rows: DataFrame, given: dict[str, Column], place: Column, search: list[Column]) -> DataFrame:
    """The wide row that documents and records share."""
    r = rows.withColumns({f"_{k}": v for k, v in given.items()}).withColumn("_place", place)
    g = {k: F.col(f"_{k}") for k in given}
    dates = date_display(g["event_time"])
    label = F.initcap(F.replace(F.coalesce(g["category"], F.lit("Other")), F.lit("_"), F.lit(" ")))
    spoken = [g["id"], g["record_id"], g["incident_id"], g["source_id"], g["source_type"], g["title"], g["summary"], g["category"], g["incident_type"], g["status"], g["priority"], g["raw_location_text"], F.col("_place.name"), F.col("_place.taluk"), *search]
    out = {k: g[k] for k in given} | {
        "source_name": F.coalesce(g["source_id"], g["source_type"], F.lit("Unknown source")), "display_date": dates["shown"], "date_only": dates["day"],
        "category": F.coalesce(g["category"], F.lit("other")), "category_label": label, "is_incident": g["record_kind"] == "incident",
        "is_geocoded": F.col("_place.lat").isNotNull(), "base_lat": F.col("_place.lat"), "base_lng": F.col("_place.lng"), "display_lat": F.col("_place.lat"), "display_lng": F.col("_place.lng"),
        "taluk": F.col("_place.taluk"), "location_name": F.col("_place.name"), "administrative_level": F.col("_place.level"), "location_precision": F.col("_place.precision"),
        "resolution_status": F.col("_place.status"), "coordinate_origin": F.col("_place.origin"), "search_string": F.lower(F.concat_ws(" ", *spoken)),
    }
    return r.select(*[v.alias(k) for k, v in out.items()])


def document_records(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Saved documents as map records; source data, coordinates and addresses fall back to the record that they were read from.

    ``records`` (common records, one row an id) is joined by ``record_id``. Severity, status and priority are an incident's alone.
    """
    linked = records.select(F.col("record_id").alias("_rid"), *[_column(records, c).alias(f"_r_{c}") for c in ("source_id", "source_type", "record_type", "source_url", "retrieved_at", "raw_reference", "latitude", "longitude")], F.col("data").alias("_r_data") if "data" in records.columns else F.lit(None).cast("map<string,string>").alias("_r_data"))
    rows = documents.join(linked, F.col("record_id") == F.col("_rid"), "left")
    kind = F.lower(F.coalesce("record_kind", F.lit("unresolved")))
    incident = kind == "incident"
    first = F.try_element_at("locations", F.lit(1))
    own = first["latitude"].isNull() & first["longitude"].isNull()
    lat = F.when(own, F.col("_r_latitude")).otherwise(first["latitude"].cast("string"))
    lng = F.when(own, F.col("_r_longitude")).otherwise(first["longitude"].cast("string"))
    data = lambda k: F.try_element_at("_r_data", F.lit(k))
    either = lambda c: F.coalesce(_column(documents, c), F.col(f"_r_{c}"))
    cited = F.filter(F.transform("evidence", lambda e: e["record_id"]), lambda i: i.isNotNull())
    given = {
        "id": F.col("incident_id"), "record_id": F.col("record_id"), "incident_id": F.col("incident_id"), "record_kind": kind, "source_type": F.lower(F.coalesce(either("source_type"), F.lit("unknown"))),
        "record_type": either("record_type"), "source_id": either("source_id"), "title": F.coalesce(_column(documents, "title"), F.lit("Untitled intelligence record")), "summary": F.coalesce(_column(documents, "description"), F.lit("")),
        "event_time": F.coalesce(F.col("event_time"), F.col("declared_event_time")).cast("string"), "retrieved_at": F.coalesce(F.col("retrieved_at").cast("string"), F.col("_r_retrieved_at")),
        "category": F.col("category"), "incident_type": F.col("incident_type"), "department": F.col("department"), "event_time_precision": F.col("event_time_precision"), "severity": F.when(incident, map_severity(F.col("severity"))),
        "status": F.when(incident, F.col("event_status")), "priority": F.when(incident, F.col("priority")), "review_required": F.when(incident, F.col("review") != "accepted"), "review_state": F.col("review"),
        "context_type": _column(documents, "context_type"), "raw_location_text": F.coalesce(first["text"], F.lit("")), "source_coordinates": F.when(lat.isNotNull() | lng.isNotNull(), F.struct(lat.alias("latitude"), lng.alias("longitude"))),
        "source_url": either("source_url"), "raw_reference": F.col("_r_raw_reference"), "source_record_ids": F.array_distinct(F.concat(F.array("record_id"), cited)), "claims": F.col("claims"), "evidence": F.col("evidence"), "locations": F.col("locations"),
    }
    place = resolution(latitude=lat, longitude=lng, raw_text=first["text"], source_type=given["source_type"], canonical_id=first["canonical_id"], district=F.lit(None).cast("string"), market=data("market"), station_id=data("station_id"), source_id=given["source_id"])
    return _fields(rows, given, place, [F.to_json("_r_data")])


def context_records(records: DataFrame) -> DataFrame:
    """Source records as map records: they keep what their source says and take over nothing from an incident.

    A record without an id gets one by its content.
    """
    c = lambda name, kind="string": _column(records, name, kind)
    data = lambda k: F.try_element_at("data", F.lit(k))
    kind = F.lower(F.trim(F.coalesce(c("source_type"), F.lit("unknown"))))
    found = coordinates((c("latitude"), c("longitude")), (c("lat"), c("lng")), (F.lit(None), F.lit(None)), (F.coalesce(data("latitude"), data("lat")), F.coalesce(data("longitude"), data("lng"))))
    raw = F.coalesce(F.when(F.trim("location.raw_text") != "", F.col("location.raw_text")), F.col("location.district"), F.lit(""))
    made = F.concat(F.lit("gis-record-"), short_hash(F.to_json(F.struct(*sorted(records.columns)))))
    text = lambda k: F.when(F.coalesce(data(k), F.lit("")) != "", data(k))
    given = {
        "id": F.coalesce("record_id", made), "record_id": F.col("record_id"), "incident_id": F.lit(None).cast("string"), "record_kind": F.lit("context"), "source_type": kind, "record_type": c("record_type"), "source_id": c("source_id"),
        "title": F.coalesce(c("title"), F.lit("Untitled source record")), "summary": F.coalesce(text("summary"), text("content"), F.lit("")), "event_time": c("event_time"), "retrieved_at": c("retrieved_at"),
        "category": F.when(kind.isin(SOURCE_TYPES), kind).otherwise("other"), "incident_type": F.lit(None).cast("string"), "department": F.lit(None).cast("string"), "event_time_precision": F.lit(None).cast("string"),
        "severity": map_severity(c("severity")), "status": c("status"), "priority": F.lit(None).cast("string"), "review_required": F.lit(None).cast("boolean"), "review_state": F.lit(None).cast("string"), "context_type": c("record_type"),
        "raw_location_text": raw, "source_coordinates": F.when(found["latitude"].isNotNull() | found["longitude"].isNotNull(), found), "source_url": c("source_url"), "raw_reference": c("raw_reference"),
        "source_record_ids": F.array_compact(F.array("record_id")), "identifier_is_generated": F.col("record_id").isNull(),
    }
    place = resolution(latitude=found["latitude"], longitude=found["longitude"], raw_text=raw, source_type=kind, canonical_id=F.lit(None).cast("string"), district=F.col("location.district"), market=data("market"), station_id=data("station_id"), source_id=c("source_id"))
    return _fields(records, given, place, [F.to_json("data")])


def outcomes(contexts: DataFrame, documents: DataFrame) -> DataFrame:
    """``id, outcomes``: of each source record what became of it, as sorted ``struct(incident_id, status)``; no reading, no entry.

    One record has few documents; their list is bounded by the documents of one record.
    """
    kind, accepted = F.lower("record_kind"), F.col("review") == "accepted"
    status = F.when(kind == "incident", F.when(accepted, "accepted").otherwise("needs_review")).when((kind == "unresolved") & ~accepted, "needs_review").when(kind == "context", "information_only")
    read = documents.select(F.col("record_id").alias("id"), F.struct("incident_id", status.alias("status")).alias("o")).filter("o.status IS NOT NULL")
    every = read.groupBy("id").agg(F.array_sort(F.collect_list("o")).alias("outcomes"))
    return contexts.select("id").join(every, "id", "left").select("id", F.coalesce("outcomes", F.array().cast(every.schema["outcomes"].dataType)).alias("outcomes"))


def unmapped(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("is_geocoded") | F.col("base_lat").isNull() | F.col("base_lng").isNull())


def mapped(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("is_geocoded") & F.col("base_lat").isNotNull() & F.col("base_lng").isNotNull())


def feature_rows(rows: DataFrame, properties: list[str]) -> DataFrame:
    """``key, feature``: a Point a row, named ``kind:id``; rows without a finite point in range give none."""
    y, x = F.col("display_lat"), F.col("display_lng")
    fine = F.col("is_geocoded") & ~F.isnan(y) & ~F.isnan(x) & y.between(-90, 90) & x.between(-180, 180)
    key = F.concat(F.coalesce("record_kind", F.lit("record")), F.lit(":"), "id")
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    body = F.struct(F.lit("Feature").alias("type"), key.alias("id"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.filter(F.coalesce(fine, F.lit(False))).select(key.alias("key"), F.to_json(body).alias("feature"))


def write_collection(features: DataFrame, path: str, *, district: str, state: str) -> None:
    """Features as text lines next to one line of metadata; each task writes its own rows, so no task holds the collection."""
    head = features.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.struct(F.lit(district).alias("district"), F.lit(state).alias("state"), F.count(F.lit(1)).alias("feature_count")).alias("metadata"))).alias("value"))
    head.write.mode("overwrite").text(f"{path}/metadata")
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(f"{path}/features")


def markers(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Records that have a feature, by ``kind:id``."""
    keyed = rows.withColumn("key", F.concat("record_kind", F.lit(":"), "id"))
    return keyed.join(features.select("key", "feature"), "key")


def map_stats(rows: DataFrame) -> DataFrame:
    """One row of counts over map records: incidents, contexts, mapped and unmapped of each, shown severities, taluks with a point."""
    incident, there = F.col("is_incident"), F.col("is_geocoded")
    taluk = F.when(there & incident & ~F.col("taluk").isin("", UNRESOLVED, "Unknown", "District-wide"), F.col("taluk"))
    count = lambda cond, name: F.count_if(cond).alias(name)
    return rows.agg(
        F.count(F.lit(1)).alias("map_records"), count(incident, "incidents"), count(~incident, "common_records"), count(there, "map_mapped"), count(~there, "map_unmapped"), count(incident & there, "incident_mapped"),
        count(incident & ~there, "incident_unmapped"), count(incident & (F.col("severity") == "high"), "high"), count(incident & (F.col("severity") == "medium"), "medium"), F.countDistinct(taluk).alias("active_taluks"),
    )


BOUNDARY = "struct<type:string,crs:string,features:array<struct<type:string,properties:struct<taluk_name:string>,geometry:struct<type:string,coordinates:string>>>>"
RINGS = "array<array<array<double>>>"


def boundary_faults(files: DataFrame, *, lat: tuple[float, float] = (9.0, 11.0), lng: tuple[float, float] = (77.0, 79.0)) -> DataFrame:
    """``file, taluk, fault``: one row a feature of a GeoJSON text (``file, text``); ``fault`` is null where the boundary can be used.

    Polygons and multi-polygons with closed rings of at least four positions inside the box; no other reference system.
    """
    body = files.select("file", F.from_json("text", BOUNDARY).alias("b"))
    whole = F.when(F.coalesce(F.col("b.type"), F.lit("")) != "FeatureCollection", "not a collection").when(F.col("b.crs").isNotNull(), "reference system")
    rows = body.select("file", whole.alias("whole"), F.explode_outer("b.features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(text, RINGS))).when(kind == "MultiPolygon", F.from_json(text, f"array<{RINGS}>"))
    rings = F.flatten(polygons)
    inside = lambda p: (F.size(p) >= 2) & F.coalesce(p[0].between(*lng) & p[1].between(*lat), F.lit(False))
    short = F.exists(rings, lambda r: F.size(r) < 4)
    outside = F.exists(rings, lambda r: F.exists(r, lambda p: ~inside(p)))
    unclosed = F.exists(rings, lambda r: F.slice(r[0], 1, 2) != F.slice(F.element_at(r, -1), 1, 2))
    empty = F.coalesce(F.size(rings) < 1, F.lit(True))
    fault = F.coalesce(F.col("whole"), F.when(F.col("f.type") != "Feature", "not a feature").when(F.coalesce(F.col("f.properties.taluk_name"), F.lit("")) == "", "no name").when(~F.coalesce(kind.isin("Polygon", "MultiPolygon"), F.lit(False)), "geometry type").when(empty, "no rings").when(short, "short ring").when(outside, "outside").when(unclosed, "open ring"))
    return rows.select("file", F.col("f.properties.taluk_name").alias("taluk"), fault.alias("fault"))


