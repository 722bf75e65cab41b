"""Source rows to common records, and records to citable fields, facts and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import article_id, short_hash
from ..functions.text import date_precision, squeeze, valueless

REQUIRED = ["record_id", "source_id", "source_type", "record_type", "title"]
OPTIONAL = ["event_time", "severity", "status", "source_url", "raw_reference"]


def _place(raw: Column, district: str | None, state: str | None) -> Column:
    return F.struct(raw.alias("raw_text"), F.lit(district).alias("district"), F.lit(state).alias("state")).alias("location")


def articles(rows: DataFrame, *, prefix: str, source: str, district: str | None = None, state: str | None = None, language: str = "ta") -> DataFrame:
    """``url, title, published_at, content`` as common records."""
    data = F.create_map(F.lit("content"), F.col("content"), F.lit("language"), F.lit(language))
    return rows.select(article_id(F.col("url"), prefix).alias("record_id"), F.lit(source).alias("source_id"), F.lit("news").alias("source_type"), F.lit("article").alias("record_type"), squeeze(F.col("title")).alias("title"), F.col("published_at").alias("event_time"), _place(F.lit(district), district, state), data.alias("data"), F.col("url").alias("source_url"))


def forecasts(rows: DataFrame, *, prefix: str, source: str, year: Column) -> DataFrame:
    """``station, forecast_date ("02-Oct"), measures map`` as common records; the year is the caller's. Ids repeat yearly."""
    day = F.try_to_timestamp(F.concat_ws("-", "forecast_date", year.cast("string")), F.lit("dd-MMM-yyyy"))
    return rows.select(F.concat(F.lit(prefix), "forecast_date").alias("record_id"), F.lit(source).alias("source_id"), F.lit("weather").alias("source_type"), F.lit("forecast").alias("record_type"), F.concat(F.lit("Forecast "), "forecast_date").alias("title"), day.alias("event_time"), _place(F.col("station"), None, None), F.col("measures").alias("data"), F.lit(None).cast("string").alias("source_url"))


def slug(text: Column) -> Column:
    return F.replace(F.upper(text), F.lit(" "), F.lit("_"))


def market_prices(rows: DataFrame, *, prefix: str, source: str) -> DataFrame:
    """``market, commodity, price_date, quantity, min_price, max_price`` as common records."""
    number = lambda c: F.col(c).cast("string")
    data = F.create_map(F.lit("market"), F.col("market"), F.lit("commodity"), F.col("commodity"), F.lit("quantity"), number("quantity"), F.lit("min_price"), number("min_price"), F.lit("max_price"), number("max_price"), F.lit("unit"), F.lit("kg"))
    name = F.concat_ws("-", slug(F.col("market")), slug(F.col("commodity")), F.col("price_date").cast("string"))
    return rows.select(F.concat(F.lit(prefix), name).alias("record_id"), F.lit(source).alias("source_id"), F.lit("agriculture").alias("source_type"), F.lit("market_price").alias("record_type"), F.concat_ws(" ", "commodity", F.lit("at"), "market").alias("title"), F.col("price_date").cast("timestamp").alias("event_time"), _place(F.col("market"), None, None), data.alias("data"), F.lit(None).cast("string").alias("source_url"))


def canonical(records: DataFrame, *, text_paths: tuple[str, ...] = ("title", "data.content")) -> DataFrame:
    """``record_id, texts, scalars, missing, notes, input_hash`` of common records.

    Text paths hold what may be quoted, all other fields are scalars, in the order of the record; empty strings are absent.
    ``missing`` names required fields without a value, ``notes`` the data keys without one.
    """
    top = [c for c in records.columns if c in REQUIRED + OPTIONAL and c != "record_id"]
    pair = lambda path, value: F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"))
    fields = F.array(*[pair(c, F.col(c)) for c in top], *[pair(f"location.{c}", F.col(f"location.{c}")) for c in ("raw_text", "district", "state")])
    data = F.transform(F.map_entries("data"), lambda e: F.struct(F.concat(F.lit("data."), e["key"]).alias("path"), e["value"].alias("value")))
    every = F.filter(F.concat(fields, F.coalesce(data, F.array().cast("array<struct<path:string,value:string>>"))), lambda f: f["value"].isNotNull() & (f["value"] != ""))
    is_text = lambda f: f["path"].isin(list(text_paths))
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(c)) for c in REQUIRED if c in records.columns]))
    body = F.to_json(F.array_sort(every))
    return records.select("record_id", F.filter(every, is_text).alias("texts"), F.filter(every, lambda f: ~is_text(f)).alias("scalars"), absent.alias("missing"), valueless(F.col("data")).alias("notes"), F.sha2(body, 256).alias("input_hash"))


def citable_fields(records: DataFrame) -> DataFrame:
    """``record_id, position, path, text, text_hash``: what evidence can cite: texts, then the record's data scalars."""
    known = canonical(records)
    fields = F.concat("texts", F.filter("scalars", lambda f: f["path"].startswith("data.")))
    return known.select("record_id", F.posexplode(fields).alias("position", "f")).select("record_id", "position", "f.path", F.col("f.value").alias("text"), F.sha2("f.value", 256).alias("text_hash"))


def record_kind(record_type: Column, source_type: Column) -> Column:
    """``struct(kind, context_type)``: the record type decides, else the source type, else a context of no type."""
    made = lambda kind, context: F.struct(F.lit(kind).alias("kind"), F.lit(context).alias("context_type"))
    r, s = F.lower(F.trim(record_type)), F.lower(F.trim(source_type))
    return F.when(r == "forecast", made("forecast", "weather")).when(r == "market_price", made("context", "market")).when(s == "weather", made("forecast", "weather")).when(s == "agriculture", made("context", "market")).otherwise(made("context", "other"))


def structured_facts(records: DataFrame) -> DataFrame:
    """``record_id, fact_index, name, value, evidence_id``: one fact per data field with a value.

    The index counts all data fields, so a blank one leaves a gap; each fact is its own evidence.
    """
    each = records.select("record_id", F.posexplode(F.map_entries("data")).alias("fact_index", "e")).filter(F.trim("e.value") != "")
    evidence = F.concat(F.lit("ev-"), "record_id", F.lit("-"), short_hash(F.concat_ws("\u001f", "record_id", F.concat(F.lit("data."), "e.key"), F.lit("source_metadata")), 12))
    return each.select("record_id", "fact_index", F.col("e.key").alias("name"), F.col("e.value").alias("value"), evidence.alias("evidence_id"))


def source_places(records: DataFrame) -> DataFrame:
    """``record_id, text, location_type``: places a record states of itself; a state is too broad to be one."""
    slots = F.array(F.struct(F.lit("unknown").alias("location_type"), F.col("location.raw_text").alias("text")), F.struct(F.lit("district").alias("location_type"), F.col("location.district").alias("text")))
    return records.select("record_id", F.explode(slots).alias("s")).select("record_id", "s.text", "s.location_type").filter("text IS NOT NULL AND trim(text) <> ''")


def declared_precision(records: DataFrame, column: str) -> DataFrame:
    return records.withColumn("precision", date_precision(F.col(column)))


def display_entries(data: Column) -> Column:
    """Map of data fields as shown: no language, no blanks, units by name."""
    shown = F.map_filter(data, lambda k, v: (k != "language") & v.isNotNull() & (v != ""))
    unit = lambda k, v: F.when(k.endswith("_c"), F.concat(v, F.lit(" °C"))).when(k.contains("humidity"), F.concat(v, F.lit(" %"))).when(k.endswith("_price"), F.concat(v, F.lit(" /"), F.coalesce(F.try_element_at(data, F.lit("unit")), F.lit("unit")))).otherwise(v)
    return F.transform_values(shown, unit)


def distinct_parts(parts: Column) -> Column:
    """Place texts without repeats and without parts that an earlier one contains, joined by commas."""
    kept = F.aggregate(F.filter(parts, lambda p: p.isNotNull() & (F.trim(p) != "")), F.array().cast("array<string>"), lambda out, p: F.when(F.exists(out, lambda o: F.lower(o).contains(F.lower(p))), out).otherwise(F.concat(out, F.array(p))))
    return F.array_join(kept, ", ")
