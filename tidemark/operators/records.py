"""Common records in detail: reading by declared paths, notes, geography, provenance, sinks, and the values that questions ask for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import short_hash
from ..functions.text import fold
from ..functions.wording import said_in

CONTEXT_OF_TOPIC = {"forecast": "weather_forecast", "market": "market_price"}


def nested_location(rows: DataFrame) -> DataFrame:
    """Stored rows with ``location_raw_text, location_district, location_state`` as records with a ``location``."""
    parts = ["raw_text", "district", "state"]
    location = F.struct(*[F.col(f"location_{p}").alias(p) for p in parts]).alias("location")
    return rows.select(*[c for c in rows.columns if not c.startswith("location_")], location)


def at_path(body: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where the path ends nowhere."""
    return F.get_json_object(body, "$." + path)


def scalar_text(rows: DataFrame, name: str) -> Column:
    """A scalar column as a record prints it: true and false, ISO days and times, else Spark's own text."""
    kind, c = rows.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.date_format(c, "yyyy-MM-dd") if isinstance(kind, T.DateType) else c.cast("string")


def field_notes(records: DataFrame, declared: Sequence[str]) -> DataFrame:
    """``record_id, notes, unused``: what is wrong with each declared data key (``missing, null, empty, not a scalar``), and
    keys that no declaration names. Values of ``data`` are JSON texts.
    """
    value = lambda k: F.try_element_at("data", F.lit(k))
    note = lambda k: F.when(~F.array_contains(F.map_keys("data"), k), "missing").when(value(k).isNull(), "null").when(F.trim(value(k)) == "", "empty").when(F.substring(F.trim(value(k)), 1, 1).isin("{", "["), "not a scalar")
    notes = F.array_compact(F.array(*[F.when(note(k).isNotNull(), F.concat(F.lit(f"{k}: "), note(k))) for k in declared]))
    unused = F.array_sort(F.array_except(F.map_keys("data"), F.array(*map(F.lit, declared))))
    return records.select("record_id", notes.alias("notes"), unused.alias("unused"))


def source_geography(records: DataFrame) -> DataFrame:
    """``record_id, position, slot, text, evidence_id``: what a record says of where it is from, in the order raw text, district, state."""
    slots = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("slot"), F.col(f"location.{s}").alias("text")) for i, s in enumerate(("raw_text", "district", "state"))])
    rows = records.select("record_id", F.explode(slots).alias("s")).select("record_id", "s.*").filter("trim(text) <> ''")
    made = F.concat(F.lit("ev-"), "record_id", F.lit("-"), short_hash(F.concat_ws("\u001f", "record_id", F.concat(F.lit("location."), "slot"), F.lit("source_metadata")), 12))
    return rows.withColumn("evidence_id", made)


def provenance(records: DataFrame) -> DataFrame:
    """``record_id, provenance``: where a record is from, its place hints and its declared values, as one struct."""
    parts = ["source_id", "source_type", "record_type", "source_url"]
    hints = [F.col("location.district").alias("district_hint"), F.col("location.state").alias("state_hint")]
    return records.select("record_id", F.struct(*parts, *hints, F.col("event_time").alias("declared_event_time")).alias("provenance"))


def write_records(records: DataFrame, path: str, run: str) -> None:
    """JSON files by source and run; a run that is written again replaces its own files alone."""
    out = records.withColumn("run", F.lit(run))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "run").json(path)


def market_list(payloads: DataFrame) -> DataFrame:
    """``district_id, market_id, market`` of captured lists (``district_id, payload``: a JSON array of markets)."""
    each = payloads.select("district_id", F.explode(F.from_json("payload", "array<struct<id:string,name:string>>")).alias("m"))
    return each.select("district_id", F.col("m.id").alias("market_id"), F.trim("m.name").alias("market")).filter("market_id IS NOT NULL")


def good_and_bad(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and ``record_id, faults`` of the others: a bad row never stops the good ones."""
    faults = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(n)) for n, v in rules.items()]))
    marked = rows.withColumn("faults", faults)
    return marked.filter(F.size("faults") == 0).drop("faults"), marked.filter(F.size("faults") > 0).select("record_id", "faults")


def quotable_facts(facts: Column, evidence: Column) -> Column:
    """Map of accepted facts that can be quoted: not blank, their evidence held, no identifier. The first of a name counts."""
    name = lambda f: F.regexp_replace(f["field"], "^data\\.", "")
    held = F.filter(facts, lambda f: (f["review"] == "accepted") & (F.trim(F.coalesce(f["value"], F.lit(""))) != "") & ~name(f).endswith("_id") & (F.size(F.array_except(f["evidence_ids"], evidence)) == 0))
    pairs = F.transform(held, lambda f: F.struct(name(f).alias("key"), f["value"].alias("value")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda o: o["key"] == p["key"]))
    return F.map_from_entries(first)


def eligible_values(documents: DataFrame, topic: str) -> DataFrame:
    """Documents that answer a value question, newest first: forecasts and contexts of the topic, accepted, with an accepted fact."""
    fact = F.exists("facts", lambda f: (f["review"] == "accepted") & (F.coalesce(f["value"], F.lit("")) != ""))
    rows = documents.filter(F.col("record_kind").isin("forecast", "context") & (F.col("context_type") == CONTEXT_OF_TOPIC[topic]) & (F.col("review") == "accepted") & fact)
    return rows.orderBy(F.desc(F.coalesce(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))), F.desc("incident_id"))


def named_fields(index: DataFrame, questions: DataFrame) -> DataFrame:
    """``question_id, field, words, ids``: fields of a value index that a question names, with the words that it uses.

    ``index``: ``field, word, id``; ``questions``: ``question_id, text``. Words meet by equality of tokens. Ids that hold the same words of a field
    are one set, and questions that use the same words ask once, so ids are never paired with questions.
    """
    folded = index.select("field", fold(F.col("word")).alias("word"), "id").filter("word <> ''")
    asked = questions.select("question_id", F.explode(F.array_distinct(F.split(fold(F.col("text")), r"[^\p{L}\p{M}\p{N}_#]+"))).alias("word")).filter("word <> ''")
    met = asked.join(folded.select("field", "word").distinct(), "word")
    said = met.groupBy("question_id", "field").agg(F.array_sort(F.collect_set("word")).alias("words"))
    held = folded.filter("id IS NOT NULL").groupBy("field", "id").agg(F.array_sort(F.collect_set("word")).alias("held")).groupBy("field", "held").agg(F.count(F.lit(1)).alias("n"))
    uses = said.select("field", "words").distinct().withColumn("word", F.explode("words"))
    once = uses.join(held.withColumn("word", F.explode("held")), ["field", "word"]).dropDuplicates(["field", "words", "held"])
    ids = once.groupBy("field", "words").agg(F.sum("n").alias("ids"))
    return said.join(ids, ["field", "words"], "left").select("question_id", "field", "words", F.coalesce("ids", F.lit(0)).alias("ids"))


def refusals(questions: DataFrame, found: DataFrame) -> DataFrame:
    """``question_id, refusal``: no place of the records, a value that none holds, or no single record that holds all that is named.

    ``found``: ``question_id, place_named, in_place, asked_word, fields, matches``.
    """
    rows = questions.select("question_id").join(found, "question_id", "left")
    refusal = F.when(F.coalesce("place_named", F.lit(False)) & (F.coalesce("in_place", F.lit(0)) == 0), "no record of the place")
    refusal = refusal.when((F.coalesce("fields", F.lit(0)) == 0) & F.coalesce("asked_word", F.lit(False)), "no record holds the value")
    return rows.select("question_id", refusal.when((F.col("fields") > 0) & (F.coalesce("matches", F.lit(0)) == 0), "no single record holds all").alias("refusal"))


def citation_rows(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """``event_id, incident_id, evidence_id, quote, source_url`` of quotes: events by their incidents, incidents by their evidence."""
    rows = units.select("event_id", "incident_id", "source_url").join(evidence.select("incident_id", "evidence_id", "quote"), "incident_id")
    return rows.filter("quote <> ''").select("event_id", "incident_id", "evidence_id", "quote", "source_url")


def item_refs(items: DataFrame, period: DataFrame, available: DataFrame) -> DataFrame:
    """``item_id, events, evidence`` of saved items (``item_id, event_id, evidence_id``) as far as the period and its evidence hold them."""
    inside = items.join(period.select("event_id").distinct(), "event_id", "left_semi")
    quoted = inside.join(available.select("evidence_id", F.lit(True).alias("_there")).distinct(), "evidence_id", "left")
    return quoted.groupBy("item_id").agg(F.countDistinct("event_id").alias("events"), F.countDistinct(F.when(F.col("_there"), F.col("evidence_id"))).alias("evidence"))


def measured_lines(measures: DataFrame) -> DataFrame:
    """``position, line`` of a row of measures (``since, until, events, open_events, areas, sources, undated, dated_outside``): all
    that a wording may count. Lines that would say zero of something left out are not printed.
    """
    c = F.col
    lines = [
        F.format_string("Period: %s to %s.", c("since").cast("string"), c("until").cast("string")), F.format_string("The period holds %d distinct event(s) in %d place(s) from %d publisher(s).", "events", "areas", "sources"),
        F.format_string("Open: %d.", "open_events"), F.when(c("undated") > 0, F.format_string("%d event(s) carry no date, so they fall in no period.", "undated")),
        F.when(c("dated_outside") > 0, F.format_string("%d dated event(s) fall outside this period and are not counted here.", "dated_outside")),
    ]
    return measures.select(F.posexplode(F.array_compact(F.array(*lines))).alias("position", "line"))


def baseline_lines(marks: DataFrame) -> DataFrame:
    """``mark, line``: what a baseline run kept and settled, in words."""
    said = F.create_map(*[F.lit(x) for x in ("settled", "%d record(s) settled: they arrived before the cut.", "kept_recent", "%d record(s) stay: they arrived since the cut.", "kept_undated", "%d record(s) stay: no day can be told.", "kept_awaiting", "%d record(s) stay: they are awaited.")])
    return marks.select("mark", F.replace(F.try_element_at(said, F.col("mark")), F.lit("%d"), F.col("n").cast("string")).alias("line"))


def report_counts(rows: DataFrame, state: str) -> DataFrame:
    """One row of a run's report: how many there are, how many are accepted, and how many have findings."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(state).isin("accepted", "alert_eligible", "grounded")).alias("accepted"), F.count_if(F.size("findings") > 0).alias("with_findings"))


def shares_problem(left: str, right: str) -> Column:
    """Whether two units have a type or a category in common."""
    return F.arrays_overlap(f"{left}.types", f"{right}.types") | F.arrays_overlap(f"{left}.categories", f"{right}.categories")


def asks_for_more(text: Column, words: Sequence[str]) -> Column:
    """Whether a folded question only asks for more of the last answer: it uses such a word and hardly any other."""
    return (F.size(said_in(text, words)) > 0) & (F.size(F.split(text, " ")) <= 6)
