"""Nested incident documents: reading, shredding, create-only inserts, lookups, and what they say of places and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import short_hash
from ..functions.text import fold, known
from ..vocabularies import EVENT_ROLES
from .normalize import record_kind

DEFAULTS = {"incident_type": "unresolved", "category": "unresolved", "department": "unresolved", "severity": "unresolved", "event_status": "unknown", "event_time_precision": "unknown"}
#: Answers of a submission that are worth a second try.
RETRIED = [429, 500, 502, 503, 504]
LEVELS = ["village", "block", "taluk", "district"]


def shred(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(facts, evidence)``: the scalar columns with their values of absence, and one row a piece of evidence."""
    scalar = [c for c, t in documents.dtypes if not t.startswith(("array", "struct", "map"))]
    filled = [F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in scalar]
    each = documents.select("incident_id", F.posexplode("evidence").alias("position", "e"))
    return documents.select(*filled), each.select("incident_id", "position", "e.*")


def submit(incoming: DataFrame, existing: DataFrame, key: str, order: str, statuses: tuple[str, str] | None = None) -> DataFrame:
    """``key, outcome``: create-only inserts in the order given. ``stored``, ``duplicate`` (held, or repeated in the batch) or ``failed``.

    ``statuses`` names two columns with the answers to a first and a second try: an answer in ``RETRIED`` is tried once
    more, one of another error is final. A stored row is never overwritten.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    held = existing.select(key).distinct().withColumn("_held", F.lit(True))
    rows = incoming.withColumn("_nth", nth).join(held, key, "left")
    known = F.col("_held").isNotNull() | (F.col("_nth") > 1)
    if statuses:
        first, second = map(F.col, statuses)
        answer = F.when(first.isin(RETRIED), second).otherwise(first)
        outcome = F.when(answer == 409, "duplicate").when(~answer.isin(200, 201), "failed").when(known, "duplicate").otherwise("stored")
    else:
        outcome = F.when(known, "duplicate").otherwise("stored")
    return rows.select(*incoming.columns, outcome.alias("outcome"))


def ensure_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows to append to the source dimension: sources that records name and the dimension lacks, with status ``active``."""
    named = records.groupBy("source_id").agg(F.min_by("source_type", F.struct("created_at", "record_id")).alias("source_type"), F.min("created_at").alias("created_at"))
    fresh = named.join(sources.select("source_id"), "source_id", "left_anti")
    return fresh.select("source_id", F.col("source_id").alias("name"), "source_type", F.lit("active").alias("status"), "created_at")


def newest_first(rows: DataFrame, time: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(time), key)


def lookup(rows: DataFrame, key: str, value: str | int) -> DataFrame:
    """The row of a key; no row says "not found"."""
    return rows.filter(F.col(key) == F.lit(value)).limit(1)


def looked_up(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """``asked`` with ``found`` and the columns of the row of each key; a key that isn't held has none. Each key is asked for once or often."""
    held = rows.withColumn("found", F.lit(True))
    return asked.select(key).join(held, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def deleted(documents: DataFrame, evidence: DataFrame, gone: DataFrame, key: str = "incident_id") -> tuple[DataFrame, DataFrame]:
    """``(documents, evidence)`` without the keys of ``gone``: what belongs to a document goes with it; unknown keys delete nothing."""
    ids = gone.select(key).distinct()
    return documents.join(ids, key, "left_anti"), evidence.join(ids, key, "left_anti")


def echo_faults(sent: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that were sent and are not stored just so."""
    return sent.exceptAll(stored.select(sent.columns))


def payload_faults(payloads: DataFrame, *, required: list[str], allowed: list[str], version: str) -> DataFrame:
    """``position, fault, keys`` of JSON payloads that can't be taken: the first fault of each, in the order of the checks."""
    body = F.from_json("payload", "map<string,string>")
    rows = payloads.select("position", F.when(F.substring(F.trim("payload"), 1, 1) == "{", body).alias("m"))
    strange = F.array_sort(F.array_except(F.map_keys("m"), F.array(*map(F.lit, allowed))))
    blank = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.try_element_at("m", F.lit(k))), F.lit("")) == "", F.lit(k)) for k in required]))
    fault = F.when(F.col("m").isNull(), "not an object").when(F.size(strange) > 0, "unknown keys")
    fault = fault.when(~F.coalesce(F.try_element_at("m", F.lit("schema_version")) == version, F.lit(False)), "version").when(F.size(blank) > 0, "missing keys")
    keys = F.when(fault == "unknown keys", strange).when(fault == "missing keys", blank)
    return rows.select("position", fault.alias("fault"), F.coalesce(F.array_join(keys, "|"), F.lit("")).alias("keys")).filter("fault IS NOT NULL")


def structured_documents(records: DataFrame) -> DataFrame:
    """Common records as incident documents without any reader: claims for title and event time, a fact for each data field.

    ``incident_id, kind, context_type, claims, facts, evidence, review``. Facts are numbered over all data fields, blank ones
    leave a gap; evidence is distinct; a record without claim and fact is ``unresolved``.
    """
    cite = lambda path: F.concat(F.lit("ev-"), F.col("record_id"), F.lit("-"), short_hash(F.concat_ws("\u001f", F.col("record_id"), path, F.lit("source_metadata")), 12))
    claim = lambda field, value, ids: F.struct(F.lit(field).alias("field"), value.alias("value"), ids.alias("evidence_ids"))
    titled = F.coalesce(F.trim("title"), F.lit("")) != ""
    none = F.array().cast("array<string>")
    at = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")
    claims = F.array_compact(F.array(F.when(titled, claim("title", F.col("title"), F.array(cite(F.lit("title"))))), F.when(F.col("event_time").isNotNull(), claim("event_time", at, none))))
    entries = F.coalesce(F.map_entries("data"), F.array().cast("array<struct<key:string,value:string>>"))
    numbered = F.transform(entries, lambda e, i: F.struct(F.concat(F.lit("fact-"), (i + 1).cast("string")).alias("fact_id"), F.concat(F.lit("data."), e["key"]).alias("field"), e["value"].alias("value")))
    facts = F.filter(numbered, lambda f: F.trim(F.coalesce(f["value"], F.lit(""))) != "")
    rows = records.select("record_id", F.concat(F.lit("INC-"), "record_id").alias("incident_id"), record_kind(F.col("record_type"), F.col("source_type")).alias("k"), claims.alias("claims"), facts.alias("facts"))
    evidence = F.array_distinct(F.concat(F.flatten(F.transform("claims", lambda c: c["evidence_ids"])), F.transform("facts", lambda f: cite(f["field"]))))
    state = F.when((F.size("claims") > 0) | (F.size("facts") > 0), "accepted").otherwise("unresolved")
    return rows.select("incident_id", F.col("k.kind").alias("kind"), "k.context_type", "claims", "facts", evidence.alias("evidence"), state.alias("review"))


def _names(items: Column, keep) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(items, keep), lambda x: fold(F.coalesce(x["normalized_name"], x["text"]))), lambda n: n != "")))


def place_names() -> Column:
    """Names of places that two reports may share: accepted, on the event, narrower than a district and than the hints."""
    on = F.filter("locations", lambda p: (p["review"] == "accepted") & (p["location_type"] != "district") & p["role"].isin(*EVENT_ROLES, "unresolved"))
    own = F.filter(on, lambda p: F.coalesce(fold(F.coalesce(p["normalized_name"], p["text"])) != fold(p["district"]), F.lit(True)))
    broad = F.array(fold(F.coalesce("district_hint", F.lit(""))), fold(F.coalesce("state_hint", F.lit(""))))
    return F.array_sort(F.array_except(_names(own, lambda p: F.lit(True)), broad))


def people() -> Column:
    return _names(F.col("entities"), lambda e: (e["review"] == "accepted") & (e["entity_type"] == "person"))


def signals(documents: DataFrame) -> DataFrame:
    """``incident_id, record_id, reported_at, kind, value``: what two documents may share, places and people each of their own."""
    one = lambda kind, c: F.when(known(F.col(c)), F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")))
    many = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("value")))
    every = F.concat(F.array_compact(F.array(one("type", "incident_type"), one("category", "category"))), many("place", place_names()), many("person", people()))
    rows = documents.select("incident_id", "record_id", F.coalesce("declared_event_time", "retrieved_at", "event_time").alias("reported_at"), F.explode(every).alias("s"))
    return rows.select("incident_id", "record_id", "reported_at", "s.kind", "s.value")


def shared_signals(left: Column, right: Column) -> Column:
    """The signals (``kind value``) of two arrays that agree, sorted."""
    return F.array_sort(F.array_intersect(left, right))


def resolved_places() -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter("locations", lambda p: (p["resolution"] == "resolved") & p["canonical_id"].isNotNull()), lambda p: p["canonical_id"])))


def area_entries() -> Column:
    """``struct(level, name, evidence_ids)`` of accepted places on the event, and of the wider levels that they state."""
    on = F.filter("locations", lambda p: (p["review"] == "accepted") & p["role"].isin(EVENT_ROLES))
    entry = lambda level, name, p: F.struct(level.alias("level"), name.alias("name"), p["evidence_ids"].alias("evidence_ids"))

    def of(p):
        name = F.coalesce(p["normalized_name"], p["text"])
        wider = [F.when(F.coalesce(fold(p[level]) != fold(name), F.lit(False)), entry(F.lit(level), p[level], p)) for level in LEVELS]
        return F.array_compact(F.array(F.when(name != "", entry(p["location_type"], name, p)), *wider))

    return F.array_distinct(F.flatten(F.transform(on, of)))


def searchable_places() -> Column:
    """Folded names by which a document is found: its accepted places, their wider levels, and the hints of its source."""
    held = F.flatten(F.transform(F.filter("locations", lambda p: p["review"] == "accepted"), lambda p: F.array(p["text"], p["normalized_name"], *[p[level] for level in LEVELS])))
    every = F.transform(F.concat(held, F.array("district_hint", "state_hint")), lambda n: fold(F.coalesce(n, F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(every, lambda n: n != "")))


def holds_place(wanted: Column) -> Column:
    """Whether a name of the document contains the wanted one, folded."""
    return F.exists(searchable_places(), lambda n: F.contains(n, fold(wanted)))


def unit_keys() -> Column:
    """``level:name`` keys by which events meet: areas and the district hint."""
    areas = F.transform(area_entries(), lambda a: F.concat_ws(":", a["level"], fold(a["name"])))
    hint = F.array_compact(F.array(F.when(F.coalesce(F.trim("district_hint"), F.lit("")) != "", F.concat(F.lit("district:"), fold(F.col("district_hint"))))))
    return F.array_sort(F.array_distinct(F.concat(areas, hint)))


def evidence_by_id(ids: Column) -> Column:
    """The evidence of a document in the order of ``ids``; ids that it lacks are passed over."""
    index = F.map_from_entries(F.transform("evidence", lambda e: F.struct(e["evidence_id"], e)))
    return F.array_compact(F.transform(ids, lambda i: F.try_element_at(index, i)))


def quote_for(ids: Column) -> Column:
    """The first quote among the evidence of ``ids``, else an empty text."""
    quotes = F.filter(F.transform(evidence_by_id(ids), lambda e: F.coalesce(e["quote"], F.lit(""))), lambda q: q != "")
    return F.coalesce(F.try_element_at(quotes, F.lit(1)), F.lit(""))


def shown_evidence(most: int = 12) -> Column:
    """Ids of evidence with a quote: accepted claims, then places, then entities; distinct, ``most`` of them."""
    ids = lambda c: F.flatten(F.transform(F.filter(c, lambda x: x["review"] == "accepted"), lambda x: x["evidence_ids"]))
    quoted = F.transform(F.filter("evidence", lambda e: F.coalesce(e["quote"], F.lit("")) != ""), lambda e: e["evidence_id"])
    return F.slice(F.array_intersect(F.array_distinct(F.concat(ids("claims"), ids("locations"), ids("entities"))), quoted), 1, most)


def stated_levels(places: DataFrame, texts: str, levels: tuple[str, ...] = ("district", "taluk")) -> DataFrame:
    """Administrative levels that a text names stay; others become null and are listed in ``dropped``."""
    held = lambda c: F.contains(fold(F.col(texts)), fold(F.col(c)))
    out = places.withColumn("dropped", F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & ~held(c), F.lit(c)) for c in levels])))
    return out.withColumns({c: F.when(held(c), F.col(c)) for c in levels})


def resolve_endpoints(relations: DataFrame, names: DataFrame) -> DataFrame:
    """``relation_id, source_id, target_id, fault`` of relations between named things.

    ``names``: ``record_id, name, kind, position, item_id``; of things with one folded name entities go before places and
    the first before later ones. An unknown end is ``unresolved_reference``, both ends alike ``self``.
    """
    first = names.groupBy("record_id", fold(F.col("name")).alias("name")).agg(F.min_by("item_id", F.struct(F.col("kind") != "entity", "position")).alias("item_id"))
    end = lambda side: first.select("record_id", F.col("name").alias(f"_{side}"), F.col("item_id").alias(f"{side}_id"))
    rows = relations.withColumn("_source", fold(F.col("source"))).withColumn("_target", fold(F.col("target")))
    rows = rows.join(end("source"), ["record_id", "_source"], "left").join(end("target"), ["record_id", "_target"], "left")
    fault = F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "unresolved_reference").when(F.col("source_id") == F.col("target_id"), "self")
    return rows.select("relation_id", "source_id", "target_id", fault.alias("fault"))
