"""Incidents from drafts: every drafted answer is grounded at once, and ordered conditions decide what the document is.

A draft's answers become rows, are grounded together, and come back as claims, places, people and facts with the evidence that each rests on.
What the document then is (its kind, its review, its issues) is told by tables of conditions in order, compiled to one expression each;
``kind_basis`` names the row of the table that held. Lists of a draft are read up to ``ITEMS``, so nothing gathered is long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import span_id
from ..functions.text import fold
from ..functions.wording import iso_stamp, token, value_in_field
from ..schema import PRIORITIES, SEVERITIES
from ..vocabularies import CATEGORIES, CONTEXT_TYPES, DEPARTMENTS, ENTITY_TYPES, EVENT_STATUSES, EVENT_TYPES, MENTION_ROLES, MENTION_TYPES
from .grounding import ground

#: Items of a list that are read, the confidence of an answer that states none, fields about a happening, sources whose own time is that of publication.
ITEMS, UNSTATED = 8, 0.5
EVENT_ONLY = ["category", "department", "severity", "priority", "event_status"]
PUBLISHED = ["news"]
LEVELS = ["district", "taluk", "block", "village"]

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()
CITED = {"cited": S, "quote": S, "stated": I, "confidence": D}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: Scalars of a draft with the values that each may have; None: words of the record.
SCALARS = {
    "title": None, "description": None, "incident_type": EVENT_TYPES, "category": CATEGORIES, "department": DEPARTMENTS,
    "severity": [*SEVERITIES, "unresolved"], "priority": PRIORITIES, "event_status": EVENT_STATUSES,
}
PLACE_DRAFT = _struct(text=S, normalized_name=S, location_type=S, role=S, district=S, taluk=S, block=S, village=S, **CITED)
ENTITY_DRAFT = _struct(text=S, normalized_name=S, entity_type=S, **CITED)
FACT_DRAFT = _struct(value=S, **CITED)
DRAFT = T.StructType([
    *[T.StructField(n, _struct(value=S, **CITED)) for n in SCALARS], T.StructField("event_time", _struct(value=S, precision=S, **CITED)), T.StructField("record_kind", S), T.StructField("context_type", S),
    T.StructField("locations", T.ArrayType(PLACE_DRAFT)), T.StructField("entities", T.ArrayType(ENTITY_DRAFT)), T.StructField("context_facts", T.ArrayType(FACT_DRAFT)),
])

ISSUE = "struct<code:string,field:string>"


def compiled(table: list[tuple[Column, object]], default=None) -> Column:
    """Ordered conditions as one expression: the value of the first that holds; an unknown condition doesn't."""
    out = None
    for condition, value in table:
        held, value = F.coalesce(condition, F.lit(False)), value if isinstance(value, Column) else F.lit(value)
        out = F.when(held, value) if out is None else out.when(held, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def _issue(code, field: Column | str) -> Column:
    return F.struct((code if isinstance(code, Column) else F.lit(code)).alias("code"), (field if isinstance(field, Column) else F.lit(field)).alias("field"))


def drafted_answers(drafts: DataFrame) -> DataFrame:
    """``record_id, part, position, name, value, precision, item, cited, quote, stated, confidence``: a row for each answer of a draft (``record_id, draft``).

    Titles and descriptions without a quote are their own quote.
    """
    place, none = F.lit(None).cast(PLACE_DRAFT), F.lit(None).cast("string")

    def row(part: str, position: Column, name: Column, value: Column, source: Column, precision: Column = none, item: Column = place, quote: Column | None = None) -> Column:
        cited = [source["cited"].alias("cited"), (source["quote"] if quote is None else quote).alias("quote"), source["stated"].alias("stated"), source["confidence"].alias("confidence")]
        return F.struct(F.lit(part).alias("part"), position.cast("int").alias("position"), name.alias("name"), value.alias("value"), precision.alias("precision"), item.alias("item"), *cited)

    scalars = []
    for i, (name, allowed) in enumerate(SCALARS.items()):
        a = F.col("draft")[name]
        quote = F.coalesce(F.nullif(a["quote"], F.lit("")), a["value"]) if allowed is None else a["quote"]
        scalars.append(F.when(F.coalesce(a["value"], F.lit("")) != "", row("scalar", F.lit(i), F.lit(name), a["value"], a, quote=quote)))
    at = F.col("draft.event_time")
    time = F.when(F.coalesce(at["value"], F.lit("")) != "", row("time", F.lit(0), F.lit("event_time"), at["value"], at, at["precision"]))
    listed = lambda name: F.slice(F.coalesce(F.col("draft")[name], F.array().cast(DRAFT[name].dataType)), 1, ITEMS)
    named = lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), F.nullif(x["normalized_name"], F.lit("")))
    as_place = lambda x: F.struct(*[(x["entity_type"] if n == "location_type" else x[n] if n in ENTITY_DRAFT.fieldNames() else F.lit(None).cast(PLACE_DRAFT[n].dataType)).alias(n) for n in PLACE_DRAFT.fieldNames()])
    places = F.transform(listed("locations"), lambda x, i: row("location", i, F.concat(F.lit("locations[loc-"), i + 1, F.lit("]")), named(x), x, item=x))
    people = F.transform(listed("entities"), lambda x, i: row("entity", i, F.concat(F.lit("entities[ent-"), i + 1, F.lit("]")), named(x), x, item=as_place(x)))
    facts = F.transform(listed("context_facts"), lambda x, i: row("fact", i, F.concat(F.lit("context_facts[fact-"), i + 1, F.lit("]")), x["value"], x))
    every = F.concat(F.array_compact(F.array(*scalars, time)), places, people, facts)
    return drafts.select("record_id", F.explode(every).alias("a")).select("record_id", "a.*")


def judged_answers(answers: DataFrame, records: DataFrame) -> DataFrame:
    """Add to each answer its ``resolved`` value, ``review``, ``method``, ``evidence`` (or null), ``problems`` and whether it is ``left_out``.

    ``records``: ``record_id, source_type, event_time, retrieved_at, fields``.
    """
    rows = answers.join(records.select("record_id", "source_type", F.col("event_time").alias("own_time"), "retrieved_at", "fields"), "record_id")
    loose = (F.col("part") == "scalar") & ~F.col("name").isin("title", "description")
    rows = ground(rows.filter(loose), inexact=True).unionByName(ground(rows.filter(~loose)))
    part, name, value, code = F.col("part"), F.col("name"), F.col("value"), F.col("code")
    told = compiled([(name == n, token(value, allowed)["value"]) for n, allowed in SCALARS.items() if allowed], value)
    stamp = iso_stamp(value)
    unread = ((part == "scalar") & told.isNull()) | ((part == "time") & stamp["at"].isNull())
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    own_title = F.try_element_at(F.filter("fields", lambda f: (f["path"] == "title") & (F.trim(f["text"]) != "")), F.lit(1))["text"]
    held = F.try_element_at(F.filter("fields", lambda f: f["path"] == F.col("path")), F.lit(1))["text"]
    grounded = code.isNull() & ~unread
    copied = (name == "title") & own_title.isNotNull() & ~(grounded & (F.col("path") == "title"))
    same_day = F.to_date(stamp["at"]) == F.to_date("own_time")
    declared = (part == "time") & ~unread & ~grounded & F.coalesce((stamp["at"] == F.col("own_time")) | (~stamp["zoned"] & same_day), F.lit(False))
    printed = F.lower(F.trim("source_type")).isin(PUBLISHED)
    published = (part == "time") & printed & (declared | (grounded & (stamp["at"] == F.col("own_time"))))
    capture = (part == "time") & grounded & (F.date_trunc("second", stamp["at"]) == F.date_trunc("second", "retrieved_at"))
    misfiled = (part == "fact") & grounded & ~value_in_field(value, F.coalesce(held, F.lit("")))
    optional = (name == "priority") & ~grounded
    review = compiled([(copied, "accepted"), (published, "unresolved"), (declared, "accepted"), (capture | misfiled, "review_required"), (grounded & ~blank, "accepted")], "review_required")
    refused = F.coalesce(code, F.lit("unsupported_claim"))
    problems = compiled([
        (blank, F.array(_issue("unsupported_claim", name))), (optional | published | declared, F.array().cast(f"array<{ISSUE}>")), (copied, F.array(_issue(F.when(grounded, "unsupported_claim").otherwise(refused), name))),
        (unread, F.array(_issue("invalid_value", name))), (capture, F.array(_issue("provider_warning", name))), (misfiled, F.array(_issue("unsupported_claim", name))), (~grounded, F.array(_issue(refused, name))),
    ], F.array().cast(f"array<{ISSUE}>"))
    quote = F.substr(held, F.col("start") + 1, F.col("end") - F.col("start"))
    span = F.struct(
        span_id(F.col("record_id"), F.col("path"), F.col("start"), F.col("end"), F.lit("llm"), quote).alias("evidence_id"), F.col("record_id"), F.col("path").alias("field"), F.lit("llm").alias("method"), quote.alias("quote"),
        F.col("start").cast("int").alias("char_start"), F.col("end").cast("int").alias("char_end"), F.sha2(held, 256).alias("text_hash"),
    )
    whole = F.struct(
        span_id(F.col("record_id"), F.lit("title"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("source_metadata"), F.lit(None).cast("string")).alias("evidence_id"), F.col("record_id"), F.lit("title").alias("field"), F.lit("source_metadata").alias("method"),
        F.lit(None).cast("string").alias("quote"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"), F.sha2(own_title, 256).alias("text_hash"),
    )
    evidence = F.when(copied, whole).when(grounded & ~published & ~blank, span)
    resolved = F.when(copied, own_title).when(part == "time", F.when(review == "accepted", value)).otherwise(F.when(review == "accepted", told))
    method = F.when(copied | declared, "source_metadata").otherwise("llm")
    strange = (part == "location") & grounded & ~F.contains(fold(held), fold(value))  # the record's own words stand for a name that it doesn't hold
    out = rows.select(
        "record_id", "part", "position", "name", F.when(strange, quote).otherwise(value).alias("value"), "precision", "item", resolved.alias("resolved"), stamp["at"].alias("stamp"), review.alias("review"), method.alias("method"),
        F.when(~copied, F.coalesce("confidence", F.lit(UNSTATED))).alias("confidence"), evidence.alias("evidence"), problems.alias("problems"), ((part == "scalar") & optional | blank).alias("left_out"), F.transform("fields", lambda f: fold(f["text"])).alias("texts"),
    )
    return out


def _levels(item: Column, texts: Column) -> dict[str, Column]:
    """The administrative levels that the record's own words name."""
    return {n: F.when(F.exists(texts, lambda t: (fold(item[n]) != "") & F.contains(t, fold(item[n]))), item[n]) for n in LEVELS}


def assemble(records: DataFrame, drafts: DataFrame) -> DataFrame:
    """Documents with the columns of :data:`tidemark.schema.INCIDENT`, and ``context_type, context_facts, issues, kind_basis``.

    ``records``: ``record_id, source_id, source_type, source_url, event_time, retrieved_at, district, state, fields``; ``drafts``:
    ``record_id, draft`` (:data:`DRAFT`). A record without a draft gives none. An empty draft gives an unresolved document.
    """
    c = F.col
    judged = judged_answers(drafted_answers(drafts), records)
    kept = ~c("left_out")
    ids = F.when(c("evidence").isNotNull(), F.array("evidence.evidence_id")).otherwise(F.array().cast("array<string>"))
    claim = F.struct(c("name").alias("field"), F.coalesce(F.when(c("method") == "source_metadata", c("resolved")), c("value")).alias("value"), "method", "confidence", "review", ids.alias("evidence_ids"))
    levels = _levels(c("item"), c("texts"))
    kind = lambda allowed, default: F.coalesce(token(c("item.location_type"), allowed)["value"], F.lit(default))
    none = lambda t: F.lit(None).cast(t)
    place = F.struct(
        c("value").alias("text"), c("item.normalized_name").alias("normalized_name"), kind(MENTION_TYPES, "unknown").alias("location_type"), F.coalesce(token(c("item.role"), MENTION_ROLES)["value"], F.lit("unresolved")).alias("role"),
        *[v.alias(n) for n, v in levels.items()], c("review"), none("double").alias("latitude"), none("double").alias("longitude"), F.lit("pending_gis").alias("resolution"), none("string").alias("canonical_id"), ids.alias("evidence_ids"),
    )
    entity = F.struct(c("value").alias("text"), c("item.normalized_name").alias("normalized_name"), kind(ENTITY_TYPES, "unknown").alias("entity_type"), c("review"), ids.alias("evidence_ids"))
    fact = F.struct(F.coalesce("evidence.field", F.lit("unresolved")).alias("field"), c("value"), c("review"), ids.alias("evidence_ids"))
    lost = F.filter(F.array(*[F.when((c("part") == "location") & (F.coalesce(c("item")[n], F.lit("")) != "") & levels[n].isNull(), _issue("unsupported_claim", F.concat("name", F.lit(f".{n}")))) for n in LEVELS]), lambda x: x.isNotNull())
    in_order = lambda what, parts: F.transform(F.array_sort(F.collect_list(F.when(kept & c("part").isin(parts), F.struct("part", "position", what.alias("x"))))), lambda s: s["x"])
    value_of = {n: F.max(F.when((c("name") == n) & (c("review") == "accepted") & kept, c("resolved"))).alias(f"v_{n}") for n in SCALARS}
    timed = (c("part") == "time") & (c("review") == "accepted")
    gathered = judged.groupBy("record_id").agg(
        in_order(claim, ["scalar", "time"]).alias("claims"), in_order(place, ["location"]).alias("locations"), in_order(entity, ["entity"]).alias("entities"), in_order(fact, ["fact"]).alias("context_facts"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(kept & c("evidence").isNotNull(), F.struct("part", "position", "evidence")))), lambda s: s["evidence"])).alias("evidence"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "position", F.concat("problems", lost).alias("problems")))), lambda s: s["problems"]))).alias("found"),
        *value_of.values(), F.max(F.when(timed, c("stamp"))).alias("at"), F.max(F.when(timed, F.coalesce(F.nullif("precision", F.lit("")), F.lit("unknown")))).alias("at_precision"),
    )
    lists = {n: F.coalesce(n, F.array().cast(t)).alias(n) for n, t in gathered.dtypes if t.startswith("array")}
    rows = records.join(drafts.select("record_id", F.struct(c("draft.record_kind").alias("kind"), c("draft.context_type").alias("context")).alias("said"), _overlong().alias("overlong")), "record_id").join(gathered, "record_id", "left")
    rows = rows.select(*records.columns, "said", "overlong", *lists.values(), *[f"v_{n}" for n in SCALARS], "at", "at_precision").withColumnsRenamed({"event_time": "own_time"})
    return _decided(rows)


def _overlong() -> Column:
    return F.filter(F.array(*[F.when(F.size(F.col("draft")[n]) > ITEMS, _issue("provider_warning", n)) for n in ("locations", "entities", "context_facts")]), lambda x: x.isNotNull())


def _decided(rows: DataFrame) -> DataFrame:
    c = F.col
    own = F.try_element_at(F.filter("fields", lambda f: (f["path"] == "title") & (F.trim(f["text"]) != "")), F.lit(1))["text"]
    accepted = lambda name: F.exists(name, lambda x: x["review"] == "accepted")
    grounded = accepted("claims") | accepted("locations") | accepted("entities") | accepted("context_facts")
    said_kind, said_context = token(c("said.kind"), ["incident", "forecast", "context", "unresolved"]), token(c("said.context"), CONTEXT_TYPES)
    kind, context = said_kind["value"], said_context["value"]
    typed = F.coalesce(c("v_incident_type") != "unresolved", F.lit(False))
    account = c("v_description").isNotNull()
    happened = F.coalesce(c("v_event_status") != "unknown", F.lit(False))
    established = typed | (account & (F.coalesce(kind == "incident", F.lit(False)) | happened))
    unnamed = F.lit(None).cast("string")
    table = [
        ("event established", established, F.lit("incident"), unnamed), ("called an incident, of a context", (kind == "incident") & context.isNotNull(), F.lit("context"), context), ("called an incident", kind == "incident", F.lit("unresolved"), unnamed),
        ("as declared", kind.isin("forecast", "context"), kind, context), ("of a context", context.isNotNull(), F.lit("context"), context), ("facts alone", accepted("context_facts"), F.lit("context"), unnamed),
    ]
    rows = rows.withColumns({
        "grounded": grounded, "typed": typed, "kind_basis": compiled([(held, name) for name, held, _, _ in table], "nothing"), "record_kind": compiled([(held, k) for _, held, k, _ in table], "unresolved"),
        "context_type": compiled([(held, x) for _, held, _, x in table], None), "called": F.coalesce((kind == "incident") & ~established, F.lit(False)),
        "strange": F.filter(F.array(F.when(said_kind["fault"].isNotNull(), _issue("invalid_value", "record_kind")), F.when(said_context["fault"].isNotNull(), _issue("invalid_value", "context_type"))), lambda x: x.isNotNull()),
    })
    # a record's own title is published beside something that was grounded, never alone
    copy = c("grounded") & own.isNotNull() & ~F.exists("claims", lambda x: x["field"] == "title")
    meta_id = span_id(c("record_id"), F.lit("title"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("source_metadata"), F.lit(None).cast("string"))
    own_claim = F.struct(F.lit("title").alias("field"), own.alias("value"), F.lit("source_metadata").alias("method"), F.lit(None).cast("double").alias("confidence"), F.lit("accepted").alias("review"), F.array(meta_id).alias("evidence_ids"))
    own_evidence = F.struct(meta_id.alias("evidence_id"), "record_id", F.lit("title").alias("field"), F.lit("source_metadata").alias("method"), F.lit(None).cast("string").alias("quote"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"), F.sha2(own, 256).alias("text_hash"))
    # a record without a happening answers no question about one
    idle = c("record_kind").isin("forecast", "context")
    stated = {n: idle & F.coalesce(~c(f"v_{n}").isin("unresolved", "unknown"), F.lit(False)) for n in EVENT_ONLY}
    dropped = F.filter(F.array(*[F.when(v, F.lit(n)) for n, v in stated.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("dropped", dropped).withColumn("evidence", F.when(copy, F.concat("evidence", F.array(own_evidence))).otherwise(c("evidence"))).withColumn("claims", F.when(copy, F.concat("claims", F.array(own_claim))).otherwise(c("claims")))
    held = lambda x: F.array_contains("dropped", x["field"])
    rows = rows.withColumn("claims", F.transform("claims", lambda x: x.withField("review", F.when(held(x), "review_required").otherwise(x["review"]))))
    found = F.concat("overlong", "found", "strange", F.transform("dropped", lambda n: _issue("unsupported_claim", n)))
    named = lambda field: F.exists(found, lambda x: x["field"] == field)
    happening = c("record_kind") == "incident"
    more = F.filter(F.array(
        F.when(c("called"), _issue("provider_warning", "record_kind")), F.when(happening & ~c("typed") & ~named("incident_type"), _issue("provider_warning", "incident_type")), F.when(happening & c("v_description").isNull() & ~named("description"), _issue("provider_warning", "description")),
    ), lambda x: x.isNotNull())
    rows = rows.withColumn("issues", F.concat(found, more))
    open_ = lambda name: F.exists(name, lambda x: x["review"] != "accepted")
    undecided = (F.size("issues") > 0) | F.exists("claims", lambda x: x["review"] == "review_required") | open_("locations") | open_("entities") | open_("context_facts")
    review = compiled([(undecided & c("grounded"), "review_required"), (c("grounded") & ~undecided, "accepted")], "unresolved")
    value = lambda n, default: F.when(~F.array_contains("dropped", n), F.coalesce(c(f"v_{n}"), F.lit(default))).otherwise(F.lit(default))
    return rows.select(
        F.concat(F.lit("INC-"), "record_id").alias("incident_id"), "record_id", "source_id", "source_url", "record_kind", review.alias("review"), F.coalesce("v_incident_type", F.lit("unresolved")).alias("incident_type"), value("category", "unresolved").alias("category"),
        value("department", "unresolved").alias("department"), value("severity", "unresolved").alias("severity"), value("priority", None).cast("string").alias("priority"), value("event_status", "unknown").alias("event_status"),
        c("at").alias("event_time"), F.coalesce("at_precision", F.lit("unknown")).alias("event_time_precision"), c("own_time").alias("declared_event_time"), "retrieved_at", c("district").alias("district_hint"), c("state").alias("state_hint"),
        "locations", "entities", "claims", "evidence", "context_type", "context_facts", "issues", "kind_basis",
    )
