"""Evidence: spans in source texts, their verification, and the rules that documents must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import find_spans
from .patterns import occurrences

def quote_spans(fields: DataFrame, quotes: DataFrame) -> DataFrame:
    """``field_id, quote_id, char_start, char_end`` of every occurrence of a quote in a text, overlapping ones included.

    One plan at any number of quotes and texts: see :mod:`tidemark.operators.patterns`. Blank quotes are nowhere.
    """
    found = occurrences(fields, quotes.filter(F.col("quote").rlike(r"(?U)\S")).select("quote_id", "quote"), key="field_id", text="text", pattern="quote")
    return found.select("field_id", "quote_id", "char_start", (F.col("char_start") + F.length("quote")).alias("char_end"))


def unique_field(fields: DataFrame, quotes: DataFrame) -> DataFrame:
    """``quote_id, field_id``: the one text that holds a quote once and is covered by it most; ties and repeats give none."""
    spans = quote_spans(fields, quotes).groupBy("quote_id", "field_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("char_end") - F.col("char_start")).alias("size")).filter("n = 1")
    share = spans.join(fields.select("field_id", F.length("text").alias("whole")), "field_id").withColumn("share", F.col("size") / F.col("whole"))
    by = Window.partitionBy("quote_id")
    best = share.withColumn("top", F.max("share").over(by)).filter("share = top").withColumn("ties", F.count(F.lit(1)).over(by))
    return best.filter("ties = 1").select("quote_id", "field_id")


def verified(text: Column, text_hash: Column, quote: Column, start: Column, end: Column) -> Column:
    """``not_applicable`` without a span, ``unvalidated`` without a hash, ``mismatch`` or ``validated``."""
    slice_ = F.substring(text, start + 1, end - start)
    return F.when(start.isNull() | end.isNull(), "not_applicable").when(text_hash.isNull(), "unvalidated").when((F.sha2(text, 256) != text_hash) | (slice_ != quote), "mismatch").otherwise("validated")


#: Fields of a document that a claim stands behind, and values that say nothing (fixed values).
CLAIMED = ["incident_type", "category", "department", "severity", "priority", "event_status"]
ABSENT = ["", "unresolved", "unknown"]


def _stated(field: Column) -> Column:
    """What a document says in a field; null for a field that isn't one of :data:`CLAIMED` or the time, the empty string for none."""
    held = {n: F.col(n) for n in CLAIMED} | {"event_time": F.col("event_time").cast("string")}
    out = F.lit(None).cast("string")
    for name, value in held.items():
        out = F.when(field == name, F.coalesce(value, F.lit(""))).otherwise(out)
    return out


def claim_rules() -> dict[str, Column]:
    """Rules on what stands behind the values and the review of a document that was assembled from a draft; columns also ``issues, context_type, context_facts``."""
    c = F.col
    said = lambda n: F.coalesce(~c(n).isin(ABSENT), F.lit(False))
    claimed = F.transform("claims", lambda x: x["field"])
    unclaimed = F.lit(False)
    for n in CLAIMED:
        unclaimed |= said(n) & ~F.array_contains(claimed, n)
    doubtful = F.exists("claims", lambda x: (x["review"] != "accepted") & ~F.coalesce(_stated(x["field"]).isin(ABSENT), F.lit(True)))
    flagged = doubtful
    for n in ("locations", "entities", "context_facts"):
        flagged |= F.exists(n, lambda x: x["review"] != "accepted")
    idle = c("record_kind").isin("forecast", "context")
    return {
        "value_without_claim": unclaimed, "event_time_without_claim": c("event_time").isNotNull() & ~F.array_contains(claimed, "event_time"), "accepted_though_flagged": (c("review") == "accepted") & flagged,
        "unresolved_with_accepted_claim": (c("review") == "unresolved") & F.exists("claims", lambda x: x["review"] == "accepted"),
        "review_without_reason": (c("review") == "review_required") & ~flagged & (F.size("issues") == 0), "context_with_happening": idle & (said("category") | said("department") | said("severity") | said("priority") | said("event_status")),
        "incident_with_context": c("context_type").isNotNull() & ~idle, "claimed_twice": F.size(F.array_distinct(claimed)) < F.size(claimed),
    }


def rules() -> dict[str, Column]:
    """Contract of a nested incident: name to "is violated". Columns as in :data:`tidemark.schema.INCIDENT`."""
    c = F.col
    ids = F.transform("evidence", lambda e: e["evidence_id"])
    refs = F.flatten(F.concat(*[F.transform(n, lambda x: F.coalesce(x["evidence_ids"], F.array().cast("array<string>"))) for n in ("claims", "locations", "entities")]))
    span = lambda e: e["char_start"].isNotNull() & e["char_end"].isNotNull()
    return {
        "evidence_without_span": F.exists("evidence", lambda e: (e["method"] != "source_metadata") & (e["quote"].isNull() | ~span(e))),
        "evidence_length": F.exists("evidence", lambda e: span(e) & (F.length(e["quote"]) != e["char_end"] - e["char_start"])),
        "evidence_repeated": F.size(F.array_distinct(ids)) < F.size(ids),
        "dangling_reference": F.size(F.array_except(refs, ids)) > 0,
        "claim_without_evidence": F.exists("claims", lambda x: (x["review"] == "accepted") & (x["method"] != "source_metadata") & (F.size(x["evidence_ids"]) < 1)),
        "claim_without_confidence": F.exists("claims", lambda x: x["method"].isin("llm", "statistical") & x["confidence"].isNull()),
        "confidence_range": F.exists("claims", lambda x: x["confidence"].isNotNull() & ~x["confidence"].between(0, 1)),
        "half_coordinates": F.exists("locations", lambda p: p["latitude"].isNull() != p["longitude"].isNull()),
        "unresolved_coordinates": F.exists("locations", lambda p: p["latitude"].isNotNull() & (F.coalesce(p["resolution"], F.lit("")) != "resolved")),
        "incident_without_type": (c("record_kind") == "incident") & (c("review") == "accepted") & F.coalesce(c("incident_type").isin("unresolved", "unknown"), F.lit(True)) & ~F.exists("claims", lambda x: (x["field"] == "description") & (x["review"] == "accepted")),
        "context_with_event": c("record_kind").isin("forecast", "context") & F.coalesce(~c("incident_type").isin("unresolved", "unknown"), F.lit(False)),
        "accepted_with_open_claim": (c("review") == "accepted") & F.exists("claims", lambda x: (x["review"] != "accepted") & ~F.coalesce(_stated(x["field"]).isin(ABSENT), F.lit(False))),
    }


def violations(documents: DataFrame, held: dict[str, Column] | None = None) -> DataFrame:
    """``rule, documents``: how many documents violate each rule (:func:`rules` unless others are given), zeros included; one scan."""
    held = held or rules()
    sums = documents.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(n) for n, v in held.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("documents")) for n in held])).alias("r")).select("r.rule", "r.documents")


__all__ = ["find_spans", "quote_spans", "rules", "unique_field", "verified", "violations"]
