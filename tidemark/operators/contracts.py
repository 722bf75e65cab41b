"""What interpretations, answers and briefings must hold, and the checks of uploads: name to "is violated"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..functions.wording import claim_words, digit_set, stray_digits

ACCEPTED, DAYS, QUOTED_EVENTS = 0.8, 365, 2
#: What may be uploaded.
EXTENSIONS, MOST_BYTES = [".pdf", ".tif", ".tiff"], 10 * 1024 * 1024


def _same_size(count: str, ids: str) -> Column:
    return F.col(count) != F.size(ids)


def _any(array: str, inside: str) -> Column:
    """Whether ``array`` holds something that ``inside`` lacks."""
    return F.size(F.array_except(array, inside)) > 0


def interpretation_rules() -> dict[str, Column]:
    """Columns ``days_back, compare, place_filter, since, until, review, findings, understood, confidence, method, places_asked, places_matched``."""
    c = F.col
    windowed, accepted = c("since").isNotNull() | c("until").isNotNull(), c("review") == "accepted"
    unmatched = F.size(F.array_except(F.transform("places_asked", fold), "places_matched")) > 0
    return {
        "days out of range": c("days_back").isNotNull() & ~c("days_back").between(1, DAYS), "comparison without a window": c("compare") & c("days_back").isNull(), "place as a filter": c("place_filter").isNotNull(),
        "window without dates": c("days_back").isNotNull() & ~windowed, "dates without a window": windowed & c("days_back").isNull(), "silent acceptance": accepted & (F.size("findings") > 0),
        "accepted without words": accepted & (F.coalesce(F.trim("understood"), F.lit("")) == ""), "accepted without confidence": accepted & (c("confidence") < ACCEPTED), "accepted without a model": accepted & (c("method") != "llm"),
        "unmatched place": accepted & unmatched, "review without reason": ~accepted & (F.size("findings") == 0) & (c("method") == "llm"),
    }


def answer_rules() -> dict[str, Column]:
    """Columns ``events, event_ids, incidents, incident_ids, shown_events, quoted_events, state, review, findings, statements, missing, explanation,
    confidence, cited_events, cited_evidence, quotation_evidence, quotation_incidents, numbers, previous, change``. ``statements``: texts.
    """
    c = F.col
    grounded, qualified, refused = (c("state") == s for s in ("grounded", "qualified", "refused"))
    text = F.array_join("statements", "\n")
    none = F.size("statements") == 0
    return {
        "events are counted": _same_size("events", "event_ids"), "incidents are counted": _same_size("incidents", "incident_ids"), "shown over counted": c("shown_events") > c("events"),
        "change": c("previous").isNotNull() & (c("change") != c("events") - c("previous")), "foreign event": _any("cited_events", "event_ids"), "foreign evidence": _any("cited_evidence", "quotation_evidence"),
        "foreign quotation": _any("quotation_incidents", "incident_ids"), "repeated quotation": F.size(F.array_distinct("quotation_evidence")) < F.size("quotation_evidence"),
        "invented number": F.size(stray_digits(text, F.array_join("numbers", "\n"))) > 0, "grounded with findings": grounded & (F.size("findings") > 0), "grounded without acceptance": grounded & (c("review") != "accepted"),
        "grounded without statement": grounded & (none | c("explanation").isNull()), "grounded without confidence": grounded & (c("confidence") < ACCEPTED), "grounded with claim words": grounded & (F.size(claim_words(text)) > 0),
        "grounded on too few quotes": grounded & (c("events") >= QUOTED_EVENTS) & (c("quoted_events") < QUOTED_EVENTS), "grounded without quotation": grounded & (F.size("quotation_evidence") == 0),
        "qualified without findings": qualified & (F.size("findings") == 0), "qualified without statement": qualified & none, "qualified and missing": qualified & c("missing").isNotNull(),
        "refused with statement": refused & ~none, "refused without reason": refused & (F.coalesce(F.trim("missing"), F.lit("")) == ""), "refused and accepted": refused & (c("review") == "accepted"),
    }


def briefing_rules() -> dict[str, Column]:
    """Columns ``days_back, since, until, window_basis, anchor, events, event_ids, shown_events, truncated_events, state, item_events, item_evidence,
    quotation_evidence, quotation_events, named_items, item_ids, lines, numbers``.
    """
    c = F.col
    counted = c("window_basis").isin("record", "given")
    return {
        "days out of range": c("days_back").isNotNull() & ~c("days_back").between(1, DAYS), "period upside down": c("until") < c("since"), "unknown basis": ~c("window_basis").isin("record", "given", "named", "none"),
        "counted days without basis": c("days_back").isNotNull() & ~counted, "open period": counted & (c("since").isNull() | c("until").isNull()), "anchor": (c("window_basis") == "record") & ~F.coalesce(c("until") == c("anchor"), F.lit(False)),
        "named without start": (c("window_basis") == "named") & c("since").isNull(), "events are counted": _same_size("events", "event_ids"), "shown over counted": c("shown_events") > c("events"),
        "truncated": c("truncated_events") != c("events") - c("shown_events"), "nothing counted": (c("events") == 0) & (c("state") != "withheld"), "foreign event": _any("item_events", "event_ids"),
        "foreign evidence": _any("item_evidence", "quotation_evidence"), "foreign quotation": _any("quotation_events", "event_ids"), "unprinted item": _any("named_items", "item_ids"),
        "invented number": F.size(stray_digits(F.array_join("lines", "\n"), F.array_join("numbers", "\n"))) > 0,
    }


def supported_statements(statements: DataFrame) -> DataFrame:
    """Statements that an answer keeps, with ``fault`` for the others: cited, in scope, without numbers that weren't measured.

    ``statements``: ``text, calculated, cited_events, cited_evidence, scope_events, printed_evidence, numbers``.
    """
    stray = F.size(F.array_except(digit_set(F.col("text")), digit_set(F.array_join("numbers", "\n")))) > 0
    fault = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when((F.size("cited_events") == 0) & (F.size("cited_evidence") == 0), "uncited").when(_any("cited_events", "scope_events"), "event out of scope")
    return statements.withColumn("fault", fault.when(_any("cited_evidence", "printed_evidence"), "evidence not printed").when(F.col("calculated") & stray, "number not measured"))


def answer_state(kept: Column, findings: Column, accepted: Column) -> Column:
    """``refused`` without a kept statement, ``grounded`` if nothing speaks against it, else ``qualified``."""
    return F.when(kept == 0, "refused").when((findings == 0) & accepted, "grounded").otherwise("qualified")


def upload_fault(name: Column, size: Column) -> Column:
    """Why a document can't be taken; null if it can."""
    ending = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > MOST_BYTES, "too large").when(~ending.isin(EXTENSIONS), "file type")


def job_answer(status: Column, cached: Column) -> Column:
    """What a request for insights gets: what is cached, a conflict while the job isn't done, else a new reading."""
    return F.when(cached, "cached").when(F.coalesce(status, F.lit("")) != "SUCCEEDED", "conflict").otherwise("read")
