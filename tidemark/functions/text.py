"""Text and value functions over columns."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DATED, OPEN_VALUES, PRIORITIES, SEVERITIES


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold(text: Column) -> Column:
    """Trimmed, case-folded (a sharp s is two letters), white space squeezed."""
    return F.replace(F.lower(squeeze(text)), F.lit("ß"), F.lit("ss"))


def script(text: Column) -> Column:
    """``tamil``, ``latin``, ``mixed`` or ``other`` by the letters found."""
    tamil, latin = text.rlike(r"[\x{0B80}-\x{0BFF}]"), text.rlike("[A-Za-z]")
    return F.when(tamil & latin, "mixed").when(tamil, "tamil").when(latin, "latin").otherwise("other")


#: Every decimal digit of every script and the ASCII digit it stands for, by rule.
DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def digit_runs(text: Column) -> Column:
    """Distinct runs of decimal digits of any script, as ASCII digits without leading zeros, in order of appearance."""
    plain = F.translate(text, "".join(DIGITS), ASCII_DIGITS)
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit("([0-9]+)")), lambda d: F.regexp_replace(d, "^0+(?=.)", "")))


def find_spans(text: Column, quote: Column) -> Column:
    """All occurrences, overlapping ones included, as 0-based code point offsets; null for a blank quote.

    The text is cut in front of every occurrence (a look-ahead has no width), and the parts' lengths add up to the offsets.
    """
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    begins = F.aggregate(F.split(text, literal), start, step, lambda s: s["out"])
    return F.when(F.trim(quote) != "", F.filter(begins, lambda i: (i > 0) | F.startswith(text, quote)))


def locate(spans: Column, length: Column, occurrence: int | None = None) -> Column:
    """``struct(fault, char_start, char_end)`` of one occurrence; negative numbers count from the end."""
    n = F.size(spans)
    blank = F.lit(None).cast("int")
    result = lambda fault, at: F.struct(F.lit(fault).cast("string").alias("fault"), at.alias("char_start"), (at + length).alias("char_end"))
    out = F.when(spans.isNull(), result("blank", blank)).when(n == 0, result("missing", blank))
    if occurrence is None:
        return out.when(n > 1, result("ambiguous", blank)).otherwise(result(None, F.try_element_at(spans, F.lit(1))))
    inside = (n > occurrence) if occurrence >= 0 else (n >= -occurrence)
    index = occurrence + 1 if occurrence >= 0 else occurrence
    return out.when(~inside, result("out_of_range", blank)).otherwise(result(None, F.try_element_at(spans, F.lit(index))))


def known(value: Column) -> Column:
    """Whether a value says something: neither null nor one of the open ones."""
    return value.isNotNull() & ~value.isin(OPEN_VALUES)


def _rank(value: Column, order: list[str]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for i, v in enumerate(order, 1):
        out = out.when(value == v, F.lit(i))
    return out


def severity_rank(value: Column) -> Column:
    return _rank(value, SEVERITIES)


def priority_rank(value: Column) -> Column:
    return _rank(value, PRIORITIES)


def effective_time(event_time: Column, precision: Column, declared: Column, retrieved: Column) -> Column:
    """``struct(when, basis)``: a dated event time, else the declared one, else the time of retrieval."""
    dated = event_time.isNotNull() & precision.isin(DATED)
    at = F.when(dated, event_time).when(declared.isNotNull(), declared).otherwise(retrieved)
    basis = F.when(dated, "event_time").when(declared.isNotNull(), "declared").when(retrieved.isNotNull(), "retrieved_at").otherwise("none")
    return F.struct(at.alias("when"), basis.alias("basis"))


def ratio(top: Column, bottom: Column) -> Column:
    """To four places, half to even; 0 for a denominator that isn't positive."""
    return F.when(bottom <= 0, F.lit(0.0)).otherwise(F.bround(top / bottom, 4))


def route_mode(source_type: Column, record_type: Column, source_id: Column, article_sources: tuple[str, ...] = ()) -> Column:
    """``structured`` or ``semantic``: who reads the record. Articles of ``article_sources`` are read even without a type."""
    source, kind, name = F.lower(F.trim(source_type)), F.lower(F.trim(record_type)), F.lower(F.trim(source_id))
    structured = source.isin("agriculture", "weather") | kind.isin("market_price", "forecast")
    article = (F.coalesce(source, F.lit("")) == "") & (kind == "article") & name.isin(list(article_sources))
    return F.when(structured, "structured").when((source == "news") | article, "semantic").otherwise("structured")


def valueless(data: Column) -> Column:
    """Sorted keys of a map whose value is null or empty; ``language`` never counts."""
    return F.array_sort(F.map_keys(F.map_filter(data, lambda k, v: (k != "language") & (v.isNull() | (v == "")))))


def date_precision(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day")


def contains_alias(text: Column, alias: Column) -> Column:
    """ASCII aliases at word edges, others anywhere; both sides folded."""
    ascii_only = ~alias.rlike(r"[^\x00-\x7F]")
    bare = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    edged = bare(text).contains(bare(alias))
    return F.when(ascii_only, edged).otherwise(text.contains(alias))
