"""Content-hash identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What identifiers begin with that are printed to be cited: events, incidents, issues, trends, briefings and evidence (fixed values).
PRINTED = ["EVT", "INC", "ISS", "TRD", "BRF", "ev"]


def short_hash(text: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, size)


def event_id(ids: Column) -> Column:
    """Of an array of incident ids, in any order."""
    return F.concat(F.lit("EVT-"), short_hash(F.array_join(F.array_sort(ids), "|")))


def link_id(low: Column, high: Column) -> Column:
    return F.concat(F.lit("LNK-"), short_hash(F.concat_ws("|", low, high)))


def trend_id(dimension: Column, value: Column, since: Column, until: Column, events: Column) -> Column:
    return F.concat(F.lit("TRD-"), short_hash(F.concat_ws("|", dimension, value, since, until, F.array_join(F.array_sort(events), "|"))))


def article_id(url: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(url), 1, 16))


def span_id(record: Column, field: Column, start: Column, end: Column, method: Column, quote: Column) -> Column:
    parts = F.concat_ws("\u001f", record, field, start.cast("string"), end.cast("string"), method, quote)
    return F.concat(F.lit("ev-"), record, F.lit("-"), short_hash(parts, 12))
