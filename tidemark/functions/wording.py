"""Words, marks and dates in texts: normal forms, word lists, topics, stamps and display forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocabularies import CLAIM_WORDS, FORECAST_WORDS, MARKET_WORDS, MONTHS_TAMIL, PAST_WORDS, TALUK_SPELLINGS
from .ids import PRINTED
from .text import digit_runs, fold, script, squeeze


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


def norm(text: Column) -> Column:
    """Composed (NFC), case-folded, white space squeezed. Plain ASCII stays in the JVM; null is null."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return squeeze(F.when(plain, F.lower(text)).otherwise(_composed(F.when(~plain, text))))


def digit_set(text: Column) -> Column:
    """Distinct digit runs of any script without leading zeros, sorted."""
    return F.array_sort(digit_runs(text))


def without_ids(text: Column) -> Column:
    """Identifiers are printed to be cited; their digits measure nothing."""
    return F.regexp_replace(text, rf"\b({'|'.join(PRINTED)})-[\w-]+", "")


def stray_digits(text: Column, allowed: Column) -> Column:
    """Digit runs of ``text`` that the measured lines ``allowed`` don't hold."""
    return F.array_except(digit_set(text), digit_set(without_ids(allowed)))


def script_mismatch(text: Column, wanted: Column) -> Column:
    """Whether a non-blank text is written in the other script than ``wanted`` (``ta`` or ``en``); mixed texts fit both."""
    seen = script(text)
    return (F.trim(text) != "") & (((wanted == "ta") & (seen == "latin")) | ((wanted == "en") & (seen == "tamil")))


def said_in(text: Column, words: Sequence[str]) -> Column:
    """Which words a folded text uses, sorted: single ASCII words as words of their own, others anywhere."""
    tokens = F.split(text, "[^0-9a-z]+")
    single = [w for w in words if w.isascii() and " " not in w]
    others = [w for w in words if w not in single]
    found = F.array_intersect(tokens, F.array(*map(F.lit, single)))
    return F.array_sort(F.concat(found, F.filter(F.array(*map(F.lit, others)), lambda w: F.contains(text, w)))) if others else F.array_sort(found)


def topic(text: Column) -> Column:
    """``market``, ``forecast`` or ``records``: what a folded question asks for."""
    return F.when(F.size(said_in(text, MARKET_WORDS)) > 0, "market").when(F.size(said_in(text, FORECAST_WORDS)) > 0, "forecast").otherwise("records")


def phrases_in(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that a text holds anywhere, in the order of the list."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda w: F.contains(F.lower(text), w))


def claim_words(text: Column) -> Column:
    return phrases_in(text, CLAIM_WORDS)


def past_words(text: Column) -> Column:
    return phrases_in(text, PAST_WORDS)


def named_in(text: Column, names: Column) -> Column:
    """The names of an array that a folded text holds, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: (n != "") & F.contains(text, n))))


def token(value: Column, allowed: Sequence[str]) -> Column:
    """``struct(value, fault)``: lower case, blanks and dashes as underscores; a blank is no value, a stranger a fault."""
    clean = F.translate(F.lower(F.trim(value)), "- ", "__")
    blank = value.isNull() | (value == "")
    known = clean.isin(list(allowed))
    return F.struct(F.when(~blank & known, clean).alias("value"), F.when(~blank & ~known, F.lit("invalid_value")).alias("fault"))


def iso_stamp(value: Column) -> Column:
    """``struct(at, zoned, fault)`` of an ISO time stamp with or without offset (``Z`` allowed); what is none is a fault."""
    text = F.trim(value)
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    at = F.when(shape, F.try_to_timestamp(text))
    zoned = text.rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    blank = value.isNull() | (value == "")
    return F.struct(at.alias("at"), F.coalesce(zoned, F.lit(False)).alias("zoned"), F.when(~blank & at.isNull(), F.lit("invalid_value")).alias("fault"))


def arrival_day(value: Column) -> Column:
    """The UTC day of a stamp that says its offset; any other stamp is undated, since its day can't be told."""
    stamp = iso_stamp(value)
    return F.when(stamp["zoned"], F.to_date(stamp["at"]))


def reported_at(declared: Column, retrieved: Column, event_time: Column) -> Column:
    return F.coalesce(declared, retrieved, event_time)


def tamil_stamp(text: Column) -> Column:
    """The time of "ADDED : <month> <day>, <year> <hour>:<minute> AM|PM" with a Tamil month; null for anything else."""
    shape = r"(?i)ADDED\s*:\s*(\S+)\s+(\d{1,2}),\s*(\d{4})\s+(\d{1,2}):(\d{2})\s*(AM|PM)"
    part = lambda i: F.regexp_extract(squeeze(text), shape, i)
    months = F.create_map(*[F.lit(x) for pair in MONTHS_TAMIL.items() for x in pair])
    number = lambda i: part(i).try_cast("int")
    late, hour = F.upper(part(6)) == "PM", number(4)
    full = F.when(late & (hour != 12), hour + 12).when(~late & (hour == 12), 0).otherwise(hour)
    built = F.format_string("%04d-%02d-%02d %02d:%02d:00", number(3), F.try_element_at(months, part(1)), number(2), full, number(5))
    return F.when(F.try_element_at(months, part(1)).isNotNull(), F.try_to_timestamp(built))


def plain_number(value: Column) -> Column:
    """Whole numbers without a point, others with five places at most and no zeros at the end."""
    short = F.regexp_replace(F.format_string("%.5f", F.round(value, 5)), r"\.?0+$", "")
    return F.when(value == F.floor(value), value.cast("long").cast("string")).when(value.isNotNull(), short)


def taluk_name(name: Column) -> Column:
    """The one spelling of a taluk; other names are only trimmed."""
    spellings = F.create_map(*[F.lit(x) for pair in TALUK_SPELLINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(spellings, F.replace(F.lower(F.trim(name)), F.lit("  "), F.lit(" "))), F.trim(name))


def safe_url(url: Column) -> Column:
    """The address if its scheme is http or https, else null."""
    return F.when(F.lower(F.try_parse_url(F.trim(url), F.lit("PROTOCOL"))).isin("http", "https"), F.trim(url))


def display_time(at: Column, zone: str = "Asia/Kolkata") -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "d MMM yyyy, HH:mm")


def safe_name(name: Column, size: int = 180) -> Column:
    """The last part of a path without control characters, ``size`` characters at most; blank names are ``document``."""
    last = F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)
    kept = F.substring(F.regexp_replace(last, r"[\x00-\x1F]", ""), 1, size)
    return F.when(F.coalesce(F.trim(kept), F.lit("")) == "", "document").otherwise(kept)


def json_object(text: Column) -> Column:
    """The one JSON object of an answer, without a code fence around it; null if there is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[a-z]*\s*", ""), r"\s*```\s*$", ""))
    return F.when(F.substring(bare, 1, 1) == "{", F.from_json(bare, "map<string,string>"))


def value_in_field(value: Column, field: Column) -> Column:
    """Whether a field states a value: as folded text, or as the same number once commas are gone."""
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    said, held = fold(value), fold(field)
    return F.coalesce((said != "") & F.contains(held, said), F.lit(False)) | F.coalesce(number(said) == number(held), F.lit(False))


def same_stamp(parsed: Column, parsed_zoned: Column, declared: Column, declared_zoned: Column) -> Column:
    """One instant, or one day if neither stamp says its offset."""
    return F.coalesce((parsed == declared) | (~parsed_zoned & ~declared_zoned & (F.to_date(parsed) == F.to_date(declared))), F.lit(False))
