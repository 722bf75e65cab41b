"""Value lookups and period facts behind answers: inverted index, conjunctive match, price range, briefing measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..functions.wording import said_in
from ..vocabularies import DAY_WORDS, MONTH_NAMES, MONTH_WORDS, WEEK_WORDS


def value_index(facts: DataFrame, fields: list[str]) -> DataFrame:
    """``field, word, ids``: how many rows hold a word in a field. Fields that end in ``_id`` are left out."""
    used = [f for f in fields if not f.endswith("_id")]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), fold(F.col(f).cast("string")).alias("text")) for f in used])
    words = facts.select("id", F.explode(pairs).alias("p")).select("id", "p.field", F.explode(F.split("p.text", " ")).alias("word"))
    return words.filter("word <> ''").groupBy("field", "word").agg(F.countDistinct("id").alias("ids"))


def value_match(facts: DataFrame, fields: list[str], question: str) -> DataFrame:
    """Rows in which every field that the question names a value of holds one of the named values.

    A field is named if one of its values occurs in the question as a run of words. No named field, no rows.
    """
    asked = f" {' '.join(question.lower().split())} "
    said = lambda f: F.lit(asked).contains(F.concat(F.lit(" "), fold(F.col(f)), F.lit(" ")))
    named = F.broadcast(facts.agg(*[F.max(said(f)).alias(f"_{f}") for f in fields]))  # one row
    keep, any_named = F.lit(True), F.lit(False)
    for f in fields:
        keep &= ~F.col(f"_{f}") | said(f)
        any_named |= F.col(f"_{f}")
    return facts.crossJoin(named).filter(keep & any_named).select(*facts.columns)


def price_range(rows: DataFrame, *, most_named: int = 3) -> DataFrame:
    """One row: lowest and highest price; markets and commodities by name up to ``most_named``, else their number."""
    out = rows.agg(F.min("min_price").alias("low"), F.max("max_price").alias("high"), F.count(F.lit(1)).alias("rows"))
    for c in ("market", "commodity"):
        values = rows.select(c).filter(F.col(c).isNotNull()).distinct()
        few = values.orderBy(c).limit(most_named).agg(F.array_join(F.array_sort(F.collect_list(c)), ", ").alias("few"))  # most_named values
        named = values.agg(F.count(F.lit(1)).alias("n")).crossJoin(few)
        text = F.when(F.col("n") > most_named, F.concat(F.col("n").cast("string"), F.lit(f" {c}s"))).otherwise(F.col("few"))
        out = out.crossJoin(named.select(text.alias(c)))  # one row each
    return out


def status_split(rows: DataFrame) -> DataFrame:
    s = F.col("event_status")
    kind = F.when(s.isin("ongoing", "under_investigation"), "open").when(s.isin("resolved", "closed"), "recorded").when(s.isNull() | s.isin("unknown", "unresolved"), "unstated").otherwise("other")
    return rows.groupBy(kind.alias("state")).agg(F.count(F.lit(1)).alias("events"))


def period(rows: DataFrame, time: str, days: int) -> DataFrame:
    """Rows with ``in_period``: the ``days`` up to the newest one. Undated rows have null."""
    anchor = F.broadcast(rows.agg(F.max(F.to_date(time)).alias("_until")))
    day = F.to_date(time)
    return rows.crossJoin(anchor).withColumn("in_period", day > F.date_sub("_until", days)).drop("_until")


def measure(rows: DataFrame, time: str, days: int) -> DataFrame:
    """One row: what a briefing may say about a period."""
    held = period(rows, time, days)
    inside = F.coalesce("in_period", F.lit(False))
    return held.agg(
        F.count_if(inside).alias("events"), F.count_if(inside & F.col("event_status").isin("ongoing", "under_investigation")).alias("open_events"), F.countDistinct(F.when(inside, F.col("taluk"))).alias("areas"),
        F.countDistinct(F.when(inside, F.col("source_id"))).alias("sources"), F.count_if(F.col(time).isNull()).alias("undated"), F.count_if(F.col("in_period") == F.lit(False)).alias("dated_outside"),
        F.date_sub(F.max(F.to_date(time)), days - 1).alias("since"), F.max(F.to_date(time)).alias("until"),
    )


def overlapping(families: DataFrame, events: DataFrame) -> DataFrame:
    """``family_id, shared``: families with at least one event of the period, and how many. ``families``: family_id, event_ids."""
    pairs = families.select("family_id", F.explode("event_ids").alias("event_id"))
    return pairs.join(events.select("event_id").distinct(), "event_id", "left_semi").groupBy("family_id").agg(F.countDistinct("event_id").alias("shared"))


def _named_days(text: Column) -> Column:
    """``array<struct<day, month, year>>`` of forms like "2 Oct", "2-october-2026": in order, those whose word is a month; no year is -1."""
    shape = F.lit(r"(?<![0-9])([0-9]{1,2})[\s/-]([a-z]{3,9})(?:[\s,/-]+([0-9]{4}))?(?![0-9])")
    part = lambda i: F.regexp_extract_all(text, shape, F.lit(i))
    names = {n: i for i, full in enumerate(MONTH_NAMES, 1) for n in (full, full[:3])} | {"sept": 9}
    months = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    every = F.transform(F.arrays_zip(part(1).alias("d"), part(2).alias("m"), part(3).alias("y")), lambda x: F.struct(x["d"].cast("int").alias("day"), F.try_element_at(months, x["m"]).alias("month"), F.coalesce(F.nullif(x["y"], F.lit("")).cast("int"), F.lit(-1)).alias("year")))
    return F.filter(every, lambda x: x["month"].isNotNull())


def question_window(text: Column, today: Column) -> Column:
    """``struct(since, until)`` that a question names, by the first form that fits; null if none does, null days if the date doesn't exist.

    In this order: ISO days (one digit will do), day/month/year, "n days ago" and "last (past, recent) n days" of two digits at most, words for
    days, days with a month's name (the year of ``today`` if none is said), words for weeks and months.
    """
    t = fold(text)
    span = lambda a, b: F.struct(a.alias("since"), b.alias("until"))
    day = lambda c: span(c, c)
    group = lambda shape, i: F.regexp_extract(t, shape, i)
    number = lambda s: F.nullif(s, F.lit("")).cast("int")
    date = lambda y, m, d: F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).cast("date")
    iso = r"(?<![0-9])([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?![0-9])"
    dmy = r"(?<![0-9])([0-9]{1,2})[\s/-]([0-9]{1,2})[\s/-]([0-9]{4})(?![0-9])"
    ago, last = r"(?<![0-9])([0-9]{1,2})\s+days?\s+ago", r"(?:last|past|recent)\s+([0-9]{1,2})\s+days?"
    out = F.when(group(iso, 1) != "", day(date(*[number(group(iso, i)) for i in (1, 2, 3)]))).when(group(dmy, 1) != "", day(date(*[number(group(dmy, i)) for i in (3, 2, 1)])))
    out = out.when(group(ago, 1) != "", day(F.date_sub(today, number(group(ago, 1))))).when(group(last, 1) != "", span(F.date_sub(today, number(group(last, 1)) - 1), today))
    said = lambda word: F.size(said_in(t, [word])) > 0
    for word, back in DAY_WORDS.items():
        out = out.when(said(word), day(F.date_sub(today, back)))
    named = F.transform(_named_days(t), lambda x: date(F.when(x["year"] >= 0, x["year"]).otherwise(F.year(today)), x["month"], x["day"]))
    first = F.try_element_at(F.array_compact(named), F.lit(1))
    out = out.when(first.isNotNull(), day(first))
    monday, month = F.date_trunc("week", today).cast("date"), F.trunc(today, "month")
    for word, weeks in WEEK_WORDS.items():
        out = out.when(said(word), span(F.date_add(monday, 7 * weeks), F.date_add(monday, 7 * weeks + 6)))
    for word, months in MONTH_WORDS.items():
        out = out.when(said(word), span(F.add_months(month, months), F.last_day(F.add_months(month, months))))
    return out


def search(rows: DataFrame, keep: Column, time: str, *, days: int | None = None, shown: int = 8, tie: str = "incident_id") -> DataFrame:
    """The newest ``shown`` of the rows that ``keep`` holds; with ``days``, of those days that end at the newest match."""
    found = rows.filter(keep)
    if days is not None:
        found = period(found, time, days).filter("in_period").drop("in_period")
    return found.orderBy(F.desc_nulls_last(time), F.desc(tie)).limit(shown)


def carried_actions(actions: DataFrame, events: DataFrame, past_phrases: list[str]) -> DataFrame:
    """Saved suggestions about events of the period, less those that speak of the past. ``actions``: action_id, text, event_ids."""
    past = F.lit(False)
    for phrase in past_phrases:
        past |= F.lower("text").contains(phrase)
    known = actions.filter(~past).select("action_id", "text", F.explode("event_ids").alias("event_id"))
    return known.join(events.select("event_id").distinct(), "event_id", "left_semi").groupBy("action_id", "text").agg(F.array_sort(F.collect_set("event_id")).alias("event_ids"))
