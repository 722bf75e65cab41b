"""What periods hold, as one cube: distinct events, incidents, records and publishers by period, side and value, of one scan.

All lines of a briefing read from the cube, for any number of periods at once. A report lies inside a period, before or after it, or
carries no date; each is a ``side`` of its own, so what is left out is counted beside what is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .replies import window_note

INSIDE, OUTSIDE, UNDATED = SIDES = "inside", "outside", "undated"
#: Periods whose sides go into one number.
PERIODS = 20
#: States that are open and states that are on record.
OPEN, RECORDED = ["ongoing", "under_investigation"], ["action_taken", "resolved"]


def counted_back(reports: DataFrame, days: dict[str, int], *, day: str = "day") -> DataFrame:
    """``period_id, since, until, days_back, window_basis``: periods of so many days up to the newest report; without a dated one they have no bounds."""
    newest = reports.agg(F.max(day).alias("until"))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("period_id"), F.lit(n).alias("days_back")) for name, n in days.items()]))
    rows = newest.select("until", named.alias("p")).select("p.period_id", F.expr("date_sub(until, p.days_back - 1)").alias("since"), "until", "p.days_back")
    return rows.withColumn("window_basis", F.when(F.col("until").isNull(), "none").otherwise("record"))


def standing(status: Column, quoted: Column) -> Column:
    """``open``, ``recorded``, ``unquoted`` (a status without words to quote), ``unstated`` or ``other``."""
    stated = status.isNotNull() & ~status.isin("unknown", "unresolved", "")
    return F.when(~stated, "unstated").when(~F.coalesce(quoted, F.lit(False)), "unquoted").when(status.isin(OPEN), "open").when(status.isin(RECORDED), "recorded").otherwise("other")


def cube(reports: DataFrame, periods: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """``period_id, side, dimension, value, events, incidents, records, sources``; ``dimension`` is null in the rows of all values together.

    ``reports``: ``event_id, incident_id, record_id, source_id, day``; ``facets``: dimension to an array of values of a report (null: none).
    An event counts under every value that any of its reports has. ``periods`` (a few rows) are broadcast; a period without bounds holds all.
    """
    tagged = lambda name, held: F.transform(F.coalesce(held, F.array().cast("array<string>")), lambda x: F.struct(F.lit(name).alias("dimension"), x.alias("value")))
    values = F.concat(*[tagged(name, held) for name, held in facets.items()])
    stated = F.filter(values, lambda v: F.coalesce(v["value"], F.lit("")) != "")
    tagged_ids = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in enumerate(("event_id", "incident_id", "record_id", "source_id"))])
    # what lies where is a bit a period and side, so an id is shuffled once a value, for all periods together
    place = F.floor((F.row_number().over(Window.orderBy("period_id")) - 1) / PERIODS)
    named = periods.select("period_id", "since", "until").withColumn("part", place)
    bounds = named.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("period_id", "since", "until"))).alias("bounds"))
    inside = lambda p: (F.col("day") >= F.coalesce(p["since"], F.col("day"))) & (F.col("day") <= F.coalesce(p["until"], F.col("day")))
    side = lambda p: F.when(p["since"].isNull() & p["until"].isNull(), 0).when(F.col("day").isNull(), 2).when(inside(p), 0).otherwise(1)
    bits = F.aggregate(F.transform("bounds", lambda p, i: F.call_function("shiftleft", F.lit(1).cast("long"), i * len(SIDES) + side(p))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    every = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("dimension"), F.lit(None).cast("string").alias("value"))), stated)
    rows = reports.withColumn("_values", F.array_distinct(every)).crossJoin(F.broadcast(bounds)).select("part", bits.alias("bits"), "_values", tagged_ids.alias("_ids"))
    rows = rows.select("part", "bits", "_ids", F.explode("_values").alias("v")).select("part", "bits", "v.dimension", "v.value", F.explode("_ids").alias("i"))
    held = rows.groupBy("part", "dimension", "value", "i.kind", "i.id").agg(F.bit_or("bits").alias("bits"))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(PERIODS * len(SIDES) - 1)), lambda b: F.getbit("bits", b) == 1)).alias("bit")
    count = lambda k: F.count_if((F.col("kind") == k) & F.col("id").isNotNull())
    cells = held.select("part", "dimension", "value", "kind", "id", bit).groupBy("part", "bit", "dimension", "value").agg(*[count(k).alias(n) for k, n in enumerate(("events", "incidents", "records", "sources"))])
    of = F.floor(F.col("bit") / len(SIDES)) == F.col("at")
    known = bounds.select("part", F.posexplode("bounds").alias("at", "p")).select("part", "at", "p.period_id")
    told = cells.join(F.broadcast(known), "part").filter(of)
    return told.select("period_id", F.element_at(F.array(*map(F.lit, SIDES)), F.col("bit") % len(SIDES) + 1).alias("side"), "dimension", "value", "events", "incidents", "records", "sources")


def emptiness(cells: DataFrame, periods: DataFrame, *, read: int, kept: int) -> DataFrame:
    """``period_id, reason``: why a period counts nothing, by the first that holds; null where it counts.

    ``read`` reports were read, ``kept`` of them passed the filter.
    """
    sides = cells.filter("dimension IS NULL").groupBy("period_id").agg(*[F.coalesce(F.max(F.when(F.col("side") == s, F.col("events"))), F.lit(0)).alias(s) for s in (INSIDE, OUTSIDE, UNDATED)])
    rows = periods.join(sides, "period_id", "left")
    none = F.format_string("the records read hold %d event(s) with no date at all and none dated in the period", F.coalesce(UNDATED, F.lit(0)))
    reason = F.when(F.lit(read == 0), "no record was read").when(F.lit(kept == 0), "no accepted report matches the filter").when(F.coalesce(INSIDE, F.lit(0)) == 0, none)
    return rows.select("period_id", reason.alias("reason"))


def _said(cells: DataFrame, dimension: str, label: str, *, counted: bool = False) -> DataFrame:
    one = F.concat("value", F.lit(" ("), F.col("events").cast("string"), F.lit(" event(s))")) if counted else F.col("value")
    rows = cells.filter((F.col("side") == INSIDE) & (F.col("dimension") == dimension))
    return rows.groupBy("period_id").agg(F.concat(F.lit(f"{label}: "), F.array_join(F.array_sort(F.collect_list(one)), ", "), F.lit(".")).alias(f"_{dimension}"))


def lines(cells: DataFrame, periods: DataFrame, reasons: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """``period_id, position, line``: all that a briefing of a period may count, in words.

    ``cells``: :func:`cube` with the dimensions ``area, category, type, severity, standing`` (others aren't told); ``overlaps``: ``period_id, item_id, kind, events, shared``
    of saved families and trends. Nothing is said of what is zero and left out.
    """
    c = F.col
    totals = cells.filter("dimension IS NULL").groupBy("period_id").agg(
        *[F.max(F.when(c("side") == INSIDE, c(n))).alias(n) for n in ("events", "incidents", "records", "sources")], F.max(F.when(c("side") == UNDATED, c("events"))).alias("undated"), F.max(F.when(c("side") == OUTSIDE, c("events"))).alias("outside"),
    )
    stands = cells.filter((c("side") == INSIDE) & (c("dimension") == "standing")).groupBy("period_id").agg(*[F.coalesce(F.max(F.when(c("value") == s, c("incidents"))), F.lit(0)).alias(f"s_{s}") for s in ("open", "recorded", "unstated", "unquoted")])
    rows = periods.join(totals, "period_id", "left").join(stands, "period_id", "left").join(reasons, "period_id", "left")
    named = {"area": "Places in the period", "category": "Categories here", "type": "Event types here", "severity": "Severities here"}
    for dimension, label in named.items():
        rows = rows.join(_said(cells, dimension, label, counted=dimension == "area"), "period_id", "left")
    if overlaps is not None:
        told = F.format_string("%s %s counts %d of its %d event(s) in this period.", F.when(c("kind") == "family", "Saved recurring issue").otherwise("Measured increase"), "item_id", "shared", "events")
        rows = rows.join(overlaps.groupBy("period_id").agg(F.array_sort(F.collect_list(told)).alias("_saved")), "period_id", "left")
    else:
        rows = rows.withColumn("_saved", F.array().cast("array<string>"))
    span = F.when(c("since").isNull() & c("until").isNull(), "all of it").otherwise(F.concat(F.coalesce(c("since").cast("string"), F.lit("the beginning")), F.lit(" to "), F.coalesce(c("until").cast("string"), F.lit("now"))))
    count = lambda n: F.coalesce(c(n), F.lit(0))
    holds = F.format_string("The period holds %d distinct event(s) from %d accepted incident(s) in %d record(s) filed by %d publisher(s).", count("events"), count("incidents"), count("records"), count("sources"))
    states = F.format_string("Open with a quote: %d, action or resolution recorded: %d, no status evidenced: %d, a status stated with no words to quote: %d.", *[count(f"s_{s}") for s in ("open", "recorded", "unstated", "unquoted")])
    every = F.array(
        F.concat(F.lit("Period: "), span, F.lit(" - "), window_note(c("window_basis"), c("days_back"), c("until"), F.lit("event_time")), F.lit(".")), F.when(c("reason").isNull(), holds).otherwise(F.concat(F.lit("Nothing was measured for this period: "), c("reason"), F.lit("."))),
        *[c(f"_{n}") for n in named], F.when(c("reason").isNull(), states), F.when(count("undated") > 0, F.format_string("%d distinct event(s) in these records carry no date, so they fall in no period.", count("undated"))),
        F.when(count("outside") > 0, F.format_string("%d dated event(s) fall outside this period and are not counted here.", count("outside"))),
    )
    return rows.select("period_id", F.posexplode(F.concat(F.array_compact(every), F.coalesce("_saved", F.array().cast("array<string>")))).alias("position", "line"))
