"""Best partners of every report, by sorted neighbours within combinations of shared signals.

Partners rank by how many signals they share, then by the gap in time. Reports are therefore looked up by combinations of
signals, first those of three and more, then pairs, then single ones: among the reports that have a combination, the best partners are the nearest in time. A report that has
found enough partners in one pass is closed and doesn't ask again, so a signal that a third of all reports have is searched by
the few reports that have nothing better.

Nearest partners come without pairing a combination with itself: its time points (with counts of reports) are sorted, each sees a few points
before and after, and the counts tell how far a report has to look. Only the points within that reach are joined. All reports at the last gap
that counts are compared, as ties go by link id; that join is by (combination, time point), and skewed ones are split by Spark.

Where all reports are dated and none has more than ``MOST_SIGNALS`` signals, they are searched in cells of time instead (:mod:`tidemark.operators.cells`), by one shuffle;
only those of cells too dense for a task, and of records with very many reports, are looked up by combinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import link_id
from ..storage import materialize, release
from . import cells

#: Signals of a report that is looked up by combinations; the pairs of reports with more are found by single signals within their weeks.
MOST_SIGNALS = 6

#: Time points that a point sees on either side. A report whose record has more than ``SIDE + 1 - pairs`` reports meets all of its weeks.
SIDE = 6

_IN, _BETWEEN = "\u001e", "\u001f"
_ASK = ["key", "id", "record", "marks", "second"]


def combinations(signals: Column, least: int, most: int) -> Column:
    """All combinations of ``least`` to ``most`` elements of an array of strings, each as one string."""
    every = F.sequence(F.lit(1), F.pow(F.lit(2), F.size(signals)).cast("long") - 1)
    chosen = F.filter(every, lambda m: F.bit_count(m).between(least, most))
    return F.transform(chosen, lambda m: F.concat_ws(_BETWEEN, F.filter(signals, lambda _, i: F.getbit(m, i) == 1)))


def reports(sig: DataFrame) -> DataFrame:
    """``id, record, second, signals, marks, many``: a row a report, with hashes of its signals and the number of reports of its record."""
    rows = sig.groupBy(F.col("incident_id").alias("id"), F.col("record_id").alias("record"), F.unix_timestamp("reported_at").alias("second")).agg(F.array_sort(F.collect_set(F.concat_ws(_IN, "kind", "value"))).alias("signals"))
    many = rows.groupBy("record").agg(F.count(F.lit(1)).alias("many"))
    return rows.withColumn("marks", F.transform("signals", lambda s: F.xxhash64(s))).join(many, "record")


def _keyed(rows: DataFrame, least: int, most: int) -> DataFrame:
    return rows.filter(F.size("signals") >= least).select("id", "record", "second", "marks", "many", F.explode(combinations(F.col("signals"), least, most)).alias("key"))


def time_points(keyed: DataFrame, span: int, pairs: int) -> DataFrame:
    """``key, second, reach, lonely``: for each time point of a key the points that its reports have to look at, and whether those are too few.

    Of the points at most ``span`` away, ``SIDE`` a side, the nearest ones are taken until they hold ``pairs`` reports of other records, the last
    distance whole. A point is seen from its own span of time and from the two beside it, so a key's points are sorted in pieces of three spans.
    """
    counts = keyed.filter("second IS NOT NULL").groupBy("key", "second").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many"))
    own = F.floor(F.col("second") / span)
    cells = counts.select("*", F.explode(F.array(own - 1, own, own + 1)).alias("cell"))
    seen = F.collect_list(F.struct("second", "n")).over(Window.partitionBy("key", "cell").orderBy("second").rowsBetween(-SIDE, SIDE))
    gap = lambda p: F.abs(p["second"] - F.col("second"))
    total = lambda points: F.aggregate(points, F.lit(0).cast("long"), lambda s, p: s + p["n"])
    nearer = lambda p: total(F.filter("near", lambda q: gap(q) < gap(p)))
    need = F.col("many") + pairs
    rows = cells.withColumn("seen", seen).filter(F.col("cell") == own).withColumn("near", F.filter("seen", lambda p: gap(p) <= span))
    lonely = total(F.col("near")) < need
    reach = F.when(lonely, F.col("near")).otherwise(F.filter("near", lambda p: nearer(p) < need))
    return rows.select("key", "second", reach["second"].alias("reach"), lonely.alias("lonely"))


def _partners(asks: DataFrame, keyed: DataFrame, pairs: int, span: int, *, undated: bool, crowded: bool) -> DataFrame:
    """Pairs of an asking report and a report that may be among its best, found by one combination: ``id, other, shared, gap_seconds``.

    ``undated`` and ``crowded`` say whether there are reports without time, and records with so many reports that they meet whole weeks.
    """
    need = F.col("many") + pairs
    dated = asks.filter("second IS NOT NULL")
    narrow = dated.filter(need <= SIDE + 1).select(*_ASK).join(time_points(keyed, span, pairs), ["key", "second"])
    other = lambda *more: keyed.select("key", F.col("id").alias("other"), F.col("record").alias("other_record"), F.col("marks").alias("other_marks"), F.col("second").alias("other_second"), *more)
    reached = narrow.select(*_ASK, F.explode("reach").alias("other_second"))
    met = [reached.join(other(), ["key", "other_second"])]
    if crowded:
        week = F.floor(F.col("second") / span)
        wide = dated.filter(need > SIDE + 1).select(*_ASK, F.explode(F.array(week - 1, week, week + 1)).alias("week"))
        met.append(wide.join(other(week.alias("week")), ["key", "week"]).drop("week"))
    if undated:
        lonely = narrow.filter("lonely").select(*_ASK).unionByName(dated.filter(need > SIDE + 1).select(*_ASK))
        met.append(lonely.join(other().filter("other_second IS NULL"), "key"))
        met.append(asks.filter("second IS NULL").select(*_ASK).join(other(), "key"))
    gap = F.abs(F.col("second") - F.col("other_second"))
    out = None
    for rows in met:
        found = rows.filter((F.col("id") != F.col("other")) & (F.col("record") != F.col("other_record")) & (gap.isNull() | (gap <= span)))
        found = found.select("id", "other", F.size(F.array_intersect("marks", "other_marks")).cast("long").alias("shared"), gap.alias("gap_seconds"))
        out = found if out is None else out.unionByName(found)
    return out


def _crowded_pairs(crowded: DataFrame, base: DataFrame, span: int, *, undated: bool) -> DataFrame:
    """All pairs of which one report is in ``crowded``, from either end: ``id, other, shared, gap_seconds``."""
    one = lambda rows: rows.select("id", "record", "second", "marks", F.explode("signals").alias("key"))
    other = one(base).select("key", F.col("id").alias("other"), F.col("record").alias("other_record"), F.col("marks").alias("other_marks"), F.col("second").alias("other_second"))
    week, own = F.floor(F.col("other_second") / span), F.floor(F.col("second") / span)
    asks = one(crowded)
    met = asks.withColumn("week", F.explode(F.array(own - 1, own, own + 1))).join(other.withColumn("week", week), ["key", "week"]).drop("week")
    if undated:
        met = met.unionByName(asks.filter("second IS NULL").join(other, "key")).unionByName(asks.filter("second IS NOT NULL").join(other.filter("other_second IS NULL"), "key"))
    gap = F.abs(F.col("second") - F.col("other_second"))
    fine = met.filter((F.col("id") != F.col("other")) & (F.col("record") != F.col("other_record")) & (gap.isNull() | (gap <= span)))
    pairs = fine.select("id", "other", F.size(F.array_intersect("marks", "other_marks")).cast("long").alias("shared"), gap.alias("gap_seconds")).distinct()
    return pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"), "shared", "gap_seconds"))


def nearest_pairs(sig: DataFrame, *, pairs: int, gap_days: int) -> DataFrame:
    """``low_id, high_id, shared, gap_seconds, link_id``: for each report its ``pairs`` best partners, both ends' choices together.

    ``sig`` has ``incident_id, record_id, reported_at, kind, value``; a pair shares a signal, comes of two records and was reported at most
    ``gap_days`` apart; a pair with an unknown gap counts, after all others that share as much. Ties go to the smaller link id. A
    report of m signals has 2^m combinations; those of more than ``MOST_SIGNALS`` meet all reports of their weeks by single signals instead. Signals are counted by 64-bit hashes.
    """
    span = gap_days * 86400
    base = materialize(reports(sig))
    far = F.size("signals") > MOST_SIGNALS
    row = base.agg(F.max(F.when(~far, F.size("signals"))).alias("most"), F.coalesce(F.bool_or(F.col("second").isNull()), F.lit(False)).alias("undated"), F.max("many").alias("many"), F.count_if(far).alias("broad"),
                   F.count(F.lit(1)).alias("n"), F.min("second").alias("first"), F.max("second").alias("last")).first()
    if row.undated or row.broad or not row.n:
        out = _by_combinations(base, base, row, pairs, span)
        release(base)
        return out
    width = cells.cell_width(row.n, row.first, row.last, span)
    sent = cells.celled(base, width, span)
    dense = [r.cell for r in sent.groupBy("cell").count().filter(F.col("count") > cells.MOST_ROWS).collect()]
    found = cells.best_in_cells(sent.filter(~F.col("cell").isin(dense)) if dense else sent, pairs=pairs, span=span)
    low, high = F.least("id", "other"), F.greatest("id", "other")
    near = materialize(found.select(low.alias("low_id"), high.alias("high_id"), "shared", "gap_seconds", link_id(low, high).alias("link_id"), "across"))
    if not dense and row.many <= cells.MOST_REPORTS:
        release(base)
        return near.filter("NOT across").drop("across").unionByName(near.filter("across").drop("across").distinct())
    asking = base.filter(F.floor(F.col("second") / width).isin(dense) | (F.col("many") > cells.MOST_REPORTS))
    rest = _by_combinations(base, asking, row, pairs, span)
    release(base)
    return near.drop("across").unionByName(rest).distinct()


def _by_combinations(base: DataFrame, asking: DataFrame, row: Row, pairs: int, span: int) -> DataFrame:
    """The pairs that the reports in ``asking`` choose among all of ``base``, looked up by combinations."""
    most, undated, many, broad = row.most, row.undated, row.many, row.broad
    narrow, crowded = base.filter(F.size("signals") <= MOST_SIGNALS), base.filter(F.size("signals") > MOST_SIGNALS)
    asking = asking.filter(F.size("signals") <= MOST_SIGNALS)
    passes = [(least, top) for least, top in ((3, most or 0), (2, 2), (1, 1)) if least <= min(top, most or 0)]
    rank = F.dense_rank().over(Window.partitionBy("id").orderBy(F.desc("shared"), F.asc_nulls_last("gap_seconds"), "link_id"))
    link = link_id(F.least("id", "other"), F.greatest("id", "other"))
    best = lambda found: found.withColumn("_rank", rank).filter(F.col("_rank") <= pairs).drop("_rank").dropDuplicates(["id", "other"])
    held, done, tables = None, [], []
    if broad:
        extra = materialize(best(_crowded_pairs(crowded, base, span, undated=undated).withColumn("link_id", link)))
        tables.append(extra)
        done.append(extra.join(crowded.select("id"), "id", "left_semi"))
        held = extra.join(crowded.select("id"), "id", "left_anti")
        if not passes:
            done.append(held)
    for sizes in passes:
        found = _partners(_keyed(asking, *sizes), _keyed(narrow, *sizes), pairs, span, undated=undated, crowded=many + pairs > SIDE + 1).withColumn("link_id", link)
        if held is not None:
            found = found.unionByName(held)
        # a report is closed once it has enough partners that share as much as this pass looks for
        enough = F.count_if(F.col("shared") >= sizes[0]).over(Window.partitionBy("id"))
        after = materialize(best(found).withColumn("n", enough))
        tables.append(after)
        done.append((after.filter(F.col("n") >= pairs) if sizes != passes[-1] else after).drop("n"))
        held = after.filter(F.col("n") < pairs).drop("n")
        asking = asking.join(after.filter(F.col("n") >= pairs).select("id").distinct(), "id", "left_anti")
    if not done:
        empty = base.select(F.col("id").alias("low_id"), F.col("id").alias("high_id"), F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("gap_seconds"), F.lit("").alias("link_id"))
        return empty.filter("false")
    chosen = done[0]
    for more in done[1:]:
        chosen = chosen.unionByName(more)
    out = materialize(chosen.select(F.least("id", "other").alias("low_id"), F.greatest("id", "other").alias("high_id"), "shared", "gap_seconds", "link_id").distinct())
    release(*tables)
    return out
