"""Grounding of drafts: a quote is kept where the record holds it, moved to the one field that does, or refused with a code."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.ids import span_id
from ..functions.text import squeeze

#: Keys that only the map service may give; a draft that carries one loses it. Fixed values.
GIS_KEYS = ["latitude", "longitude", "lat", "lon", "lng", "geometry", "canonical_location_id", "canonical_id", "resolution_state"]
#: Least size of a run that brackets a stretch, most occurrences of one, and longest stretch as a multiple of the citation.
RUN, OCCURRENCES, REACH = 8, 8, 2.0


def _places(text: str, part: str) -> list[int]:
    out, at = [], text.find(part)
    while at >= 0 and len(out) <= OCCURRENCES:
        out.append(at)
        at = text.find(part, at + 1)
    return out if len(out) <= OCCURRENCES else []


def _at_edge(text: str, i: int) -> bool:
    return i in (0, len(text)) or not (text[i - 1].isalnum() and text[i].isalnum())


def _runs(text: str, citation: str, sizes: list[int], closing: bool) -> dict[int, int]:
    """Where opening (closing) runs of the allowed ``sizes`` begin (end) in ``text``, and how long the longest is there.

    Longer runs stand where shorter ones do. So the shortest that occurs often enough to be found and seldom enough to be told apart has all places, and each is
    read on from there.
    """
    for n in sizes:
        run = citation[-n:] if closing else citation[:n]
        if run not in text:
            return {}
        if found := _places(text, run):
            break
    else:
        return {}
    out = {}
    for at in found:
        edge, size = at + n if closing else at, n
        if closing:
            while size < len(citation) and size < edge and text[edge - size - 1] == citation[-size - 1]:
                size += 1
        else:
            while size < len(citation) and edge + size < len(text) and text[edge + size] == citation[size]:
                size += 1
        out[edge] = size
    return out


def bracketed(fields: list[tuple[str, str]], citation: str) -> tuple[str, int, int] | str | None:
    """``(path, start, end)`` of the one stretch that the opening and the closing words of a citation bracket best.

    Opening and closing run have ``RUN`` characters or more, end at word edges, don't overlap in the citation, and the stretch
    occurs once. ``"tied"`` if several stretches are bracketed equally well, None if there is none.
    """
    sizes = list(range(RUN, len(citation) - RUN + 1))
    heads = [n for n in sizes if _at_edge(citation, n)]
    tails = [n for n in sizes if _at_edge(citation, len(citation) - n)]
    best: dict[tuple[str, int, int], int] = {}
    for path, text in fields:
        starts, stops = _runs(text, citation, heads, False), _runs(text, citation, tails, True)
        for start, head in starts.items():
            for stop, tail in stops.items():
                room = min(len(citation), stop - start)
                if room < 2 * RUN or stop - start > REACH * len(citation):
                    continue
                fits = 0
                for h in heads[: bisect_right(heads, head)]:
                    at = bisect_right(tails, min(tail, room - h)) - 1
                    if at >= 0 and tails[at] == h and citation[:h] == citation[-h:]:
                        at -= 1  # one run can't be both
                    if at >= 0:
                        fits = max(fits, h + tails[at])
                if fits and len(_places(text, text[start:stop])) == 1:
                    best[path, start, stop] = fits
    if not best:
        return None
    top = max(best.values())
    found = [k for k, v in best.items() if v == top]
    return found[0] if len(found) == 1 else "tied"


BRACKET = T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("tied", T.BooleanType())])


@F.pandas_udf(BRACKET)
def _bracket(fields: pd.Series, citation: pd.Series) -> pd.DataFrame:
    rows = []
    for own, text in zip(fields, citation, strict=True):
        hit = bracketed([(f["path"], f["text"]) for f in own], text) if own is not None and text else None
        rows.append((None, None, None, hit == "tied") if hit is None or hit == "tied" else (*hit, False))
    return pd.DataFrame(rows, columns=["path", "start", "end", "tied"], dtype=object)


def ground(answers: DataFrame, *, inexact: bool = False) -> DataFrame:
    """Answers with ``code`` (null: grounded), ``path, start, end`` of the evidence, and ``moved`` if it isn't where it was cited.

    ``answers``: ``fields`` (array of ``struct(path, text)``: what the record may be quoted from), ``cited`` (a path), ``quote`` and
    ``stated`` (the place of the quote, or null). A quote that occurs several times needs the stated place. One that its
    field lacks is looked for in the others: the one that holds it once and of which it is the largest part has it. With
    ``inexact``, a citation that no field holds may be anchored by its opening and closing words.
    """
    q = F.col("quote")
    own = F.try_element_at(F.filter("fields", lambda f: f["path"] == F.col("cited")), F.lit(1))
    at = lambda text: F.position(q, text)
    once = lambda text: (at(text) > 0) & (F.position(q, text, at(text) + 1) == 0)
    size = F.length(q)
    carriers = F.filter("fields", lambda f: (f["path"] != F.col("cited")) & once(f["text"]))
    ordered = F.array_sort(F.transform(carriers, lambda f: F.struct(F.length(f["text"]).alias("size"), f["path"].alias("path"), (at(f["text"]) - 1).alias("start"))))
    first, second = F.try_element_at(ordered, F.lit(1)), F.try_element_at(ordered, F.lit(2))
    elsewhere = F.when(first.isNotNull() & ~F.coalesce(first["size"] == second["size"], F.lit(False)), first)
    rows = answers.withColumn("_own", own["text"]).withColumn("_else", elsewhere).withColumn("_held", F.exists("fields", lambda f: at(f["text"]) > 0))
    blank = F.coalesce(F.trim(q), F.lit("")) == ""
    here, single = F.coalesce(at(F.col("_own")) > 0, F.lit(False)), F.coalesce(once(F.col("_own")), F.lit(False))
    stated = F.coalesce(F.substr(F.col("_own"), F.col("stated") + 1, size) == q, F.lit(False)) & (F.col("stated") >= 0)
    lost = ~blank & F.col("_own").isNotNull() & ~here & F.col("_else").isNull() & ~F.col("_held")
    rows = rows.withColumn("_b", _bracket(F.when(lost, F.col("fields")), F.when(lost, q))) if inexact else rows.withColumn("_b", F.lit(None).cast(BRACKET))
    anchored = F.col("_b.path").isNotNull()
    code = _code(blank, single, here, stated, anchored)
    start = F.when(single, at(F.col("_own")) - 1).when(here, F.col("stated")).otherwise(F.coalesce("_else.start", "_b.start"))
    path = F.when(here, F.col("cited")).otherwise(F.coalesce("_else.path", "_b.path"))
    end = F.when(here | F.col("_else").isNotNull(), start + size).otherwise(F.col("_b.end"))
    fine = F.col("code").isNull()
    keep = lambda c: F.when(fine, c)
    rows = rows.withColumn("code", code)
    rows = rows.withColumn("path", keep(path)).withColumn("start", keep(start)).withColumn("end", keep(end)).withColumn("moved", fine & ~here)
    return rows.drop("_own", "_else", "_held", "_b")


def _code(blank: Column, single: Column, here: Column, stated: Column, anchored: Column) -> Column:
    """The rungs of :func:`ground`, in order; null where the quote is grounded."""
    fine = F.lit(None).cast("string")
    return (
        F.when(blank, F.lit("unsupported_claim")).when(F.col("_own").isNull(), F.lit("unknown_field")).when(single | (here & stated), fine).when(here, F.lit("ambiguous_quote"))
        .when(F.col("_else").isNotNull() | anchored, fine).when(F.coalesce(F.col("_b.tied"), F.lit(False)) | F.col("_held"), F.lit("ambiguous_quote")).otherwise(F.lit("unsupported_claim"))
    )


def build_evidence(rows: DataFrame, *, method: str = "llm") -> DataFrame:
    """``evidence_id`` and ``fault`` of spans (``record_id, path, text, quote, start, end``): bounds first, then the words."""
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("text"))
    held = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote")
    fault = F.when(~F.coalesce(inside, F.lit(False)), "out of bounds").when(~held, "other words")
    made = span_id(F.col("record_id"), F.col("path"), F.col("start"), F.col("end"), F.lit(method), F.col("quote"))
    return rows.withColumn("fault", fault).withColumn("evidence_id", F.when(F.col("fault").isNull(), made))


def without_gis_keys(item: Column) -> Column:
    """``struct(item, dropped)`` of a draft place (a map): what only the map service may say is taken out."""
    held = F.array_sort(F.array_intersect(F.map_keys(item), F.array(*map(F.lit, GIS_KEYS))))
    return F.struct(F.map_filter(item, lambda k, v: ~k.isin(GIS_KEYS)).alias("item"), held.alias("dropped"))


def prompt_lines(lines: DataFrame, *, most_chars: int = 45_000) -> DataFrame:
    """The numbered source lines of each job, in order, up to the first that would pass ``most_chars`` in all."""
    text = F.concat(F.lit("[line_id="), F.col("line").cast("string"), F.lit("; page="), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit("] "), F.trim("text"))
    rows = lines.filter(F.trim("text") != "").withColumn("row", text)
    so_far = Window.partitionBy("job_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_chars", F.sum(F.length("row")).over(so_far)).filter(F.col("_chars") <= most_chars).select("job_id", "line", "row")


def insight_verdicts(items: DataFrame, texts: DataFrame) -> DataFrame:
    """``item_id, accepted`` of drafted items (``item_id, job_id, quote``): the quote is in the job's text, white space squeezed."""
    source = texts.select("job_id", squeeze(F.col("text")).alias("_source"))
    quote = squeeze(F.coalesce("quote", F.lit("")))
    return items.join(source, "job_id", "left").select("item_id", F.coalesce((quote != "") & F.contains("_source", quote), F.lit(False)).alias("accepted"))
