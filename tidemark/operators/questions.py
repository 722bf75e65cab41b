"""All questions of a table in one plan: reading, carried follow-ups, retrieval, and answers with citations.

Questions that ask the same (values, period) are one search. Events that hold the same values are one set. A search meets the sets that hold its
rarest value through an inverted index, and the sets themselves tell whether they hold the rest; events are counted by set and period. A search
without values has the pseudo value "any". Nothing is looped over on the driver: a follow-up is read together with what it follows by a
window over its session, so the second look is one more row of the same join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold
from ..functions.wording import claim_words
from ..storage import materialize
from .answers import question_window
from .contracts import answer_state, supported_statements

#: Fixed limits: events shown, quotes of an event, earlier questions that a follow-up carries, words of a value.
SHOWN, QUOTES, CARRIED, PHRASE = 8, 2, 5, 3
ANY = ("any", "any")
#: What is counted of a search.
COUNTED = ["events", "incidents", "previous", "undated", "outside"]


def follow_ups(questions: DataFrame, *, most: int = CARRIED) -> DataFrame:
    """Add ``asked`` (what is searched for) and ``carried`` to ``session, position, text, follows, general``.

    A follow-up is asked together with the question it follows and the follow-ups between, ``most`` of them. General questions are asked
    alone and carry nothing on. A follow-up that opens a session, or repeats the question before it, stands alone.
    """
    order = Window.partitionBy("session", "general").orderBy("position")
    before = F.lag("text").over(order)
    starts = F.col("general") | ~F.col("follows") | before.isNull() | (fold(before) == fold(F.col("text")))
    rows = questions.withColumn("_start", starts).withColumn("_part", F.sum(F.col("_start").cast("int")).over(order))
    held = Window.partitionBy("session", "general", "_part").orderBy("position").rowsBetween(-most, 0)
    asked = F.when(F.col("_start"), F.col("text")).otherwise(F.array_join(F.collect_list("text").over(held), " "))
    return rows.withColumn("asked", asked).withColumn("carried", ~F.col("_start")).drop("_start", "_part")


def phrases(text: Column, most: int = PHRASE) -> Column:
    """The runs of one to ``most`` words of a text, folded, each once."""
    words = F.filter(F.split(fold(text), r"[^\p{L}\p{M}\p{N}_#]+"), lambda w: w != "")
    runs = [F.filter(F.transform(words, lambda _, i: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), " "))), lambda p: p.isNotNull()) for n in range(1, most + 1)]
    return F.array_distinct(F.concat(*runs))


def read(questions: DataFrame, vocabulary: DataFrame, today: Column, *, key: str = "question_id") -> DataFrame:
    """``key, wanted, since, until, search_id``: the values (``facet, value``) and the days that each question names.

    ``questions``: ``key, asked``; ``vocabulary``: ``facet, value``, folded, of ``PHRASE`` words at most. A question joins with the
    values by its runs of words. Of one facet any of the named values will do.
    """
    named = questions.select(key, F.explode(phrases(F.col("asked"))).alias("value")).join(vocabulary.select("facet", "value").distinct(), "value")
    wanted = named.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("facet", "value"))).alias("wanted"))
    rows = questions.select(key, question_window(F.col("asked"), today).alias("w")).join(wanted, key, "left")
    rows = rows.select(key, F.coalesce("wanted", F.array().cast("array<struct<facet:string,value:string>>")).alias("wanted"), F.col("w.since").alias("since"), F.col("w.until").alias("until"))
    return rows.withColumn("search_id", F.sha2(F.to_json(F.struct("wanted", "since", "until")), 256))


def _sets(units: DataFrame) -> DataFrame:
    return units.withColumn("held", F.array_sort("held"))


def holders(units: DataFrame, searches: DataFrame) -> DataFrame:
    """``search_id, since, until, held``: the distinct sets of values (sorted) that hold what a search wants.

    ``units``: ``event_id, day, incidents, held`` (array of ``facet, value``), a row an event; ``searches``: distinct ``search_id, wanted, since, until``.
    """
    sets = _sets(units).select("held").distinct()
    lists = sets.select("held", F.explode(F.concat("held", F.array(F.struct(F.lit(ANY[0]).alias("facet"), F.lit(ANY[1]).alias("value"))))).alias("v")).select("held", "v.*")
    common = lists.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("sets"))
    # a facet costs as much as its values together; the cheapest one is looked up, the others are checked
    each = searches.select("search_id", F.explode("wanted").alias("v")).select("search_id", "v.*").join(common, ["facet", "value"], "left")
    cost = each.groupBy("search_id", "facet").agg(F.sum(F.coalesce("sets", F.lit(0))).alias("cost"), F.collect_set("value").alias("values"))
    rarest = cost.groupBy("search_id").agg(F.min_by(F.struct("facet", "values"), F.struct("cost", "facet")).alias("r"))
    keyed = searches.join(rarest, "search_id", "left").withColumn("facet", F.coalesce("r.facet", F.lit(ANY[0]))).withColumn("value", F.explode(F.coalesce("r.values", F.array(F.lit(ANY[1])))))
    facets = F.array_distinct(F.transform("wanted", lambda v: v["facet"]))
    holds = F.forall(facets, lambda f: F.exists("wanted", lambda v: (v["facet"] == f) & F.array_contains("held", v)))
    found = keyed.select("search_id", "wanted", "since", "until", "facet", "value").join(lists, ["facet", "value"]).filter(holds)
    return found.select("search_id", "since", "until", "held").dropDuplicates(["search_id", "held"])


def retrieve(units: DataFrame, searches: DataFrame, *, shown: int = SHOWN) -> DataFrame:
    """One row a search: ``events, incidents, previous, undated, outside, newest`` and the ``shown`` newest events (ties: the larger id first).

    Searches without a match have zeros. Events are counted and ranked once for each set of values and each period that some search asks for
    (in the period, in as many days before it, undated, another day), so a search adds up sets, not events.
    """
    period = F.to_json(F.struct("since", "until"))
    met = materialize(holders(units, searches).withColumn("period", period))
    days = F.datediff("until", "since") + 1
    dated = F.col("day").isNotNull()
    inside = F.col("since").isNull() | (dated & F.col("day").between(F.col("since"), F.col("until")))
    earlier = dated & (F.col("day") < F.col("since")) & (F.datediff("since", "day") <= days)
    place = F.when(inside, 0).when(~dated, 2).when(earlier, 1).otherwise(3)
    # a table of events is small as Parquet and many times larger in memory, so it is never sent whole
    each = met.select("held", "period", "since", "until").distinct().join(_sets(units).hint("merge"), "held").withColumn("place", place)
    inside = F.col("place") == 0
    counts = each.groupBy("held", "period").agg(
        F.count_if(inside).alias("events"), F.coalesce(F.sum(F.when(inside, F.col("incidents"))), F.lit(0)).alias("incidents"), F.count_if(F.col("place") == 1).alias("previous"),
        F.count_if(F.col("place") == 2).alias("undated"), F.count_if(~inside).alias("outside"), F.max("day").alias("newest"),
    )
    order = [F.desc_nulls_last("day"), F.desc("event_id")]
    best = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= shown)
    newest = best(each.filter(inside).select("held", "period", "event_id", "day"), "held", "period").groupBy("held", "period").agg(F.collect_list(F.struct("event_id", "day")).alias("top"))  # ``shown`` events
    of = materialize(counts.join(newest, ["held", "period"], "left"))
    met = met.select("search_id", "held", "period").join(of, ["held", "period"])
    sums = met.groupBy("search_id").agg(*[F.sum(c).alias(c) for c in COUNTED], F.max("newest").alias("newest"))
    top = best(met.select("search_id", F.explode("top").alias("t")).select("search_id", "t.*"), "search_id")
    top = top.groupBy("search_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"]).alias("shown"))  # ``shown`` ids
    zeros = {c: F.coalesce(c, F.lit(0)).alias(c) for c in COUNTED}
    out = searches.join(sums, "search_id", "left").join(top, "search_id", "left")
    return out.select("search_id", "wanted", "since", "until", *zeros.values(), "newest", F.coalesce("shown", F.array().cast("array<string>")).alias("shown"))


def emptiness(events: Column, undated: Column, outside: Column, since: Column) -> Column:
    """Why a search found nothing; null if it did."""
    return (
        F.when(events > 0, F.lit(None).cast("string")).when(outside == 0, "no record holds what is asked for")
        .when(since.isNotNull() & (undated == outside), "what matches carries no date").otherwise("nothing falls into the period")
    )


def quotes_of(found: DataFrame, evidence: DataFrame, *, most: int = QUOTES) -> DataFrame:
    """``search_id, citations``: of each shown event its first ``most`` quotes, each piece of evidence at its first event.

    ``evidence``: ``event_id, incident_id, evidence_id, quote, source_url``.
    """
    shown = found.select("search_id", F.posexplode("shown").alias("rank", "event_id"))
    rows = shown.join(evidence.filter("quote <> ''"), "event_id")
    once = F.row_number().over(Window.partitionBy("search_id", "evidence_id").orderBy("rank", "incident_id"))
    nth = F.row_number().over(Window.partitionBy("search_id", "event_id").orderBy("incident_id", "evidence_id"))
    kept = rows.withColumn("_n", once).filter("_n = 1").withColumn("_n", nth).filter(F.col("_n") <= most)
    cited = F.struct("rank", "incident_id", "evidence_id", "event_id", "quote", "source_url")
    return kept.groupBy("search_id").agg(F.array_sort(F.collect_list(cited)).alias("citations"))  # SHOWN x QUOTES at most


def measured() -> Column:
    """What a search counted, in words; the numbers that an answer may say."""
    c = F.col
    period = F.when(c("since").isNotNull(), F.concat(F.lit(" from "), c("since").cast("string"), F.lit(" to "), c("until").cast("string"))).otherwise("")
    change = F.when(c("since").isNotNull(), F.concat(c("previous").cast("string"), F.lit(" event(s) in as many days before.")))
    return F.array_compact(F.array(
        F.concat(c("events").cast("string"), F.lit(" distinct event(s) in "), c("incidents").cast("string"), F.lit(" report(s)"), period, F.lit(".")), change,
        F.when(c("undated") > 0, F.concat(c("undated").cast("string"), F.lit(" event(s) carry no date."))),
    ))


def answers(asked: DataFrame, found: DataFrame, evidence: DataFrame, drafts: DataFrame | None = None, *, key: str = "question_id") -> DataFrame:
    """One row a question: ``state, missing, statements, dropped, citations`` and what its search counted.

    ``asked``: :func:`read`; ``found``: :func:`retrieve`; ``drafts``: statements that a reader wrote (``key, text, calculated, cited_events, cited_evidence``).
    Without drafts an answer says what was measured and cites the quotes of what is shown. A statement is kept if it is cited, in scope, and
    its numbers were measured (:func:`contracts.supported_statements`); what was dropped, claims and thin quoting are findings.
    """
    rows = found.join(quotes_of(found, evidence), "search_id", "left")
    rows = materialize(rows.withColumn("citations", F.coalesce("citations", F.array().cast("array<struct<rank:int,incident_id:string,evidence_id:string,event_id:string,quote:string,source_url:string>>"))))
    missing = emptiness(F.col("events"), F.col("undated"), F.col("outside"), F.col("since"))
    every = asked.select(key, "search_id").join(rows.withColumn("lines", measured()).withColumn("missing", missing), "search_id")
    if drafts is None:
        said = every.filter("missing IS NULL").select(key, F.posexplode(F.concat(
            F.transform("lines", lambda t: F.struct(t.alias("text"), F.lit(True).alias("calculated"), F.col("shown").alias("cited_events"), F.array().cast("array<string>").alias("cited_evidence"))),
            F.transform("citations", lambda q: F.struct(q["quote"].alias("text"), F.lit(False).alias("calculated"), F.array(q["event_id"]).alias("cited_events"), F.array(q["evidence_id"]).alias("cited_evidence"))),
        )).alias("position", "s")).select(key, "position", "s.*")
    else:
        said = drafts.select(key, F.row_number().over(Window.partitionBy(key).orderBy("text")).alias("position"), "text", "calculated", "cited_events", "cited_evidence")
    scope = every.select(key, F.col("shown").alias("scope_events"), F.transform("citations", lambda q: q["evidence_id"]).alias("printed_evidence"), F.col("lines").alias("numbers"))
    judged = supported_statements(said.join(scope, key))
    told = judged.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("fault").isNull(), F.struct("position", "text")))), lambda s: s["text"]).alias("statements"),
        F.array_sort(F.collect_set("fault")).alias("dropped"),
    )
    none = F.array().cast("array<string>")
    out = every.join(told, key, "left").withColumn("statements", F.coalesce("statements", none)).withColumn("dropped", F.coalesce("dropped", none))
    quoted = F.size(F.array_distinct(F.transform("citations", lambda q: q["event_id"])))
    findings = F.concat("dropped", claim_words(F.array_join("statements", "\n")), F.when((F.col("events") >= 2) & (quoted < 2), F.array(F.lit("quotes too few events"))).otherwise(none))
    out = out.withColumn("findings", findings)
    state = answer_state(F.size("statements"), F.size("findings"), F.lit(True))
    reason = F.when(F.size("statements") == 0, F.coalesce("missing", F.lit("no statement carried its own citation")))
    return out.select(key, "search_id", state.alias("state"), reason.alias("missing"), "statements", "findings", "events", "incidents", "previous", (F.col("events") - F.col("previous")).alias("change"), "undated", "outside", "shown", "citations")


def units_of(rows: DataFrame, facets: dict[str, str], *, event: str, day: str) -> DataFrame:
    """``event_id, day, incidents, held`` of reports: the values that any report of an event states, folded."""
    pairs = reduce(F.concat, [F.array(F.struct(F.lit(facet).alias("facet"), fold(F.col(column)).alias("value"))) for facet, column in facets.items()])
    stated = F.filter(pairs, lambda v: F.coalesce(v["value"], F.lit("")) != "")
    one = rows.select(F.col(event).alias("event_id"), F.to_date(day).alias("day"), stated.alias("v"))
    return one.groupBy("event_id").agg(F.min("day").alias("day"), F.count(F.lit(1)).alias("incidents"), F.array_distinct(F.flatten(F.collect_set("v"))).alias("held"))
