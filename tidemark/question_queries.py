"""Queries of all questions in one plan, over the turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.wording import digit_set
from .operators import answers, checks, contracts, filters, questions
from .queries import POOL_SQL
from .registering import query
from .sources import views
from .storage import materialize

#: User turns with a place, a category or a period added to what they say; some follow the turn before, some are general.
ASKED_SQL = r"""turns AS (
    SELECT conv_id, turn, conv_id * 1000 + turn AS question_id, substr(text, 1, 40) || ' about ' || CASE (conv_id + turn) % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || ', building' WHEN 2 THEN 'Machinery in the last 60 days' ELSE 'it' END
      || CASE WHEN conv_id % 5 = 2 THEN ' or FURNITURE last 90 days' ELSE '' END AS text, (conv_id + turn) % 3 = 0 AS follows, conv_id % 7 = 3 AND turn = 2 AS general
    FROM conversations LEFT JOIN nation ON conv_id % 25 = n_nationkey WHERE role = 'user'),
  begun AS (SELECT *, coalesce(general OR NOT follows OR before IS NULL OR lower(before) = lower(text), true) AS fresh FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id, general ORDER BY turn) AS before FROM turns)),
  parts AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY conv_id, general ORDER BY turn) AS part FROM begun),
  asked AS (SELECT question_id, NOT fresh AS carried, CASE WHEN fresh THEN text ELSE string_agg(text, ' ') OVER (PARTITION BY conv_id, general, part ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS asked FROM parts),
  said AS (SELECT *, ' ' || array_to_string(list_filter(regexp_split_to_array(replace(lower(asked), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}_#]+'), lambda w: w <> ''), ' ') || ' ' AS words FROM asked),
  events AS (SELECT incident_id AS event_id, CASE WHEN severity <> 'low' THEN event_time::DATE END AS day, lower(category) AS category, lower(taluk) AS place, CASE WHEN incident_type <> 'unresolved' THEN incident_type END AS kind FROM pool),
  held AS (SELECT event_id, day, unnest([{'facet': 'category', 'value': category}, {'facet': 'place', 'value': place}, {'facet': 'type', 'value': kind}], recursive := true) FROM events),
  vocabulary AS (SELECT DISTINCT facet, value FROM held WHERE value IS NOT NULL),
  wanted AS (SELECT question_id, facet, value FROM said JOIN vocabulary ON contains(words, ' ' || value || ' ')),
  today AS (SELECT max(day) AS today FROM events),
  spans AS (SELECT question_id, carried, regexp_extract(lower(asked), 'last (\d{1,2}) days', 1) AS n, today FROM said, today),
  dated AS (SELECT question_id, carried, CASE WHEN n <> '' THEN (today - (n::INTEGER - 1))::DATE END AS since, CASE WHEN n <> '' THEN today END AS until FROM (SELECT * REPLACE (coalesce(n, '') AS n) FROM spans))"""


def _asked(spark, d):
    rows = views.table(spark, d, "conversations").filter("role = 'user'")
    rows = rows.join(views.table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("conv_id") % 25 == F.col("n_nationkey"), "left")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    more = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat(F.lower("n_name"), F.lit(", building"))).when(kind == 2, "Machinery in the last 60 days").otherwise("it")
    text = F.concat(F.substring("text", 1, 40), F.lit(" about "), more, F.when(F.col("conv_id") % 5 == 2, " or FURNITURE last 90 days").otherwise(""))
    turns = rows.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("position"), (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), text.alias("text"),
        ((F.col("conv_id") + F.col("turn")) % 3 == 0).alias("follows"), ((F.col("conv_id") % 7 == 3) & (F.col("turn") == 2)).alias("general"),
    )
    return questions.follow_ups(turns)


def _read(spark, d):
    pool = filters.accepted_pool(views.incidents(spark, d)).withColumn("day", F.when(F.col("severity") != "low", F.col("event_time"))).withColumn("kind", F.when(F.col("incident_type") != "unresolved", F.col("incident_type")))
    units = materialize(questions.units_of(pool, {"category": "category", "place": "taluk", "type": "kind"}, event="incident_id", day="day"))
    vocabulary = units.select(F.explode("held").alias("v")).select("v.*").distinct()
    asked = _asked(spark, d)
    today = F.broadcast(units.agg(F.max("day").alias("today")))  # one row
    return pool, units, asked, materialize(questions.read(asked.crossJoin(today), vocabulary, F.col("today")))


READ_RULES = {
    "days out of range": "until - since + 1 NOT BETWEEN 1 AND 365", "comparison without a window": "carried AND since IS NULL", "place as a filter": "n > 2 AND place IS NOT NULL", "window without dates": "false", "dates without a window": "false",
    "silent acceptance": "n > 1", "accepted without words": "n > 0 AND words = ''", "accepted without confidence": "n > 1", "accepted without a model": "n > 0 AND carried", "unmatched place": "n > 0 AND carried AND place IS NOT NULL", "review without reason": "false",
}


@query("SELECT unnest([" + ", ".join(f"{{'rule': '{rule}', 'rows': count_if({held})}}" for rule, held in READ_RULES.items()) + "], recursive := true) FROM shown", POOL_SQL, ASKED_SQL,
       """shown AS (SELECT d.*, count(w.value) AS n, min(w.value) FILTER (facet = 'place') AS place, coalesce(string_agg(w.value, '|') FILTER (facet <> 'type'), '') AS words FROM dated d LEFT JOIN wanted w USING (question_id) GROUP BY ALL)""")
def interpretation_contract(spark, d):
    """What was read out of each question, held as an interpretation: sure of one value, doubtful of several, silent on what a carried question didn't name itself."""
    c = F.col
    _, _, asked, read = _read(spark, d)
    rows = read.join(asked.select("question_id", "carried"), "question_id").withColumn("n", F.size("wanted"))
    of = lambda keep: F.transform(F.filter("wanted", keep), lambda v: v["value"])
    places, none = of(lambda v: v["facet"] == "place"), F.array().cast("array<string>")
    out = rows.select(
        (F.datediff("until", "since") + 1).alias("days_back"), c("carried").alias("compare"), F.when(c("n") > 2, F.try_element_at(places, F.lit(1))).alias("place_filter"), "since", "until", F.when(c("n") > 0, "accepted").otherwise("review_required").alias("review"),
        F.when((c("n") == 0) & ~c("carried"), F.array(F.lit("names nothing"))).when(c("n") > 1, F.array(F.lit("names several"))).otherwise(none).alias("findings"), F.array_join(of(lambda v: v["facet"] != "type"), "|").alias("understood"),
        F.when(c("n") == 1, 0.9).otherwise(0.7).alias("confidence"), F.when(c("carried"), "rule").otherwise("llm").alias("method"), F.transform(places, F.upper).alias("places_asked"), F.when(c("carried"), none).otherwise(places).alias("places_matched"),
    )
    return checks.violations(out, contracts.interpretation_rules())


@query("""SELECT question_id, carried, coalesce((SELECT string_agg(facet || '=' || value, '|' ORDER BY facet, value) FROM wanted w WHERE w.question_id = dated.question_id), '') AS wanted, since, until FROM dated""", POOL_SQL, ASKED_SQL)
def questions_read(spark, d):
    _, _, asked, read = _read(spark, d)
    said = F.array_join(F.transform("wanted", lambda v: F.concat(v["facet"], F.lit("="), v["value"])), "|")
    return read.join(asked.select("question_id", "carried"), "question_id").select("question_id", "carried", said.alias("wanted"), "since", "until")


TOLD_SQL = """told AS (SELECT question_id, coalesce(events, 0)::BIGINT AS events, coalesce(previous, 0)::BIGINT AS previous, coalesce(undated, 0)::BIGINT AS undated, coalesce(outside, 0)::BIGINT AS outside, coalesce(shown, '') AS shown,
    CASE WHEN coalesce(events, 0) = 0 THEN 'refused' WHEN events >= 2 AND quoted < 2 THEN 'qualified' ELSE 'grounded' END AS state,
    CASE WHEN coalesce(events, 0) > 0 THEN NULL WHEN coalesce(outside, 0) = 0 THEN 'no record holds what is asked for' WHEN since IS NOT NULL AND undated = outside THEN 'what matches carries no date' ELSE 'nothing falls into the period' END AS missing, since, until
  FROM dated LEFT JOIN (
    SELECT question_id, count_if(place = 0) AS events, count_if(place = 1) AS previous, count_if(place = 2) AS undated, count_if(place <> 0) AS outside,
      string_agg(event_id, '|' ORDER BY rank) FILTER (place = 0 AND rank <= 8) AS shown, least(count_if(place = 0), 8) AS quoted
    FROM (SELECT *, row_number() OVER (PARTITION BY question_id, place = 0 ORDER BY day DESC NULLS LAST, event_id DESC) AS rank FROM (
      SELECT question_id, event_id, day, CASE WHEN since IS NULL OR coalesce(day BETWEEN since AND until, false) THEN 0 WHEN day IS NULL THEN 2 WHEN day < since AND since - day <= until - since + 1 THEN 1 ELSE 3 END AS place
      FROM (SELECT question_id, event_id FROM wanted JOIN held USING (facet, value) GROUP BY question_id, event_id
              HAVING count(DISTINCT facet) = (SELECT count(DISTINCT facet) FROM wanted w WHERE w.question_id = wanted.question_id)
            UNION ALL SELECT question_id, event_id FROM dated, events WHERE question_id NOT IN (SELECT question_id FROM wanted))
      JOIN events USING (event_id) JOIN dated USING (question_id)))
    GROUP BY question_id) USING (question_id))"""


def _told(spark, d):
    """Searches, newest events and cited answers of all questions at once; questions that ask the same are searched once."""
    pool, units, _, read = _read(spark, d)
    found = materialize(questions.retrieve(units, read.select("search_id", "wanted", "since", "until").distinct()))
    evidence = pool.select(F.col("incident_id").alias("event_id"), "incident_id", F.concat(F.lit("ev-"), "record_id").alias("evidence_id"), F.col("category").alias("quote"), F.lit("").alias("source_url"))
    return questions.answers(read, found, evidence)


@query("SELECT question_id, events, previous, undated, outside, shown, state, missing FROM told", POOL_SQL, ASKED_SQL, TOLD_SQL)
def questions_answered(spark, d):
    return _told(spark, d).select("question_id", "events", "previous", "undated", "outside", F.array_join("shown", "|").alias("shown"), "state", "missing")


def _digits(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')))"


#: What each answer measured, in words, and the same of the question before it.
BESIDE_SQL = f"""spoken AS (SELECT *, events || ' distinct event(s) in ' || events || ' report(s)' || CASE WHEN since IS NOT NULL THEN ' from ' || since || ' to ' || until ELSE '' END || '.' AS line, string_split(shown, '|') AS ids,
    CASE WHEN since IS NOT NULL THEN previous || ' event(s) in as many days before.' ELSE '' END || CASE WHEN undated > 0 THEN undated || ' event(s) carry no date.' ELSE '' END AS more FROM told WHERE missing IS NULL),
  beside AS (SELECT *, lag(line || more) OVER w AS other_lines, lag(ids) OVER w AS other_ids, lag(events - previous) OVER w AS other_change FROM spoken WINDOW w AS (ORDER BY question_id)),
  judged AS (SELECT *, list_filter({_digits("line || more")}, lambda x: NOT list_contains({_digits("other_lines")}, x)) AS stray, list_filter({_digits("line")}, lambda x: NOT list_contains({_digits("other_lines")}, x)) AS stray_line FROM beside WHERE other_lines IS NOT NULL)"""


def _beside(spark, d):
    """Answers next to what the question before them measured and showed."""
    said = materialize(_told(spark, d).filter("missing IS NULL"))
    order = Window.orderBy("question_id")  # a row a question of a small table
    lines = F.filter("statements", lambda t: F.contains(t, F.lit("event(s)")))
    rows = said.withColumn("lines", lines).withColumn("other_lines", F.lag("lines").over(order)).withColumn("other_ids", F.lag("shown").over(order)).withColumn("other_change", F.lag("change").over(order))
    return rows.filter("other_lines IS NOT NULL")


@query("SELECT question_id, CASE WHEN NOT list_contains(other_ids, ids[1]) THEN 'event out of scope' WHEN len(stray_line) > 0 THEN 'number not measured' END AS fault FROM judged", POOL_SQL, ASKED_SQL, TOLD_SQL, BESIDE_SQL)
def supported_statements(spark, d):
    """The first line of each answer held against what the question before it measured and showed."""
    none = F.array().cast("array<string>")
    rows = _beside(spark, d).select(
        "question_id", F.element_at("lines", 1).alias("text"), F.lit(True).alias("calculated"), F.slice("shown", 1, 1).alias("cited_events"), none.alias("cited_evidence"), F.col("other_ids").alias("scope_events"), none.alias("printed_evidence"), F.col("other_lines").alias("numbers")
    )
    return contracts.supported_statements(rows).select("question_id", "fault")


ANSWER_RULES = {
    "events are counted": "events <> len(ids)", "incidents are counted": "events <> len(ids)", "change": "events - previous <> other_change", "foreign event": "len(list_filter(other_ids, lambda x: NOT list_contains(ids, x))) > 0", "invented number": "len(stray) > 0",
    "grounded without acceptance": "state = 'grounded' AND events > 8", "grounded with findings": "false", "shown over counted": "false", "foreign evidence": "false", "foreign quotation": "len(list_filter(other_ids, lambda x: NOT list_contains(ids, x))) > 0", "repeated quotation": "false",
    "grounded without statement": "false", "grounded without confidence": "state = 'grounded' AND len(stray) > 0", "grounded with claim words": "false", "grounded on too few quotes": "false", "grounded without quotation": "false",
    "qualified without findings": "false", "qualified without statement": "false", "qualified and missing": "state = 'qualified'", "refused with statement": "false", "refused without reason": "false", "refused and accepted": "false",
}


@query("SELECT unnest([" + ", ".join(f"{{'rule': '{rule}', 'rows': count_if({held})}}" for rule, held in ANSWER_RULES.items()) + "], recursive := true) FROM judged", POOL_SQL, ASKED_SQL, TOLD_SQL, BESIDE_SQL)
def answer_contract(spark, d):
    """Answers told with the numbers, the change and the events of the question before them, and with counts of what is shown: the rules find where that doesn't fit."""
    c = F.col
    stray = F.size(F.array_except(F.flatten(F.transform("lines", digit_set)), F.flatten(F.transform("other_lines", digit_set)))) > 0
    rows = _beside(spark, d).select(
        "events", c("shown").alias("event_ids"), "incidents", F.col("shown").alias("incident_ids"), F.size("shown").alias("shown_events"), F.size(F.array_distinct(F.transform("citations", lambda q: q["event_id"]))).alias("quoted_events"), "state",
        F.when(c("events") > 8, "review_required").otherwise("accepted").alias("review"), "findings", c("lines").alias("statements"), F.when(c("state") == "qualified", "why").alias("missing"), F.lit("read").alias("explanation"), F.when(stray, 0.5).otherwise(0.9).alias("confidence"),
        c("other_ids").alias("cited_events"), F.array().cast("array<string>").alias("cited_evidence"), F.transform("citations", lambda q: q["evidence_id"]).alias("quotation_evidence"),
        c("other_ids").alias("quotation_incidents"), c("other_lines").alias("numbers"), "previous", c("other_change").alias("change"),
    )
    return checks.violations(rows, contracts.answer_rules())


@query(r"""SELECT o_orderkey, since::DATE AS since, until::DATE AS until FROM (SELECT o_orderkey, o_orderdate::DATE AS today, o_orderkey % 12 AS k, o_custkey % 40 + 1 AS n FROM orders), LATERAL (SELECT
    CASE k WHEN 0 THEN today - (n - 1)::INTEGER WHEN 1 THEN today - n::INTEGER WHEN 2 THEN today - (n - 1)::INTEGER WHEN 3 THEN try_cast(year(today) || '-' || lpad(month(today)::VARCHAR, 2, '0') || '-' || lpad(n::VARCHAR, 2, '0') AS DATE)
      WHEN 4 THEN try_cast(year(today) || '-' || lpad(month(today)::VARCHAR, 2, '0') || '-' || lpad(n::VARCHAR, 2, '0') AS DATE) WHEN 5 THEN try_cast(year(today) || '-' || lpad(month(today)::VARCHAR, 2, '0') || '-' || lpad(n::VARCHAR, 2, '0') AS DATE)
      WHEN 6 THEN try_cast('1995-' || lpad(month(today)::VARCHAR, 2, '0') || '-' || lpad(n::VARCHAR, 2, '0') AS DATE) WHEN 7 THEN today - 1 WHEN 8 THEN date_trunc('week', today)::DATE - 7 WHEN 9 THEN date_trunc('month', today)::DATE WHEN 10 THEN date_trunc('month', today)::DATE - INTERVAL 1 MONTH END AS since,
    CASE k WHEN 0 THEN today WHEN 1 THEN today - n::INTEGER WHEN 2 THEN today WHEN 8 THEN date_trunc('week', today)::DATE - 1 WHEN 9 THEN last_day(today) WHEN 10 THEN date_trunc('month', today)::DATE - 1 ELSE since END AS until)""")
def question_days(spark, d):
    """The days that questions of twelve forms name, with numbers of the rows; some dates don't exist."""
    key, n, day = F.col("o_orderkey") % 12, (F.col("o_custkey") % 40 + 1).cast("string"), F.to_date("o_orderdate")
    forms = [
        F.concat(F.lit("What of the last "), n, F.lit(" days?")), F.concat(n, F.lit(" days ago")), F.concat(F.lit("in RECENT  "), n, F.lit(" day")), F.concat(F.date_format(day, "yyyy-M-"), n), F.concat(n, F.date_format(day, "/M/yyyy"), F.lit("?")),
        F.concat(F.lit("on "), n, F.date_format(day, " MMM")), F.concat(n, F.date_format(day, "-MMMM"), F.lit(", 1995")), F.lit("and yesterday?"), F.lit("previous week"), F.lit("this month"), F.lit("last month please"), F.lit("ever"),
    ]
    text = F.element_at(F.array(*forms), (key + 1).cast("int"))
    rows = views.table(spark, d, "orders").select("o_orderkey", answers.question_window(text, day).alias("w"))
    return rows.select("o_orderkey", "w.since", "w.until")
