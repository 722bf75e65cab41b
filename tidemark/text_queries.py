"""Queries over the wording functions, each on a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import wording as W
from .functions.text import fold, script
from .registering import query
from .sources import views
from .vocabularies import CATEGORIES, EVENT_TYPES, FORECAST_WORDS, MARKET_WORDS

def n_rows():
    return F.count(F.lit(1)).alias("n")
TAMIL = "௦௧௨௩௪௫௬௭௮௯"


@query("SELECT doc_id, sha256(trim(regexp_replace(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS norm FROM documents WHERE lang = 'de'")
def norm_texts(spark, d):
    rows = views.table(spark, d, "documents").filter("lang = 'de'")
    return rows.select("doc_id", F.sha2(W.norm(F.coalesce("text", F.lit(""))), 256).alias("norm"))


@query("SELECT item_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS folded FROM benchmark")
def fold_texts(spark, d):
    return views.table(spark, d, "benchmark").select("item_id", fold(F.col("text")).alias("folded"))


@query(f"""SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(shown, '[0-9{TAMIL}]+'),
  lambda x: coalesce(nullif(ltrim(translate(x, '{TAMIL}', '0123456789'), '0'), ''), '0')))), '|') AS runs
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN translate(t, '0123456789', '{TAMIL}') ELSE t END AS shown
    FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' no ' || o_orderkey::VARCHAR AS t FROM orders))""")
def unicode_digit_runs(spark, d):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" no "), F.col("o_orderkey").cast("string"))
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.translate(text, "0123456789", TAMIL)).otherwise(text)
    return views.table(spark, d, "orders").select("o_orderkey", F.array_join(W.digit_set(shown), "|").alias("runs"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS stray FROM orders WHERE o_custkey > 2100 OR o_custkey BETWEEN 32 AND 1994")
def stray_digit_runs(spark, d):
    """Numbers of a line that the measured lines don't hold; the digits of an identifier measure nothing."""
    rows = views.table(spark, d, "orders").filter("o_custkey > 2100 OR o_custkey BETWEEN 32 AND 1994")
    line = F.concat_ws(" ", F.lit("7 cases, customer"), "o_custkey")
    measured = F.concat(F.lit("7 cases of EVT-"), F.col("o_custkey").cast("string"), F.lit(" in 2001"))
    stray = F.array_join(W.stray_digits(line, measured), "|")
    return rows.select("o_orderkey", stray.alias("stray"))


SPOKEN_SQL = """said AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'நகரம் ' || o_orderpriority WHEN 1 THEN 'நகரம்' WHEN 2 THEN o_orderpriority ELSE '12' END AS text,
  CASE o_orderkey % 3 WHEN 0 THEN 'ta' ELSE 'en' END AS wanted FROM orders)"""


def _spoken(spark, d):
    which = F.col("o_orderkey") % 4
    text = F.when(which == 0, F.concat(F.lit("நகரம் "), "o_orderpriority")).when(which == 1, "நகரம்").when(which == 2, F.col("o_orderpriority")).otherwise("12")
    return views.table(spark, d, "orders").select("o_orderkey", text.alias("text"), F.when(F.col("o_orderkey") % 3 == 0, "ta").otherwise("en").alias("wanted"))


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'mixed' WHEN 1 THEN 'tamil' WHEN 2 THEN 'latin' ELSE 'other' END AS script, count(*) AS n FROM said GROUP BY ALL", SPOKEN_SQL)
def script_kinds(spark, d):
    return _spoken(spark, d).groupBy(script(F.col("text")).alias("script")).agg(n_rows())


@query("SELECT o_orderkey FROM said WHERE (wanted = 'ta' AND o_orderkey % 4 = 2) OR (wanted = 'en' AND o_orderkey % 4 = 1)", SPOKEN_SQL)
def script_mismatches(spark, d):
    return _spoken(spark, d).filter(W.script_mismatch(F.col("text"), F.col("wanted"))).select("o_orderkey")


ASKED_SQL = """asked AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || CASE conv_id % 5 WHEN 0 THEN ' the moderate window' WHEN 1 THEN ' what rate per kg?'
  WHEN 2 THEN ' rain and wind, prices?' WHEN 3 THEN ' மழை' ELSE ' weather' END AS q FROM conversations)"""


def _asked(spark, d):
    which = F.col("conv_id") % 5
    end = F.when(which == 0, " the moderate window").when(which == 1, " what rate per kg?").when(which == 2, " rain and wind, prices?").when(which == 3, " மழை").otherwise(" weather")
    rows = views.table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.concat(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), end).alias("q"))


def _hits(words: list[str]) -> str:
    """SQL: the words of the list that ``q`` says."""
    plain = [w for w in words if w.isascii() and " " not in w]
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    other = [w for w in words if w not in plain]
    return f"list_sort(list_distinct(list_filter({listed(plain)}, lambda w: list_contains(regexp_split_to_array(q, '[^0-9a-z]+'), w)) || list_filter({listed(other)}, lambda w: contains(q, w))))"


@query(f"SELECT conv_id, turn, array_to_string({_hits(MARKET_WORDS)}, '|') AS market, array_to_string({_hits(FORECAST_WORDS)}, '|') AS forecast FROM asked", ASKED_SQL)
def said_words(spark, d):
    said = lambda words: F.array_join(W.said_in(F.col("q"), words), "|")
    return _asked(spark, d).select("conv_id", "turn", said(MARKET_WORDS).alias("market"), said(FORECAST_WORDS).alias("forecast"))


@query(f"SELECT topic, count(*) AS n FROM (SELECT CASE WHEN len({_hits(MARKET_WORDS)}) > 0 THEN 'market' WHEN len({_hits(FORECAST_WORDS)}) > 0 THEN 'forecast' ELSE 'records' END AS topic FROM asked) GROUP BY topic", ASKED_SQL)
def question_topics(spark, d):
    return _asked(spark, d).groupBy(W.topic(F.col("q")).alias("topic")).agg(n_rows())


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_filter(names, lambda x: contains(q, x))), '|') AS places
  FROM (SELECT conv_id, turn, q || ' in nation_' || (conv_id % 25)::VARCHAR AS q FROM asked), (SELECT list(lower(n_name)) AS names FROM nation)""", ASKED_SQL)
def named_places(spark, d):
    names = views.table(spark, d, "nation").agg(F.collect_set(F.lower("n_name")).alias("names"))  # one row: the place vocabulary
    rows = _asked(spark, d).withColumn("q", F.concat("q", F.lit(" in nation_"), (F.col("conv_id") % 25).cast("string")))
    return rows.crossJoin(F.broadcast(names)).select("conv_id", "turn", F.array_join(W.named_in(F.col("q"), F.col("names")), "|").alias("places"))


DONE_SQL = "done AS (SELECT o_orderkey, o_orderpriority || CASE o_orderkey % 4 WHEN 0 THEN ' Was Done and carried out' WHEN 1 THEN ' proof: caused by rain' WHEN 2 THEN ' is confirmed' ELSE ' repairs are planned' END AS t FROM orders)"


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'proof|caused by' WHEN 2 THEN 'confirmed' ELSE '' END AS claims, CASE WHEN o_orderkey % 4 = 0 THEN 'was done|carried out' ELSE '' END AS past FROM done""", DONE_SQL)
def claim_and_past_words(spark, d):
    which = F.col("o_orderkey") % 4
    text = F.concat("o_orderpriority", F.when(which == 0, " Was Done and carried out").when(which == 1, " proof: caused by rain").when(which == 2, " is confirmed").otherwise(" repairs are planned"))
    rows = views.table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", F.array_join(W.claim_words(F.col("t")), "|").alias("claims"), F.array_join(W.past_words(F.col("t")), "|").alias("past"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'flood' WHEN 1 THEN 'tree_fall' WHEN 2 THEN 'heat_wave' END AS event_type, CASE WHEN o_orderkey % 5 = 3 THEN 'invalid_value' END AS fault FROM orders""")
def enum_tokens(spark, d):
    which = F.col("o_orderkey") % 5
    raw = F.when(which == 0, " Flood ").when(which == 1, "TREE-FALL").when(which == 2, "heat wave").when(which == 3, "earthquake")
    return views.table(spark, d, "orders").select("o_orderkey", W.token(raw, EVENT_TYPES).alias("t")).select("o_orderkey", F.col("t.value").alias("event_type"), "t.fault")


STAMP_SQL = """stamps AS (SELECT o_orderkey, o_orderdate AS stamp, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT02:30:00') || '+05:30'
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 4 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS text FROM orders)"""


def _stamps(spark, d):
    which, at = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = F.when(which == 0, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(which == 1, F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T02:30:00+05:30")))
    text = text.when(which == 2, F.date_format(at, "yyyy-MM-dd")).when(which == 3, F.date_format(at, "dd/MM/yyyy")).when(which == 4, "").otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    return views.table(spark, d, "orders").select("o_orderkey", at.alias("stamp"), text.alias("text"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN date_trunc('day', stamp) - INTERVAL 3 HOUR WHEN 2 THEN date_trunc('day', stamp) WHEN 0 THEN stamp WHEN 5 THEN stamp END AS stamp,
  o_orderkey % 6 IN (0, 1) AS zoned, CASE WHEN o_orderkey % 6 = 3 THEN 'invalid_value' END AS fault FROM stamps""", STAMP_SQL)
def iso_stamps(spark, d):
    rows = _stamps(spark, d).select("o_orderkey", W.iso_stamp(F.col("text")).alias("s"))
    return rows.select("o_orderkey", F.col("s.at").cast("timestamp_ntz").alias("stamp"), "s.zoned", "s.fault")


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN stamp::DATE WHEN 1 THEN (stamp::DATE - 1)::DATE END AS day FROM stamps", STAMP_SQL)
def arrival_days(spark, d):
    return _stamps(spark, d).select("o_orderkey", W.arrival_day(F.col("text")).alias("day"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN o_orderdate - INTERVAL 2 DAY END, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END, o_orderdate) AS reported FROM orders""")
def reported_times(spark, d):
    at, state = F.col("o_orderdate"), F.col("o_orderstatus")
    reported = W.reported_at(F.when(state == "O", at - F.expr("INTERVAL 2 DAYS")), F.when(state == "F", at + F.expr("INTERVAL 1 DAY")), at)
    return views.table(spark, d, "orders").select("o_orderkey", reported.alias("reported"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN date_trunc('day', o_orderdate) + to_hours((o_orderkey % 24)::INTEGER) + INTERVAL 5 MINUTE END AS stamp FROM orders""")
def tamil_stamps(spark, d):
    months = F.array(*map(F.lit, ["ஜன", "பிப்", "மார்", "ஏப்", "மே", "ஜூன்", "ஜூலை", "ஆக", "செப்", "அக்", "நவ", "டிச"]))
    hour = F.col("o_orderkey") % 24
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    month = F.when(F.col("o_orderkey") % 5 < 4, F.element_at(months, F.month("o_orderdate"))).otherwise("Jan")
    text = F.concat(F.lit("<p>ADDED : "), month, F.date_format("o_orderdate", " d, yyyy "), shown.cast("string"), F.lit(":05 "), F.when(hour >= 12, "pm").otherwise("AM"), F.lit("</p>"))
    return views.table(spark, d, "orders").select("o_orderkey", W.tamil_stamp(text).cast("timestamp_ntz").alias("stamp"))


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN (p_retailprice::BIGINT)::VARCHAR ELSE rtrim(rtrim(printf('%.5f', p_retailprice), '0'), '.') END AS shown FROM part")
def number_format(spark, d):
    return views.table(spark, d, "part").select("p_partkey", W.plain_number(F.col("p_retailprice")).alias("shown"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Thiruparankundram' WHEN 1 THEN 'Vadipatti' ELSE n_name END AS taluk FROM nation")
def taluk_spellings(spark, d):
    which = F.col("n_nationkey") % 3
    raw = F.when(which == 0, " ThirupParankundram").when(which == 1, "VADIPPATTI ").otherwise(F.col("n_name"))
    return views.table(spark, d, "nation").select("n_nationkey", W.taluk_name(raw).alias("taluk"))


@query("SELECT page_id, CASE WHEN page_id % 4 > 0 THEN url END AS url, 'page-' || page_id::VARCHAR || '.pdf' AS name FROM pages")
def safe_urls_and_names(spark, d):
    odd = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    name = F.concat(F.lit("C:\\up/../page-"), F.col("page_id").cast("string"), F.lit("\x00.pdf"))
    return views.table(spark, d, "pages").select("page_id", W.safe_url(odd).alias("url"), W.safe_name(name).alias("name"))


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%-d %b %Y, %H:%M') AS shown FROM events")
def display_times(spark, d):
    return views.table(spark, d, "events").select("event_id", W.display_time(F.col("ts").cast("timestamp")).alias("shown"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k') END AS k FROM events")
def json_answers(spark, d):
    which = F.col("event_id") % 3
    text = F.when(which == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(which == 1, F.col("props")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    return views.table(spark, d, "events").select("event_id", F.try_element_at(W.json_object(text), F.lit("k")).alias("k"))


@query("SELECT o_orderkey, o_orderkey % 4 < 3 AS held FROM orders")
def values_in_fields(spark, d):
    which, price = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("decimal(12,2)")
    value = F.when(which == 0, F.format_number(price, 2)).when(which == 1, price.cast("string")).when(which == 2, "ORDER  of").otherwise("none")
    field = F.when(which == 2, "An order OF goods").otherwise(price.cast("string"))
    return views.table(spark, d, "orders").select("o_orderkey", W.value_in_field(value, field).alias("held"))


@query("SELECT o_orderkey, o_orderkey % 3 < 2 AS same FROM orders")
def publication_stamps(spark, d):
    """Stamps without an offset agree by day, others only by instant."""
    which, at = F.col("o_orderkey") % 3, F.col("o_orderdate").cast("timestamp")
    other = F.when(which == 0, at).otherwise(at + F.expr("INTERVAL 5 HOURS"))
    same = W.same_stamp(other, which == 2, at, F.lit(False))
    return views.table(spark, d, "orders").select("o_orderkey", same.alias("same"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, count_if(c_custkey % 7 = 0) AS odd FROM customer GROUP BY ALL")
def category_tokens(spark, d):
    """A vocabulary check over a column: values outside of it are faults, by segment."""
    raw = F.when(F.col("c_custkey") % 7 == 0, F.col("c_mktsegment")).otherwise("Law and-order")
    rows = views.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), W.token(raw, CATEGORIES).alias("t"))
    return rows.groupBy("segment").agg(n_rows(), F.count_if(F.col("t.fault").isNotNull()).alias("odd"))
