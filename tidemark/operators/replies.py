"""What answers and chat replies may say: value lines, wording checks, refusals, citations, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold, squeeze
from ..functions.wording import digit_set, plain_number

#: Fixed limits of replies.
FACTS_A_SENTENCE, GENERAL_LINES, NAMES, EVENT_EVIDENCE = 3, 24, 12, 12


def price_line(facts: Column, title: Column, day: Column) -> Column:
    """One line of a market record: what, where, when, price range and quantity. ``facts`` maps names to accepted values."""
    text = lambda k: F.coalesce(F.trim(F.try_element_at(facts, F.lit(k))), F.lit(""))
    number = lambda k: F.coalesce(plain_number(F.try_element_at(facts, F.lit(k)).try_cast("double")), F.lit(""))
    subject = F.array_join(F.filter(F.array(text("commodity"), text("market")), lambda x: x != ""), " at ")
    low, high, unit = number("min_price"), number("max_price"), text("unit")
    per = F.concat(F.lit(" per "), F.when(unit != "", unit).otherwise("unit"))
    money = F.when((low != "") & (high != ""), F.concat(F.lit("₹"), low, F.lit("–₹"), high, per)).when((low != "") | (high != ""), F.concat(F.lit("₹"), low, high, per))
    money = F.coalesce(money.when(unit != "", F.concat(F.lit("priced per "), unit)), F.lit(""))
    quantity = F.when(number("quantity") != "", F.concat(F.lit(", "), F.rtrim(F.concat(number("quantity"), F.lit(" "), unit)), F.lit(" reported"))).otherwise("")
    line = F.concat(F.when(subject != "", subject).otherwise(title), F.lit(" ("), day, F.lit("): "), money, quantity)
    return F.trim(F.replace(line, F.lit(": ,"), F.lit(":")))


def forecast_line(facts: Column, place: Column, day: Column) -> Column:
    """One line of a forecast record: where, when, the forecast and warning as sentences, the temperatures."""
    text = lambda k: F.coalesce(F.trim(F.try_element_at(facts, F.lit(k))), F.lit(""))
    sentence = lambda k: F.when(text(k) != "", F.concat(F.regexp_replace(text(k), r"\.+$", ""), F.lit(".")))
    degrees = lambda label, k: F.concat(F.lit(f"{label} "), plain_number(F.try_element_at(facts, F.lit(k)).try_cast("double")), F.lit("°C"))
    temps = F.array_join(F.array_compact(F.array(degrees("Max", "max_temp_c"), degrees("min", "min_temp_c"))), ", ")
    parts = F.array_compact(F.array(sentence("forecast"), sentence("warning"), F.when(temps != "", F.concat(temps, F.lit(".")))))
    return F.concat(place, F.lit(" ("), day, F.lit("): "), F.array_join(parts, " "))


def wording_faults(lines: DataFrame) -> DataFrame:
    """``reply_id, line, fault``: the first fault of each sentence of a reply.

    ``lines``: ``reply_id, line, text, cited`` (numbers of printed facts, from 1) and ``facts`` (the printed texts). A
    sentence may not repeat an earlier one, must cite facts that were printed (three at most), and may hold no number that
    its facts don't print.
    """
    same = Window.partitionBy("reply_id", fold(F.col("text"))).orderBy("line")
    strange = F.exists("cited", lambda i: (i < 1) | (i > F.size("facts")))
    source = F.array_join(F.transform(F.filter(F.array_distinct("cited"), lambda i: (i >= 1) & (i <= F.size("facts"))), lambda i: F.element_at("facts", i)), " ")
    invented = F.size(F.array_except(digit_set(F.col("text")), digit_set(source))) > 0
    fault = F.when(F.row_number().over(same) > 1, "repeated").when(strange, "fact not printed").when(F.size("cited") == 0, "no fact").when(invented, "invented number")
    fault = fault.when(F.size(F.array_distinct("cited")) > FACTS_A_SENTENCE, "too many facts")
    return lines.select("reply_id", "line", fault.alias("fault")).filter("fault IS NOT NULL")


def unwritten_facts(lines: DataFrame) -> DataFrame:
    """``reply_id, fact``: the first printed fact of each reply that no sentence cites."""
    used = lines.select("reply_id", F.explode("cited").alias("fact"))
    printed = lines.groupBy("reply_id").agg(F.max(F.size("facts")).alias("n")).filter("n > 0").select("reply_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("fact"))
    left = printed.join(used, ["reply_id", "fact"], "left_anti")
    return left.groupBy("reply_id").agg(F.min("fact").alias("fact"))


def general_refusal(lines: Column, *, answerable: Column, value_shaped: Column, district_claims: Column, places: Column) -> Column:
    """Why an answer from background can't be shown, by the first reason that holds; null where it can."""
    kept = F.filter(F.transform(lines, squeeze), lambda x: F.coalesce(x, F.lit("")) != "")
    text = F.array_join(kept, " ")
    emoji = text.rlike("[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE0F}]")
    held = F.exists(places, lambda p: (p != "") & F.contains(fold(text), p))
    return (
        F.when(~F.coalesce(answerable, F.lit(False)), "answered from records").when(F.size(kept) == 0, "nothing written").when(F.size(kept) > GENERAL_LINES, "too long").when(emoji, "emoji").when(held, "names a held place")
        .when(value_shaped & (F.size(digit_set(text)) > 0), "number for a value question").when(F.coalesce(district_claims, F.lit(False)), "claims about the district")
    )


def limited_evidence(rows: DataFrame, *, most: int = EVENT_EVIDENCE) -> DataFrame:
    """Quotes shown for events: each piece of evidence once, at its first event, then ``most`` an event.

    ``rows``: ``event_rank, event_id, incident_id, position, evidence_id``, in that order.
    """
    order = ["event_rank", "incident_id", "position"]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("evidence_id").orderBy(*order))).filter("_n = 1")
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy(*order[1:]))
    return first.withColumn("_n", nth).filter(F.col("_n") <= most).drop("_n")


def first_holder(rows: DataFrame) -> DataFrame:
    """``evidence_id, event_id, incident_id``: who holds a piece of evidence first, by event then incident."""
    return rows.groupBy("evidence_id").agg(F.min(F.struct("event_id", "incident_id")).alias("h")).select("evidence_id", "h.event_id", "h.incident_id")


def window_note(basis: Column, days: Column, until: Column, anchor: Column) -> Column:
    """How a period was counted, in words."""
    counted = F.concat(days.cast("string"), F.lit(" day(s) counted back from "), until.cast("string"))
    return (
        F.when(basis == "record", F.concat(counted, F.lit(", the newest dated record here (its date read from "), anchor, F.lit(")")))
        .when(basis == "given", F.concat(counted, F.lit(", where the run was told the period ends")))
        .when(basis == "named", "the period starts where the run named it").otherwise("no record here carried a date, so no window could be counted")
    )


def record_place(places: Column, names: Column, title: Column) -> Column:
    """The first place text of a record, else its shortest name (then by alphabet), else its title."""
    texts = F.filter(F.transform(places, lambda p: F.trim(p["text"])), lambda t: F.coalesce(t, F.lit("")) != "")
    short = F.array_sort(F.transform(names, lambda n: F.struct(F.length(n).alias("size"), n.alias("name"))))
    return F.coalesce(F.try_element_at(texts, F.lit(1)), F.try_element_at(short, F.lit(1))["name"], title)


def held_names(facts: DataFrame, *, most: int = NAMES) -> DataFrame:
    """``label``: the first distinct "field value" of the records in order, ids left out. ``facts``: position, field, value."""
    name = F.regexp_replace("field", "^data\\.", "")
    rows = facts.filter(~F.col("field").endswith("_id")).groupBy(F.concat_ws(" ", name, "value").alias("label")).agg(F.min("position").alias("position"))
    return rows.orderBy("position").limit(most).select("label")


def distinct_questions(asked: DataFrame) -> DataFrame:
    """Each question once, by its folded wording, in the order of the first ask."""
    rows = asked.groupBy(fold(F.col("question")).alias("_q")).agg(F.min(F.struct("position", "question")).alias("f"))
    answer = F.concat(F.lit("ANS-"), F.substring(F.sha2("_q", 256), 1, 16))
    return rows.select("f.position", "f.question", answer.alias("answer_id"))


def picked(named: Column, shown: Column) -> Column:
    """``struct(kept, strange)``: what was named and shown, and what was named though not shown."""
    return F.struct(F.array_intersect(named, shown).alias("kept"), F.array_except(named, shown).alias("strange"))


def capped(items: Column, most: int = 8) -> Column:
    """``struct(items, cut)``: the first ``most``, and whether some were left out."""
    return F.struct(F.slice(items, 1, most).alias("items"), (F.size(items) > most).alias("cut"))


def prompt_key(system: Column, user: Column) -> Column:
    return F.sha2(F.concat(system, F.lit("\n"), user), 256)


def reply_rules() -> dict[str, Column]:
    """What a chat reply must hold: name to "is violated". Columns ``path, refused, citations, model_calls, text``."""
    c = F.col
    return {
        "no text": F.coalesce(F.trim("text"), F.lit("")) == "", "general with citations": (c("path") == "general") & (c("citations") > 0),
        "values without citations": (c("path") == "record_values") & ~c("refused") & (c("citations") == 0), "general without a model": (c("path") == "general") & ~c("refused") & (c("model_calls") == 0),
        "too many calls": c("model_calls") > 5, "refused with citations": c("refused") & (c("citations") > 0),
    }
