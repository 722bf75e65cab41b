"""Scans of captured pages and payloads: links, articles, tables and price maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze


def strip_tags(html: Column) -> Column:
    return squeeze(F.regexp_replace(html, "<[^>]*>", " "))


def links(pages: DataFrame, *, base: str, containing: str = "/") -> DataFrame:
    """``page_id, position, url``: distinct link targets of a page in order; relative ones are completed with ``base``."""
    hrefs = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'))
    full = F.transform(hrefs, lambda u: F.when(u.startswith("/"), F.concat(F.lit(base.rstrip("/")), u)).otherwise(u))
    kept = F.array_distinct(F.filter(full, lambda u: u.contains(containing)))
    return pages.select("page_id", F.posexplode(kept).alias("position", "url"))


def articles(pages: DataFrame) -> DataFrame:
    """``page_id, title, content``: first heading, and all non-empty paragraphs joined by blanks."""
    title = strip_tags(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    paragraphs = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>")), strip_tags)
    return pages.select("page_id", title.alias("title"), F.array_join(F.filter(paragraphs, lambda p: p != ""), " ").alias("content"))


def table_rows(pages: DataFrame, *, cells: int = 7, header: str = "Date") -> DataFrame:
    """``page_id, row, cells``: table rows with enough cells whose first cell has a dash; the header row is skipped."""
    rows = F.regexp_extract_all("html", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"))
    split = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>")), strip_tags)
    each = pages.select("page_id", F.posexplode(F.transform(rows, split)).alias("row", "cells"))
    return each.filter((F.size("cells") >= cells) & (F.col("cells")[0] != header) & F.col("cells")[0].contains("-"))


def forecast_rows(pages: DataFrame, *, heading: str, cells: int = 7) -> DataFrame:
    """``page_id, row, day, values`` of the first table below a heading: the day's cell, the others as numbers or null."""
    below = F.regexp_extract("html", rf"(?s)\Q{heading}\E.*?<table[^>]*>(.*?)</table>", 1)
    rows = table_rows(pages.select("page_id", below.alias("html")), cells=cells)
    numbers = F.transform(F.slice("cells", F.lit(2), F.size("cells") - 1), lambda c: c.try_cast("double"))
    return rows.select("page_id", "row", F.col("cells")[0].alias("day"), numbers.alias("values"))


def added_line(pages: DataFrame) -> DataFrame:
    """``page_id, added``: the first text of a page that says when it was added."""
    return pages.select("page_id", F.nullif(F.regexp_extract(strip_tags(F.col("html")), r"(ADDED\s*:[^<]{5,40}?(?:AM|PM|am|pm))", 1), F.lit("")).alias("added"))


def json_measures(rows: DataFrame, column: str) -> DataFrame:
    """A JSON object of numbers as rows ``record_id, name, measure``; values that are no numbers are null."""
    pairs = F.from_json(column, "map<string,string>")
    return rows.select("record_id", F.explode(pairs).alias("name", "raw")).select("record_id", "name", F.col("raw").try_cast("double").alias("measure"))


def price_rows(payloads: DataFrame) -> DataFrame:
    """``market, commodity, quantity, min_price, max_price`` from ``market, payload``; zero and empty mean unknown."""
    each = payloads.select("market", F.explode(F.from_json("payload", "map<string,struct<quantity:string,min_price:string,max_price:string>>")).alias("commodity", "v"))
    number = lambda c: F.when(F.col(c).try_cast("double") != 0, F.col(c).try_cast("double"))
    return each.select("market", "commodity", *[number(f"v.{c}").alias(c) for c in ("quantity", "min_price", "max_price")])


def ocr_lines(jobs: DataFrame) -> DataFrame:
    """``job_id, lines, pages, text`` from ``job_id, page_number, blocks`` (array of ``type, text``): lines in their order."""
    each = jobs.select("job_id", "page_number", F.posexplode("blocks").alias("position", "b")).select("job_id", "page_number", "position", "b.type", "b.text")
    line = (F.col("type") == "LINE") & (F.coalesce("text", F.lit("")) != "")
    ordered = F.array_sort(F.collect_list(F.when(line, F.struct("page_number", "position", "text"))))
    return each.groupBy("job_id").agg(F.count_if(line).alias("lines"), F.count_if(F.col("type") == "PAGE").alias("pages"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
