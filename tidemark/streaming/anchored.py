"""Windows counted back from the newest day, on a stream.

Windows anchored at the newest day move whenever that day does, so no window of the stream's own is theirs. A stream keeps sums of days
instead (they never move, and late rows find their day), and windows are cut from the kept days when they are asked for: two levels of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.trends import Trend, in_windows, windows
from .commits import Store

DAYS = "day date, {key} string, records bigint, total double"


def day_sums(rows: DataFrame, *, key: str = "record_type", watermark: str | None = None) -> DataFrame:
    """``day, key, records, total`` of rows (``event_time, key, value``), a table or a stream. With a ``watermark`` days before it are let go, and rows that late are lost."""
    dated = rows.filter("event_time IS NOT NULL")
    if watermark and rows.isStreaming:
        dated = dated.withWatermark("event_time", watermark)
        day = F.window("event_time", "1 day")
        sums = dated.groupBy(day.alias("w"), key).agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("total"))
        return sums.select(F.to_date("w.start").alias("day"), key, "records", "total")
    return dated.groupBy(F.to_date("event_time").alias("day"), key).agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("total"))


def keep_days(stream: DataFrame, store: Store, *, checkpoint: str, key: str = "record_type", watermark: str | None = None, name: str = "days"):
    """A stream writer that keeps the newest sums of every day in the table ``name`` of ``store``; a batch that runs again changes nothing."""
    schema = DAYS.format(key=key)

    def flush(changed: DataFrame, batch: int) -> None:
        if not store.committed(name, batch):
            held = store.table(name, schema)
            rest = held.join(changed.select("day", key), ["day", key], "left_anti")
            store.commit({name: rest.unionByName(changed.select("day", key, "records", "total"))}, writer=name, batch=batch)

    return day_sums(stream, key=key, watermark=watermark).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(flush)


def anchored(days: DataFrame, t: Trend, *, key: str = "record_type") -> DataFrame:
    """``k, since, until, key, records, total`` of the windows that :func:`tidemark.operators.trends.windows` cuts, from sums of days."""
    spans = windows(days, "day", t)
    return in_windows(days, "day", spans).groupBy("k", "since", "until", key).agg(F.sum("records").alias("records"), F.sum("total").alias("total"))
