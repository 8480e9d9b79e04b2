"""Sliding and session windows over events, of a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonlake.operators.scan import RANGE, own, prefix, segmented


def _late(events: DataFrame, time: str, watermark: str | None) -> DataFrame:
    return events.withWatermark(time, watermark) if watermark else events


def _measures(value: str) -> list:
    return [F.count("*").alias("n"), F.sum(value).alias("total")]


def sliding(events: DataFrame, by: list[str], size: str, slide: str, time: str = "ts", value: str = "value", watermark: str | None = None) -> DataFrame:
    """(by.., start, end, n, total) of each window of a size that begins every `slide`; a row is in size / slide of them. Counts and sums are combined before the shuffle.

    A stream needs a watermark, after which a window is given out.
    """
    found = _late(events, time, watermark).groupBy(*by, F.window(time, size, slide).alias("w")).agg(*_measures(value))
    return found.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def session_stream(events: DataFrame, by: list[str], gap: str, watermark: str, time: str = "ts", value: str = "value") -> DataFrame:
    """(by.., start, end, n, total) of the sessions of a stream: rows at most `gap` after one another; the end is the last row's time plus the gap."""
    found = _late(events, time, watermark).groupBy(*by, F.session_window(time, gap).alias("w")).agg(*_measures(value))
    return found.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, by: list[str], gap: str, time: str = "ts", value: str = "value") -> DataFrame:
    """The same of a table, rows without a time left out. A session begins where the row before is more than `gap` away; its number is a running sum of beginnings.

    Both look over ranges of a series, so a series with most of the rows is many tasks, and sessions are combined before the shuffle.
    """
    rows = segmented(events.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("__t"), F.col(value).alias("__v")), by, ["__t"], before=1)
    last = F.lag("__t").over(Window.partitionBy(RANGE, *by).orderBy("__t"))
    begins = F.when(last.isNull() | (F.col("__t") > last + F.expr(f"interval {gap}")), 1).otherwise(0).cast("long")
    # rows of one time are one row: between them no session begins, whichever is first
    times = own(rows.withColumn("__begins", begins)).groupBy(*by, "__t").agg(F.max("__begins").alias("__begins"), F.count("*").alias("__n"), F.sum("__v").alias("__v"))
    numbered = prefix(times, by, ["__t"], {"__session": ("sum", "__begins")})
    found = numbered.groupBy(*by, "__session").agg(F.min("__t").alias("start"), (F.max("__t") + F.expr(f"interval {gap}")).alias("end"), F.sum("__n").alias("n"), F.sum("__v").alias("total"))
    return found.drop("__session")
