"""The functions on streams.

All functions but the relational ranking work on each row alone, so a stream needs no state for them; rankings on
streams use the array form.  Counts of keys by time keep their state behind a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoscope.functions.simplify import simplify
from phonoscope.functions.sql import FUNCTIONS


def converted(stream: DataFrame, column: str, function: str, into: str) -> DataFrame:
    """The stream with a function of one of its columns added."""
    return stream.withColumn(into, FUNCTIONS[function](F.col(column)))


def key_counts(stream: DataFrame, column: str, time: str, window: str = "1 hour", late: str = "2 hours", key: Column | None = None) -> DataFrame:
    """window, text, n: how often each simplified key of a column's words occurs in each window; rows later than `late` are dropped."""
    views = simplify(key if key is not None else F.col(column))
    rows = stream.withWatermark(time, late).select(F.col(time), F.explode(views).alias("view"))
    return rows.groupBy(F.window(time, window), F.col("view.text").alias("text")).agg(F.count("*").alias("n"))
