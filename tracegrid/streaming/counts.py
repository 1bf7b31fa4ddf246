"""Streaming forms of two ordered operators. An extension: the batch operators are the ones with parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_counts(stream: DataFrame, by: list[str], time: str, counts: dict[str, Column], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of named conditions for each window of event time; rows later than ``late`` are left out by the watermark."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width), *by)
    return rows.agg(*[F.count_if(c).alias(k) for k, c in counts.items()]).select(*by, F.col("window.start").alias("start"), *counts)


def session_totals(stream: DataFrame, by: list[str], counts: dict[str, Column]) -> DataFrame:
    """Running totals of each session; for output mode 'update' or 'complete'."""
    return stream.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
