"""Where the named queries register, each with the SQL that says the same (None: SQL can't, or not in reasonable time)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions.columns import seconds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Seconds of a bucket of time in the as-of operators.
DAY = 86_400.0

#: Events with seconds t and dense position k, in DuckDB's SQL.
EV = "ev AS (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with t, seconds since the beginning of 2024."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", seconds(F.col("ts")).alias("t"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with k, the dense position within a user."""
    from tracegrid.operators.ordered import positions

    return positions(events(spark, sf_dir), ["user_id"], "t", ["event_id"], "k", DAY)


def r6(c, name: str):
    return F.round(c, 6).alias(name)
