"""Connected components of links between 64-bit nodes, by repeated contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.shared import forest, settled

#: Rows of (node, name) that are sent to every task (16 bytes each); rows that share a name before it counts as a hub.
FEW, HUB = 500_000, 100_000


def local_forest(links: DataFrame) -> DataFrame:
    """Links (a, b) -> fewer links with the same components: each Arrow batch becomes its spanning stars."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a is not null and b is not null and a <> b").mapInArrow(run, "a bigint, b bigint")


def renamed(rows: DataFrame, column: str, far: DataFrame, size: int, out: str) -> DataFrame:
    """Rows with ``out``: what ``far`` (node, far; each node once, ``size`` rows) gives for a column. Rows it lacks go.

    A table of at most FEW rows is sent to all tasks. Else the names that over HUB rows share, which are few, are looked
    up that way, and only the others by a shuffle, so that the hub of a star is no hot key.
    """
    table = far.select(F.col("node").alias("__n"), F.col("far").alias(out))
    if size <= FEW:
        return rows.join(F.broadcast(table), F.col(column) == F.col("__n")).drop("__n")
    hubs = settled(rows.groupBy(F.col(column).alias("__hub")).agg(F.count("*").alias("__c")).where(F.col("__c") > HUB).select("__hub"))
    hot = settled(table.join(F.broadcast(hubs), F.col("__n") == F.col("__hub")).select("__hub", F.col(out).alias("__far")))
    told = rows.join(F.broadcast(hot), F.col(column) == F.col("__hub"), "left")
    many = told.where("__hub is not null").withColumn(out, F.col("__far")).drop("__hub", "__far")
    return many.unionByName(told.where("__hub is null").drop("__hub", "__far").join(table, F.col(column) == F.col("__n")).drop("__n"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; component is the least node that it reaches.

    In each round every node points at its least neighbour or itself, pointers are followed once more, and
    links are renamed to what their ends point at; those between different names go on. A component at least
    halves in each round. Hot nodes: minima are combined before they are shuffled, and hubs are looked up without a
    shuffle (``renamed``). Links with a null end and of a node with itself don't count.
    """
    links = settled(local_forest(links).distinct())
    labels = None
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = settled(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        size = up.count()
        far = settled(renamed(up, "to", up.select("node", F.col("to").alias("far")), size, "far").select("node", "far"))
        left = renamed(renamed(links, "a", far, size, "fa"), "b", far, size, "fb").where("fa <> fb")
        links = settled(local_forest(left.select(F.greatest("fa", "fb").alias("a"), F.least("fa", "fb").alias("b")).distinct()).distinct())
        if labels is None:
            labels = far.select("node", F.col("far").alias("component"))
        else:
            labels = settled(labels.join(far.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("far", "component").alias("component")))
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
