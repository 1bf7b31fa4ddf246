"""Results that are computed once and kept where every executor can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a checkpoint, in the folder of spark.checkpoint.dir.

    A local session without that setting, as in tests, gets a folder of its own; a cluster without it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracegrid-"))
    return df.checkpoint(eager=True)
