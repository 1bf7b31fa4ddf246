"""Named blocks of features on one clock: a registry of extractors, and blocks put side by side as targets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.ordered import joined
from tracegrid.operators.stats import binary, varied, zscored

#: name -> (extractor, its defaults, what it does)
EXTRACTORS: dict[str, tuple[Callable[..., DataFrame], dict, str]] = {}


def extractor(name: str, text: str = "", **defaults):
    """Register a function DataFrame -> DataFrame under a name."""

    def keep(f):
        EXTRACTORS[name] = (f, defaults, text)
        return f

    return keep


def extracted(name: str, df: DataFrame, **settings) -> DataFrame:
    if name not in EXTRACTORS:
        raise KeyError(f"no extractor {name!r}; there are {sorted(EXTRACTORS)}")
    f, defaults, _ = EXTRACTORS[name]
    return f(df, **(defaults | settings))


def combined(blocks: dict[str, DataFrame], names: list[str], key: list[str]) -> DataFrame:
    """Blocks side by side on their key; columns get their block's name in front."""
    if missing := [n for n in names if n not in blocks]:
        raise KeyError(f"no blocks {missing}; there are {sorted(blocks)}")
    named = [blocks[n].select(*key, *[F.col(c).alias(f"{n}_{c}") for c in blocks[n].columns if c not in key]) for n in names]
    return reduce(lambda a, b: joined(a, b, key, "inner"), named)


def without_presence(df: DataFrame, prefix: str = "pres") -> DataFrame:
    left = [c for c in df.columns if not c.startswith(prefix)]
    if not left:
        raise ValueError("every column is a presence column")
    return df.select(left)


def supervision(blocks: dict[str, DataFrame], names: list[str], key: list[str], by: list[str]) -> DataFrame:
    """Blocks side by side, gaps as 0, then each column z-scored within ``by``."""
    df = combined(blocks, names, key)
    values = [c for c in df.columns if c not in key]
    return zscored(df.na.fill(0.0, values), by, values)


def targets(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, name, y, binary) rows of the columns that vary."""
    values = varied(df, [c for c in df.columns if c not in key])
    kinds = df.agg(*[binary(c).alias(c) for c in values]).first() if values else {}
    long = df.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("y"), F.lit(bool(kinds[c])).alias("binary")) for c in values])).alias("t")) if values else df.select(*key).where("false").selectExpr("*", "struct(cast(null as string) name, cast(null as double) y, cast(null as boolean) binary) t")
    return long.select(*key, "t.*")


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in all the columns."""
    return df.na.drop(subset=columns)
