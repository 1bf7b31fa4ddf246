"""Positions of regular-expression matches as native Spark columns.

Spark returns the texts of all matches but not where they lie. The texts between the
matches are what ``split`` returns, so each position is a running sum of lengths. All
positions are code points, counted from 0, ends exclusive.

A fold in Spark copies its state in every step, so no list grows in one. Running sums come from sums of blocks
(``running``), and pieces of a long text from blocks of it (``piece``). What a lambda reads is a column of an earlier
projection, named twice or more, as Spark would otherwise compute it anew for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,ord:int,end:bigint,kind:string,hit:string>"
#: Elements in a block of a running sum; code points in a block of a text.
BLOCK, LETTERS = 64, 256


def running(df: DataFrame, arrays: dict[str, str], zero: int = 0, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> DataFrame:
    """Add columns: for each element of an array<bigint> column the fold of all elements up to and with it; null for null or empty ones."""
    start = F.lit(zero).cast("bigint")

    def total(of: str, lo: Column, hi: Column) -> Column:
        return F.aggregate(F.sequence(lo, hi), start, lambda a, j: add(a, F.get(of, j)))

    def block(i: Column) -> Column:
        return F.floor(i / BLOCK).cast("int")

    def each(x: str) -> Column:
        last = F.size(x) - 1
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), block(last)), lambda b: total(x, b * BLOCK, F.least(b * BLOCK + BLOCK - 1, last))))

    def upto(k: str) -> Column:
        return F.transform(f"__each_{k}", lambda _, b: total(f"__each_{k}", F.lit(0), b))

    def one(k: str, x: str) -> Column:
        before = F.col(f"__upto_{k}")
        return F.when(F.size(before) > 0, F.transform(x, lambda _, i: add(F.when(i >= BLOCK, F.get(before, block(i) - 1)).otherwise(start), total(x, block(i) * BLOCK, i))))

    df = df.withColumns({f"__each_{k}": each(x) for k, x in arrays.items()})
    df = df.withColumns({f"__upto_{k}": upto(k) for k in arrays})
    return df.withColumns({k: one(k, x) for k, x in arrays.items()}).drop(*[f"__{x}_{k}" for k in arrays for x in ("each", "upto")])


def blocks(text: Column) -> Column:
    """The text in blocks of LETTERS code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{LETTERS}}}"), F.lit(0))


def piece(of: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of the text that was cut into the blocks ``of``."""
    n, some = F.greatest(end - start, F.lit(0)).cast("int"), F.sequence(F.floor(start / LETTERS).cast("int"), F.floor((end - 1) / LETTERS).cast("int"))
    return F.when((n > 0) & (F.size(of) > 0), F.substring(F.array_join(F.transform(some, lambda j: F.get(of, j)), ""), (start % LETTERS + 1).cast("int"), n)).otherwise(F.lit(""))


def with_spans(df: DataFrame, text: str, rules: list[tuple[str, str]], out: str, *, valid: dict | None = None) -> DataFrame:
    """Add ``out``: an array of SPAN, ordered by start, then by the rules' order.

    rules: (kind, Java pattern). Matches are leftmost and do not overlap within a kind.
    valid: kind -> function from the match's text (a Column) to a boolean Column; matches that fail
    are dropped, without another try inside them. A null text counts as empty.
    """
    keep, body = df.columns, F.coalesce(F.col(text), F.lit(""))
    own = lambda kind, part: f"__{out}_{part}_{kind}"
    kinds = [k for k, _ in rules]
    df = df.withColumns({own(k, "hits"): F.regexp_extract_all(body, F.lit(p), F.lit(0)) for k, p in rules})
    # Only texts with a match are split, so most texts are read once for each rule.
    gaps = {k: F.slice(F.split(body, p, -1), F.lit(1), F.size(own(k, "hits"))) for k, p in rules}
    df = df.withColumns({own(k, "pairs"): F.when(F.size(own(k, "hits")) > 0, F.zip_with(gaps[k], F.col(own(k, "hits")), lambda g, h: F.struct((F.length(g) + F.length(h)).cast("bigint").alias("step"), h.alias("hit")))) for k in kinds})
    df = df.withColumns({own(k, "steps"): F.transform(own(k, "pairs"), lambda x: x["step"]) for k in kinds})
    df = running(df, {own(k, "ends"): own(k, "steps") for k in kinds})

    def spans(kind: str, order: int) -> Column:
        end = F.col(own(kind, "ends"))
        rows = F.transform(own(kind, "pairs"), lambda x, i: F.struct((F.get(end, i) - F.length(x["hit"])).alias("start"), F.lit(order).alias("ord"), F.get(end, i).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit")).cast(SPAN))
        if kind in (valid or {}):
            rows = F.filter(rows, lambda s: valid[kind](s["hit"]))
        return F.when(F.size(end) > 0, rows).otherwise(F.array().cast(f"array<{SPAN}>"))

    return df.select(*keep, F.sort_array(F.concat(*[spans(k, i) for i, k in enumerate(kinds)])).alias(out))


def listed(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of each span, comma-joined, in the order of the array."""
    rows = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
