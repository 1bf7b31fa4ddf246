"""Group statistics, normalisation and ranks. Statistics are aggregated first and joined back, never a window over a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions.columns import ratio
from tracegrid.operators.ordered import joined
from tracegrid.operators.settle import settled


def zscored(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Columns minus their group's mean over its population deviation; a deviation of 0 counts as 1."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"__a_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))]
    rows = joined(df, df.groupBy(*by).agg(*aggs), by)
    spread = lambda c: F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))
    return rows.withColumns({c: (F.col(c) - F.col(f"__a_{c}")) / spread(c) for c in columns}).drop(*[f"__{k}_{c}" for k in "as" for c in columns])


def row_normalised(df: DataFrame, by: list[str], value: str, mode: str, out: str | None = None) -> DataFrame:
    """mode: mean_std, mean, std, rms or none. What is not finite becomes 0."""
    x, a, s, r = F.col(value), F.col("__a"), F.col("__s"), F.col("__r")
    forms = {"mean_std": ratio(x - a, s), "mean": ratio(x, a), "std": ratio(x, s), "rms": ratio(x, r), "none": x}
    if mode not in forms:
        raise ValueError(f"unknown mode {mode!r}")
    stats = df.groupBy(*by).agg(F.avg(value).alias("__a"), F.stddev_pop(value).alias("__s"), F.sqrt(F.avg(x * x)).alias("__r"))
    y = forms[mode]
    return joined(df, stats, by).withColumn(out or value, F.coalesce(F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y), F.lit(0.0))).drop("__a", "__s", "__r")


def scaled(df: DataFrame, by: list[str], value: str, out: str, flat: float | None = None, top: float = 1.0) -> DataFrame:
    """(x - min) / (max - min) * top; a flat series gives ``flat``."""
    rows = joined(df, df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")), by)
    y = ratio(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * top
    return rows.withColumn(out, F.coalesce(y, F.lit(flat)) if flat is not None else y).drop("__lo", "__hi")


def peak_scaled(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    rows = joined(df, df.groupBy(*by).agg(F.max(value).alias("__hi")), by)
    return rows.withColumn(out, ratio(F.col(value), F.col("__hi"))).drop("__hi")


def bucket_of(marks: DataFrame, rows: DataFrame, by: list[str], value: str, out: str, cuts: int) -> DataFrame:
    """Rows with how many of their group's rising cuts lie below the value, and the other columns of marks.

    Every sixteenth cut is looked at first, and then those up to the next: 30 comparisons of 255.
    """
    coarse = F.array(*[F.element_at("__cuts", k) for k in range(16, cuts, 16)])
    met = joined(rows, marks.withColumn("__coarse", coarse), by)
    met = met.withColumn("__c", F.size(F.filter("__coarse", lambda c: c < F.col(value))))
    near = F.slice("__cuts", F.col("__c") * 16 + 1, F.lit(15))
    return met.withColumn(out, F.col("__c") * 16 + F.size(F.filter(near, lambda c: c < F.col(value)))).drop("__cuts", "__coarse", "__c")


def cut_marks(counts: DataFrame, by: list[str], value: str, cuts: int, *more: Column) -> DataFrame:
    """(by, __cuts, more): a group's approximate cuts, rising. They are settled, as they depend on the order in which parts
    of a group arrive: taken twice, two readers of one plan would deal the same value to different buckets."""
    at = F.percentile_approx(value, [k / cuts for k in range(1, cuts)], 10 * cuts)
    return settled(counts.groupBy(*by).agg(F.array_sort(at).alias("__cuts"), *more))


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float], cuts: int = 256) -> DataFrame:
    """(by, p, q): exact quantiles, interpolated, of groups of any size.

    Equal values are counted first. Approximate cuts then spread a group's values over buckets, whose counts tell
    which of them hold the wanted ranks; only within those are values put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    marks = cut_marks(counts, by, "__v", cuts, F.sum("__n").alias("__total"))
    bucketed = bucket_of(marks, counts, by, "__v", "__b", cuts)
    sizes = bucketed.groupBy(*by, "__b", "__total").agg(F.sum("__n").alias("__size"))
    sizes = sizes.withColumn("__before", F.sum("__size").over(Window.partitionBy(*by).orderBy("__b")) - F.col("__size"))
    rank = F.col("p") * (F.col("__total") - 1)
    asked = sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in at]))).withColumn("__k", F.explode(F.array(F.floor(rank), F.ceil(rank))))
    asked = asked.where((F.col("__k") >= F.col("__before")) & (F.col("__k") < F.col("__before") + F.col("__size")))
    needed = asked.select(*by, "__b", "__before").distinct()
    values = joined(bucketed.select(*by, "__b", "__v", "__n"), needed, [*by, "__b"], "inner")
    upto = F.sum("__n").over(Window.partitionBy(*by, "__b").orderBy("__v"))
    values = values.withColumn("__hi", F.col("__before") + upto).withColumn("__lo", F.col("__hi") - F.col("__n")).drop("__before", "__n")
    hit = joined(asked.select(*by, "__b", "p", "__k", "__total"), values, [*by, "__b"], "inner").where((F.col("__k") >= F.col("__lo")) & (F.col("__k") < F.col("__hi")))
    part = rank - F.floor(rank)
    ends = hit.groupBy(*by, "p", "__total").agg(F.min("__v").alias("__x"), F.max("__v").alias("__y"))
    return ends.select(*by, "p", (F.col("__x") + (F.col("__y") - F.col("__x")) * part).alias("q"))


def signal_threshold(df: DataFrame, by: list[str], value: str, share: float = 0.2, base: float = 0.0001) -> DataFrame:
    """(by, threshold): the base quantile plus a share of the way from it to the median."""
    q = quantiles(df, by, value, [base, 0.5]).groupBy(*by).agg(F.max_by("q", -F.col("p")).alias("__b"), F.max_by("q", "p").alias("__m"))
    return q.select(*by, (F.col("__b") + share * (F.col("__m") - F.col("__b"))).alias("threshold"))


def levels_by(df: DataFrame, by: list[str], value: str, count: int = 2) -> DataFrame:
    """(by, place, level): medians of what is left when values within a tenth of the range around each earlier level are taken out."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    rest = joined(rows, rows.groupBy(*by).agg(((F.max("__v") - F.min("__v")) / 10).alias("__r")), by)
    found = None
    for place in range(count):
        mid = quantiles(rest, by, "__v", [0.5]).select(*by, F.col("q").alias("level"))
        one = mid.select(*by, F.lit(place).alias("place"), "level")
        found = one if found is None else found.unionByName(one)
        rest = joined(rest, mid, by, "inner").where(F.abs(F.col("__v") - F.col("level")) >= F.col("__r")).drop("level")
    return found


def levels(df: DataFrame, value: str, count: int = 2) -> list[float]:
    """The levels of all rows together, as a list."""
    return [r["level"] for r in levels_by(df, [], value, count).orderBy("place").collect()]  # ``count`` rows


def average_ranks(df: DataFrame, by: list[str], value: str, out: str, cuts: int = 256) -> DataFrame:
    """Ranks from 1, equal values sharing the mean of theirs; NULL has none.

    Values are counted first. Approximate cuts deal a group's distinct values to buckets; they are put in order within
    a bucket, and only the buckets' sizes over the group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    rows = bucket_of(cut_marks(counts, by, "__v", cuts), counts, by, "__v", "__b", cuts)
    sizes = rows.groupBy(*by, "__b").agg(F.sum("__n").alias("__size"))
    sizes = sizes.select(*by, "__b", (F.sum("__size").over(Window.partitionBy(*by).orderBy("__b")) - F.col("__size")).alias("__before"))
    upto = F.sum("__n").over(Window.partitionBy(*by, "__b").orderBy("__v"))
    ranks = joined(rows.withColumn("__upto", upto), sizes, [*by, "__b"]).select(*by, F.col("__v").alias(value), (F.col("__before") + F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))
    return joined(df, ranks, [*by, value])


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    rows = average_ranks(average_ranks(df, by, a, "__ra"), by, b, "__rb")
    return rows.groupBy(*by).agg(F.corr("__ra", "__rb").alias("rho"))


def auc(df: DataFrame, by: list[str], positive: Column, score: str) -> DataFrame:
    """(by, auc) from average ranks; NULL where only one class occurs."""
    rows = average_ranks(df.withColumn("__pos", positive).where(F.col("__pos").isNotNull()), by, score, "__r")
    n, p = F.count("*"), F.count_if("__pos")
    total = F.sum(F.when(F.col("__pos"), F.col("__r")))
    return rows.groupBy(*by).agg(ratio(total - p * (p + 1) / 2, (p * (n - p)).cast("double")).alias("auc"))


def empirical_p(nulls: DataFrame, real: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, p): (1 + draws at or above the real value) / (draws + 1); NULL draws don't count."""
    met = joined(nulls.select(*by, F.col(value).alias("__null")), real.select(*by, F.col(value).alias("__real")), by, "inner")
    return met.groupBy(*by).agg(((1 + F.count_if(F.col("__null") >= F.col("__real"))) / (F.count("__null") + 1)).alias("p"))


def robust_threshold(df: DataFrame, by: list[str], value: str, z: float) -> DataFrame:
    """(by, lower, upper): median -+ z spreads around the median (n - 1); no lower bound where no value is negative."""
    mid = quantiles(df, by, value, [0.5]).select(*by, F.col("q").alias("__m"))
    rows = joined(df, mid, by)
    stats = rows.groupBy(*by).agg(F.first("__m").alias("m"), F.sqrt(ratio(F.sum(F.pow(F.col(value) - F.col("__m"), 2)), F.count(value) - 1)).alias("s"), F.min(value).alias("__lo"))
    return stats.select(*by, F.when(F.col("__lo") < 0, F.col("m") - z * F.col("s")).alias("lower"), (F.col("m") + z * F.col("s")).alias("upper"))


def hoyer(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, sparsity): (sqrt n - l1/l2) / (sqrt n - 1); 0 for one value or none but zeros."""
    n = F.sqrt(F.count(value))
    l1, l2 = F.sum(F.abs(value)), F.sqrt(F.sum(F.col(value) * F.col(value)))
    return df.groupBy(*by).agg(F.coalesce(ratio(n - ratio(l1, l2), n - 1), F.lit(0.0)).alias("sparsity"))


def activation(df: DataFrame, by: list[str], value: str, share: float = 0.1) -> DataFrame:
    """(by, active): share of rows whose size exceeds ``share`` of the group's largest."""
    rows = joined(df, df.groupBy(*by).agg(F.max(F.abs(value)).alias("__hi")), by)
    return rows.groupBy(*by).agg(F.avg((F.abs(F.col(value)) > share * F.col("__hi")).cast("double")).alias("active"))


def top_mean(df: DataFrame, by: list[str], value: str, ties: list[str], k: int = 3) -> DataFrame:
    """(by, top): mean of the k largest. Each salted part gives up its k largest before they meet."""
    salted = df.where(F.col(value).isNotNull()).withColumn("__s", F.pmod(F.xxhash64(*ties), F.lit(64)))
    order = [F.col(value).desc(), *ties]
    first = salted.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__s").orderBy(*order))).where(F.col("__k") <= k)
    best = first.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= k)
    return best.groupBy(*by).agg(F.avg(value).alias("top"))


def binary(column: str) -> Column:
    """Aggregate: true if all values are 0 or 1; a column without values counts as binary."""
    return F.coalesce(F.bool_and(F.col(column).isin(0, 1)), F.lit(True))


def varied(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least two different values, found in one pass."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def smoothed_mode(df: DataFrame, by: list[str], value: str, lo: float, hi: float, bins: int, sigma: float = 1.0) -> DataFrame:
    """(by, mode): centre of the fullest bin of a histogram after Gaussian smoothing with reflected borders."""
    from tracegrid.operators.series import smoothed

    width = (hi - lo) / bins
    inside = df.where(F.col(value).between(lo, hi)).withColumn("__bin", F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("bigint"))
    counts = inside.groupBy(*by, "__bin").agg(F.count("*").alias("__n"))
    full = df.select(*by).distinct().withColumn("__bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    rows = smoothed(joined(full, counts, [*by, "__bin"]), by, "__bin", {"__y": "__n"}, sigma, "even", "reflect")
    return rows.groupBy(*by).agg((F.max_by("__bin", F.struct("__y", -F.col("__bin"))) * width + lo + width / 2).alias("mode"))
