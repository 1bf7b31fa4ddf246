"""Bottom-k sketches of word-shingle hashes: mergeable, for resemblance, containment and distinct counts.

A sketch is the sorted array of the k least distinct 32-bit hashes of a text's shingles of WORDS words (fewer words:
one shingle of all; none: an empty sketch). The sketch of a union is the k least of both sketches' values, so parts
merge in any order. Likeness is the share of a union's k least values that both sketches have.

Edge cases: a null text is empty; two empty sketches are alike (1), an empty and another one not (0); repeated rows
and rows with a null id get sketches as any; an empty table gives an empty result; other columns pass through.
In the query, rows with a null id have no place in the order of ids and no result; an id that repeats gives a row for
each pair of its rows and its neighbour's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.llm.shared import settled

WORDS, K = 5, 128
_SPACE = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS, k: int = K) -> DataFrame:
    """Add ``out``: array<int>, the k least shingle hashes as signed 32-bit values."""
    hashed = f"__{out}_h"
    kept = df.columns
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(hashed, F.transform(F.filter(F.split(body, _SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)))
    h = F.col(hashed)
    full = F.transform(F.slice(h, F.lit(1), F.size(h) - words + 1), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, words)]))
    shingles = F.when(F.size(h) >= words, full).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    top = F.transform(shingles, lambda x: F.shiftright(x, 32).cast("int"))
    return df.select(*kept, F.slice(F.sort_array(F.array_distinct(top)), 1, k).alias(out))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of a union. Both must have been made with the same k."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A or B|."""
    union = merged(a, b, k)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def distinct(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below k, else from the k-th least hash."""
    share = (F.element_at(a, k).cast("double") + 2.0**31 + 1) / 2.0**32
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A|; 1 if A is empty."""
    both = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct(a, k)))


def merge_parts(df: DataFrame, by: list[str], sketch: str, k: int = K, salts: int = 16) -> DataFrame:
    """One sketch for each group of rows: k least of each salted part first, then of the parts; never a group's rows in one place."""
    rows = df.select(*by, F.explode(sketch).alias("h")).distinct()
    salted = rows.groupBy(*by, F.pmod(F.xxhash64("h"), F.lit(salts)).alias("s")).agg(F.array_agg("h").alias("hs"))
    salted = salted.select(*by, F.slice(F.sort_array("hs"), 1, k).alias("hs"))
    return salted.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("hs"))), 1, k).alias(sketch))


def neighbours(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """(key, next): the next lower key, and for the least key the greatest. Null keys have none.

    Keys alone are dealt by range and looked up within each range; a range's least key finds its
    neighbour among the greatest keys of the ranges, one row for each range.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = settled(df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()))
    inner = ids.withColumn("next", F.max(key).over(Window.partitionBy("part").orderBy(key).rowsBetween(-1, -1)))
    tops = ids.groupBy("part").agg(F.max(key).alias("top"))
    order = Window.orderBy("part")  # as many rows as there are ranges
    tops = settled(tops.select("part", F.coalesce(F.lag("top").over(order), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below")))
    return inner.join(tops, "part").select(key, F.coalesce("next", "below").alias("next"))


def code(a: Column) -> Column:
    """A sketch as a string: 8 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint") + 2**31)), 8, "0")), "")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    follows = settled(neighbours(docs, "doc_id").select("doc_id", F.col("next").alias("next_id")))
    sizes = docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
    # Who comes before whom, and how many code points it takes of its follower's head.
    asks = settled(follows.join(sizes, "doc_id").select(F.col("next_id").alias("of"), F.col("doc_id").alias("asker"), F.floor(F.col("n_chars") / 3).cast("int").alias("cut")))
    bodies = with_sketch(docs, "text", "sketch")
    heads = bodies.join(asks, F.col("doc_id") == F.col("of")).select("asker", "cut", F.expr("substring(text, 1, cut)").alias("head"), F.col("sketch").alias("next_sketch"))
    both = bodies.join(heads, F.col("doc_id") == F.col("asker"))
    n = F.length("text")
    edited = both.select("doc_id", "sketch", "next_sketch", n.cast("bigint").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - F.col("cut")), F.col("head")).alias("edited"))
    edited = with_sketch(edited, "edited", "edited_sketch")
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        code(F.col("sketch")).alias("fingerprint"),
        code(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.round(distinct(F.col("sketch")), 3).alias("n_distinct"),
        F.round(containment(F.col("sketch"), F.col("edited_sketch")), 6).alias("contained_in_edited"),
    )
