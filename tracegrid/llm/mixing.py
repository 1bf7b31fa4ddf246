"""Mixing to target weights: rake token weights to source, language and topic, then sample documents.

Tokens are summed in cells of (source, lang, topic). Iterative proportional fitting gives each cell a weight, the
share of its tokens to take: margin by margin, weights are scaled to the margin's target, never above 1, as a document
is taken once at most, until all margins are within TOLERANCE or ROUNDS are over; ``report`` tells what is left. Targets
are tempered shares of the input, none above ROOM of what there is of its value, or given ones. Topics have words of a
language, so theirs are tempered within each language's target and then added up: a margin of its own, but one that can be
met together with the languages'. A document is then kept if a number in [0, 1) made from its id lies under its cell's
weight, so equal ids meet the same decision in every run.

A document's topic is the topic word that it holds most often, as a whole word; of those held equally often the greatest.
Words are runs of letters, a-z (A-Z in lower case) and everything beyond ASCII. Topic words are the TOPICS words of
SHORTEST to LONGEST letters found in the most documents, but in no more than a share of MOST of them, counted over all
documents; longer runs, as in junk, name no topic.

Edge cases: null source, lang or topic count as the empty string, as does the topic of a text without topic words; a
null text has no tokens; a cell without tokens keeps its weight; a given target must name every value of its margin,
else it is an error; a null id is the empty string for sampling; repeated rows share a decision; an empty table gives
an empty result; the operator's own columns begin with "mix_", and all other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.llm.shared import settled

DIMS = ("source", "lang", "topic")
#: Share of all tokens to take; exponent that draws each margin's shares together.
KEEP, TEMPER = 0.5, 0.85
#: Most rounds of fitting; relative distance from its target at which a margin is met; steps that cap the targets.
ROUNDS, TOLERANCE, CAPS = 12, 0.01, 6
#: The greatest share of a value's tokens that a tempered target may ask for, so that other margins leave room to meet it.
ROOM = 0.85
#: Rounds between two looks at the margins.
BATCH = 6
#: Topics have words of a language, so their targets are tempered within those of the languages.
WITHIN = {"mix_topic": "mix_lang"}
#: Cells up to which the table of weights is sent to every task; beyond, rows and weights are joined by shuffle.
BROADCAST_CELLS = 50_000
#: Topic words, their least and greatest length, and the greatest share of documents that may hold one.
TOPICS, SHORTEST, LONGEST, MOST = 24, 5, 32, 0.2

WORD, LETTER = r"[^\x20\x09-\x0D]+", r"[a-z\x{80}-\x{10FFFF}]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def topic_words(docs: DataFrame, text: str = "text") -> list[str]:
    """The topic words, most frequent first; of equals the lesser word."""
    n = docs.count()
    runs = F.regexp_extract_all(_lower(F.col(text)), F.lit(f"{LETTER}{{{SHORTEST},}}"), F.lit(0))
    words = docs.select(F.explode(F.array_distinct(F.filter(runs, lambda w: F.length(w) <= LONGEST))).alias("w"))
    found = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") <= MOST * n)
    return [r["w"] for r in found.orderBy(F.col("n").desc(), "w").limit(TOPICS).collect()]


def described(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", words: list[str] | None = None) -> DataFrame:
    """Add mix_source, mix_lang, mix_topic and mix_tokens (words); the topic is the greatest of the words held most often."""
    words = topic_words(docs, text) if words is None else words
    whole = rf"(?<!{LETTER})(?:{'|'.join(words)})(?!{LETTER})"  # letters only, so nothing to escape
    # A column of its own that is named twice, as Spark would else find the hits anew for every word.
    docs = docs.withColumn("__hits", F.regexp_extract_all(_lower(F.col(text)), F.lit(whole), F.lit(0)) if words else F.array().cast("array<string>"))
    counts = F.transform(F.array_distinct("__hits"), lambda w: F.struct(F.size(F.filter("__hits", lambda h: h == w)).alias("n"), w.alias("w")))
    named = {"mix_source": F.coalesce(F.col(source), F.lit("")), "mix_lang": F.coalesce(F.col(lang), F.lit("")), "mix_topic": F.coalesce(F.array_max(counts)["w"], F.lit(""))}
    return docs.withColumns(named | {"mix_tokens": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")}).drop("__hits")


def margins(cells: DataFrame, dims: list[str], *more: str) -> DataFrame:
    """(dim, value, taken) and, for each name in more, what it is for the margin's value: one pass over cells for all dims."""
    rows = cells.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), *[F.col(f"{m}_{d}").alias(m) for m in more]) for d in dims])).alias("x"), (F.col("tokens") * F.col("weight")).alias("t"))
    return rows.groupBy("x.dim", "x.value").agg(F.sum("t").alias("taken"), *[F.max(f"x.{m}").alias(m) for m in more])


def of_dim(values: dict[str, float], none: float = 0.0) -> Column:
    return reduce(lambda c, kv: F.when(F.col("dim") == kv[0], F.lit(float(kv[1]))).otherwise(c), values.items(), F.lit(none))


def wanted(sums: DataFrame, dims: list[str], keep: float, temper: float, total: float, targets: dict[str, dict[str, float]]) -> DataFrame:
    """(dim, value, of, to) from (dim, value, taken) of all tokens.

    Tempered targets are in proportion to taken ** temper and make up keep * total, none above ROOM of what there is: those
    that reach that are held there and the rest is scaled anew, CAPS times.
    """
    m, most = F.col("taken"), F.col("taken") * F.lit(ROOM)
    for dim in set(targets) & set(dims):
        unknown = [r[0] for r in sums.where((F.col("dim") == dim) & ~F.col("value").isin(list(targets[dim]))).select("value").limit(5).collect()]
        if unknown:
            raise ValueError(f"no target for {unknown} of {dim}")
    factor: dict[str, float] = {}
    for _ in range(CAPS):
        held = (of_dim(factor) * F.pow(m, F.lit(temper)) >= most) if factor else F.lit(False)
        rows = sums.groupBy("dim").agg(F.sum(F.when(held, most).otherwise(0.0)).alias("held"), F.sum(F.when(held, 0.0).otherwise(F.pow(m, F.lit(temper)))).alias("free")).collect()  # a row for each dim
        now = {r["dim"]: (keep * total - r["held"]) / r["free"] if r["free"] else factor.get(r["dim"], 0.0) for r in rows}
        if now == factor:
            break
        factor = now
    to = F.least(most, of_dim(factor) * F.pow(m, F.lit(temper)))
    for dim, shares in targets.items():
        share = reduce(lambda c, kv: F.when(F.col("value") == kv[0], F.lit(float(kv[1]))).otherwise(c), shares.items(), F.lit(0.0))
        to = F.when(F.col("dim") == dim, share * F.lit(keep * total)).otherwise(to)
    return sums.select("dim", "value", m.alias("of"), to.alias("to"))


def nested(cells: DataFrame, dim: str, other: str, temper: float) -> DataFrame:
    """(dim, to_dim): targets tempered within those of another margin, to_other, and added up over it.

    Within one value of ``other`` the targets are in proportion to tokens ** temper, none above ROOM of what there is.
    """
    own, most = F.pow(F.col("m"), F.lit(temper)), F.col("m") * F.lit(ROOM)
    over = Window.partitionBy(other)  # as many rows as the other margin's value has of this one's
    rows = cells.groupBy(dim, other).agg(F.sum("tokens").cast("double").alias("m"), F.max(f"to_{other}").alias("to"))
    rows = rows.withColumn("f", F.coalesce(F.try_divide(F.col("to"), F.sum(own).over(over)), F.lit(0.0)))
    for _ in range(CAPS - 1):
        held = F.col("f") * own >= most
        free = F.sum(F.when(held, 0.0).otherwise(own)).over(over)
        step = (F.col("to") - F.sum(F.when(held, most).otherwise(0.0)).over(over)) / F.nullif(free, F.lit(0.0))
        rows = rows.withColumn("f", F.coalesce(step, F.col("f")))
    return rows.groupBy(dim).agg(F.sum(F.least(most, F.col("f") * own)).alias(f"to_{dim}"))


def fitted(cells: DataFrame, dim: str, small: bool) -> DataFrame:
    """Weights scaled to one margin. Few cells are summed up where they lie; of many, partial sums meet first."""
    mass = F.sum(F.col("tokens") * F.col("weight"))
    if small:
        rows = cells.withColumn("now", mass.over(Window.partitionBy(dim)))
    else:
        rows = cells.join(cells.groupBy(dim).agg(mass.alias("now")), dim)
    step = F.coalesce(F.try_divide(F.col(f"to_{dim}"), F.col("now")), F.lit(1.0))
    return rows.withColumn("weight", F.least(F.lit(1.0), F.col("weight") * step)).drop("now")


def rake(cells: DataFrame, dims: list[str], keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None, within: dict[str, str] | None = None) -> DataFrame:
    """Add ``weight`` and the margins' targets (to_dim) to cells (dims, tokens).

    targets: dim -> value -> share of the tokens taken, for margins not tempered. within: dim -> another dim within whose
    targets its own are tempered (``nested``), unless they are given; dims that hang together would else ask for what
    can't be. BATCH rounds are a small job over cells, kept in the shared folder.
    """
    total, targets = float(cells.agg(F.sum("tokens")).collect()[0][0] or 0), targets or {}
    inner = {d: o for d, o in (within or {}).items() if d not in targets}
    free = [d for d in dims if d not in inner]
    cells, small = cells.withColumn("weight", F.lit(1.0)), cells.count() <= BROADCAST_CELLS
    sent = F.broadcast if small else lambda x: x
    to = settled(wanted(settled(margins(cells, free)), free, keep, temper, total, targets))
    for dim in free:
        cells = cells.join(sent(to.where(F.col("dim") == dim).select(F.col("value").alias(dim), F.col("to").alias(f"to_{dim}"))), dim)
    for dim, other in inner.items():
        cells = cells.join(sent(nested(cells, dim, other, temper)), dim)
    cells = settled(cells.withColumn("weight", F.lit(float(keep))))
    for n in range(rounds):
        if n % BATCH == 0 and (farthest(cells, dims) or 0.0) <= TOLERANCE:
            break
        for dim in dims:
            cells = fitted(cells, dim, small)
        if not small or (n + 1) % BATCH == 0 or n + 1 == rounds:
            cells = settled(cells)
    return cells


def farthest(cells: DataFrame, dims: list[str]) -> float | None:
    """The greatest relative distance of a margin from its target."""
    return margins(cells, dims, "to").agg(F.max(F.abs(F.try_divide(F.col("taken"), F.col("to")) - 1))).collect()[0][0]


def chance(key: Column) -> Column:
    """A number in [0, 1) from the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def raked(told: DataFrame, **rates) -> DataFrame:
    """Cells of described rows with their weights and targets."""
    dims = [f"mix_{d}" for d in DIMS]
    return rake(settled(told.groupBy(*dims).agg(F.sum("mix_tokens").alias("tokens"))), dims, **({"within": WITHIN} | rates))


def mixed(docs: DataFrame, key: str = "doc_id", told: DataFrame | None = None, **rates) -> DataFrame:
    """All rows with the mix_ columns, mix_weight (the probability to be kept) and mix_kept. told: docs, if described already."""
    dims = [f"mix_{d}" for d in DIMS]
    told = described(docs) if told is None else told
    weights = raked(told, **rates).select(*dims, F.col("weight").alias("mix_weight"))
    if weights.count() <= BROADCAST_CELLS:
        weights = F.broadcast(weights)
    out = told.join(weights, dims)
    return out.select(*docs.columns, *dims, "mix_tokens", "mix_weight", (chance(F.col(key)) < F.col("mix_weight")).alias("mix_kept"))


def report(docs: DataFrame, **rates) -> DataFrame:
    """(dim, value, target, taken) of the fitted weights, in tokens."""
    return margins(raked(described(docs), **rates), [f"mix_{d}" for d in DIMS], "to").select("dim", "value", F.col("to").alias("target"), "taken")


def sample(docs: DataFrame, key: str = "doc_id", **rates) -> DataFrame:
    """The rows of docs that are kept."""
    return mixed(docs, key, **rates).where("mix_kept").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    # Texts are not asked for, so what they are described by is kept and they are read no more.
    found = mixed(docs.select("doc_id"), told=settled(described(docs).drop("text", "source", "lang")))
    return found.select("doc_id", *[F.col(f"mix_{d}").alias(d) for d in DIMS], F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 6).alias("weight"), F.col("mix_kept").alias("kept"))


def oracle() -> str:
    """The same steps in DuckDB's SQL, a table for each; a round after the margins are met changes nothing."""
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    steps = [
        f"l AS MATERIALIZED (SELECT doc_id, source, lang, text, list_filter(regexp_extract_all({low}, '{LETTER}+'), lambda w: length(w) BETWEEN {SHORTEST} AND {LONGEST}) AS words FROM documents)",
        f"u AS MATERIALIZED (SELECT w FROM (SELECT unnest(list_distinct(words)) AS w FROM l) GROUP BY w HAVING count(*) <= {MOST} * (SELECT count(*) FROM documents) ORDER BY count(*) DESC, w LIMIT {TOPICS})",
        "k AS (SELECT doc_id, max({'n': n, 'w': w}).w AS topic FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM l) JOIN u USING (w) GROUP BY ALL) GROUP BY doc_id)",
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(topic, '') AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens FROM l LEFT JOIN k USING (doc_id))",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for dim in DIMS[:2]:
        steps.append(f"m_{dim} AS (SELECT {dim}, sum(tokens) AS m FROM c GROUP BY {dim})")
        want = f"({KEEP} * (SELECT sum(tokens) FROM c))"
        steps.append(f"f_{dim}_0 AS (SELECT {want} / sum(pow(m, {TEMPER})) AS f FROM m_{dim})")
        for n in range(1, CAPS):
            steps.append(f"f_{dim}_{n} AS (SELECT coalesce(({want} - sum(CASE WHEN f * pow(m, {TEMPER}) >= m * {ROOM} THEN m * {ROOM} ELSE 0 END)) / nullif(sum(CASE WHEN f * pow(m, {TEMPER}) >= m * {ROOM} THEN 0 ELSE pow(m, {TEMPER}) END), 0), any_value(f)) AS f FROM m_{dim}, f_{dim}_{n - 1})")
        steps.append(f"t_{dim} AS (SELECT {dim}, least(m * {ROOM}, f * pow(m, {TEMPER})) AS to_{dim} FROM m_{dim}, f_{dim}_{CAPS - 1})")
    steps.append(f"q0 AS (SELECT topic, lang, CAST(sum(tokens) AS DOUBLE) AS m, any_value(to_lang) AS t, any_value(to_lang) / nullif(sum(pow(sum(tokens), {TEMPER})) OVER (PARTITION BY lang), 0) AS f FROM c JOIN t_lang USING (lang) GROUP BY topic, lang)")
    steps.append("g0 AS (SELECT * REPLACE (coalesce(f, 0) AS f) FROM q0)")
    for n in range(1, CAPS):
        full = f"f * pow(m, {TEMPER}) >= m * {ROOM}"
        steps.append(f"g{n} AS (SELECT * REPLACE (coalesce((t - sum(CASE WHEN {full} THEN m * {ROOM} ELSE 0 END) OVER (PARTITION BY lang)) / nullif(sum(CASE WHEN {full} THEN 0 ELSE pow(m, {TEMPER}) END) OVER (PARTITION BY lang), 0), f) AS f) FROM g{n - 1})")
    steps.append(f"t_topic AS (SELECT topic, sum(least(m * {ROOM}, f * pow(m, {TEMPER}))) AS to_topic FROM g{CAPS - 1} GROUP BY topic)")
    steps.append(f"s0 AS (SELECT *, CAST({KEEP} AS DOUBLE) AS w FROM c " + " ".join(f"JOIN t_{dim} USING ({dim})" for dim in DIMS) + ")")
    for n in range(ROUNDS):
        if n % BATCH:
            steps.append(f"e{n} AS (SELECT * FROM s{n})")
        far = ", ".join(f"coalesce(abs(sum(tokens * w) OVER (PARTITION BY {dim}) / nullif(to_{dim}, 0) - 1), 0)" for dim in DIMS)
        if n % BATCH == 0:
            steps.append(f"e{n} AS MATERIALIZED (SELECT * EXCLUDE (far), max(far) OVER () <= {TOLERANCE} AS met FROM (SELECT *, greatest({far}) AS far FROM s{n}))")
        last = f"e{n}"
        for k, dim in enumerate(DIMS):
            steps.append(f"r{n}_{k} AS MATERIALIZED (SELECT * EXCLUDE (w), CASE WHEN met THEN w ELSE least(1.0::DOUBLE, w * coalesce(to_{dim} / nullif(sum(tokens * w) OVER (PARTITION BY {dim}), 0), 1.0)) END AS w FROM {last})")
            last = f"r{n}_{k}"
        steps.append(f"s{n + 1} AS (SELECT * EXCLUDE (w{', met' if n % BATCH == BATCH - 1 else ''}), w FROM {last})")
    chance = "CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, d.tokens, round(w, 6) AS weight, {chance} < w AS kept FROM d JOIN s{ROUNDS} USING (source, lang, topic)"
