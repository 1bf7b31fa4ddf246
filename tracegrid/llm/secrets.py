"""Secret scans over an incremental ledger of content-addressed blobs.

A version of a file is a path plus its text. Its address is the SHA-256 of the text, so versions with
equal texts share one blob. A scan takes the blobs for which the ledger has no entry under a rule set's
version, reads one text of each, appends its findings to the ledger, and joins them back to every path.

Edge cases: a null text is the empty text; repeated rows and equal texts give one blob and a result for
each row; a null path keeps its row; an empty table gives an empty result and an empty ledger; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm import spans as sp
from tracegrid.llm.shared import settled, shared_dir


@dataclass(frozen=True)
class RuleSet:
    """version: part of the ledger's key. rules: (kind, Java pattern). valid: kind -> test of the match's text."""

    version: str
    rules: tuple[tuple[str, str], ...]
    valid: tuple[tuple[str, object], ...] = ()


# The kinds of secret. A run under 16 hex digits, or a key id under 18 characters, never holds
# another match that would pass, so these two ask for the length at once; values of assignments are measured afterwards.
# A token begins where a run of its letters begins, and its parts give nothing back, so that no run is read from every place.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"


def _long_value(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, ASSIGN, 1)) >= 12


RULES = RuleSet("base-1", (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("pem", PEM), ("jwt", JWT)), (("assign", _long_value),))
BASE = ["assign", "access", "hex"]
LEDGER = f"blob string, spans array<{sp.SPAN}>, rule_version string"
#: Bytes of new blobs' addresses up to which they are sent to every task, and those of one; beyond, texts and addresses
#: are joined by shuffle. Parts in which the query takes its table in.
SENT_BYTES, ADDRESS_BYTES, DELIVERIES = 1 << 20, 100, 2


def addresses(versions: DataFrame, path: list[str], text: str = "text") -> DataFrame:
    """The given path columns and ``blob``, the lowercase hex SHA-256 of each version's text."""
    return versions.select(*path, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("blob"))


def scan_new(versions: DataFrame, key: str, ledger: DataFrame | None = None, rules: RuleSet = RULES, text: str = "text", told: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) for the blobs that the ledger lacks under this rule version.

    Which text to read is settled on the addresses alone (``told``, if they are known): the least key of each blob. Texts
    then move once, by key, so copies of one text never meet in one task; if few blobs are new, their keys go to the
    texts instead.
    """
    told = addresses(versions, [key], text) if told is None else told
    first = told.groupBy("blob").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"))).alias("least"))
    first = first.select("blob", F.col("least.key").alias("__key"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == rules.version).select("blob").distinct(), "blob", "left_anti")
    first = settled(first)
    if first.count() * ADDRESS_BYTES <= SENT_BYTES:
        first = F.broadcast(first)
    bodies = versions.select(F.col(key).alias("__of"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    same = F.col("__of").eqNullSafe(F.col("__key"))
    chosen = bodies.join(first, same).where(F.sha2(F.col("__text").cast("binary"), 256) == F.col("blob"))
    found = sp.with_spans(chosen.select("blob", "__text"), "__text", list(rules.rules), "spans", valid=dict(rules.valid))
    # A row that occurs twice under its key is read twice; one entry stays.
    return found.groupBy("blob").agg(F.first("spans").alias("spans")).select("blob", F.lit(rules.version).alias("rule_version"), "spans")


def joined_back(told: DataFrame, ledger: DataFrame, rules: RuleSet = RULES) -> DataFrame:
    """The addresses ``told`` with the ledger's spans. The ledger's side is settled first, so that Spark may split a blob that many paths have."""
    entries = settled(ledger.where(F.col("rule_version") == rules.version).groupBy("blob").agg(F.first("spans").alias("spans")))
    return told.join(entries, "blob", "left")


def scan(versions: DataFrame, key: str, ledger: DataFrame | None = None, rules: RuleSet = RULES, text: str = "text") -> DataFrame:
    """(key, blob, spans) for every version: the ledger's findings and the new ones, joined back to all paths."""
    told = settled(addresses(versions, [key], text))
    entries = scan_new(versions, key, ledger, rules, text, told)
    return joined_back(told, entries if ledger is None else entries.unionByName(ledger.select(*entries.columns)), rules)


def append_to_ledger(entries: DataFrame, path: str) -> None:
    """Add new entries to a ledger kept as Parquet, a folder for each rule version."""
    entries.write.mode("append").partitionBy("rule_version").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def scan_history(versions: DataFrame, key: str, path: str, rules: RuleSet = RULES, text: str = "text", deliveries: int = DELIVERIES) -> DataFrame:
    """(key, blob, spans) for every version, taken in through the ledger at ``path`` in several deliveries.

    A version belongs to a delivery by its key. Each one looks for its blobs in the ledger as it then is, scans those
    that it lacks and appends them; in the end the whole ledger is joined back to all paths.
    """
    spark = versions.sparkSession
    of = F.pmod(F.xxhash64(key), F.lit(deliveries))
    told = settled(addresses(versions, [key], text))
    for n in range(deliveries):
        ledger = read_ledger(spark, path) if n else None
        append_to_ledger(scan_new(versions.where(of == n), key, ledger, rules, text, told.where(of == n)), path)
    return joined_back(told, read_ledger(spark, path), rules)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_history(docs, "doc_id", f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    base = sp.listed(F.col("spans"), BASE)
    return found.select("doc_id", *[sp.count_of(F.col("spans"), k).alias(f"n_{k}") for k in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), sp.listed(F.col("spans")).alias("spans"), "blob")


def oracle() -> str:
    """The same rows in DuckDB's SQL, by running sums over the texts between the matches."""
    base = [("assign", ASSIGN, "length(regexp_extract(h, '{p}', 1)) >= 12"), ("access", ACCESS, "true"), ("hex", "[0-9a-f]{16,}", "true"), ("pem", PEM, "true"), ("jwt", r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true")]
    # That engine's patterns can't look back, so a token's match holds the letter before it, which its start leaves out.
    return spans_sql("documents", [(k, p.replace("'", "''"), t.replace("{p}", p.replace("'", "''"))) for k, p, t in base], BASE, extra=", sha256(coalesce(text, '')) AS blob", skip={"jwt": "length(regexp_replace({h}, '(?s)eyJ.*', ''))"})


def spans_sql(table: str, rules: list[tuple[str, str, str]], base: list[str], extra: str = "", skip: dict[str, str] | None = None) -> str:
    """DuckDB SQL: counts, digest and list of spans. rules: (kind, pattern with quotes doubled, test on h). skip: kind -> code points before the span in a hit {h}."""
    left = lambda kind, i: f" + {skip[kind].format(h=f'h{i}[k]')}" if kind in (skip or {}) else ""
    hits = ", ".join(f"regexp_extract_all(t, '{p}') AS h{i}, string_split_regex(t, '{p}') AS g{i}" for i, (_, p, _) in enumerate(rules))
    rows = ", ".join(f"list_transform(range(1, len(h{i}) + 1), lambda k: {{'s': s{i}[k]{left(kind, i)}, 'o': {i}, 'e': s{i}[k] + length(h{i}[k]), 'k': '{kind}', 'h': h{i}[k]}})" for i, (kind, _, _) in enumerate(rules))
    starts = ", ".join(f"list_transform(range(1, len(h{i}) + 1), lambda k: CAST(list_sum(list_transform(g{i}[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h{i}[1:k-1], lambda x: length(x))), 0) AS BIGINT)) AS s{i}" for i in range(len(rules)))
    keep = " OR ".join(f"(x.k = '{kind}' AND {re.sub(r'(?<=[(])h(?=[,)])', 'x.h', test)})" for kind, _, test in rules)
    text = "list_transform({0}, lambda x: x.k || ':' || x.s || ':' || x.e)"
    some = "list_filter(a, lambda x: x.k IN (" + ", ".join(f"'{k}'" for k in base) + "))"
    counts = ", ".join(f"CAST(len(list_filter(a, lambda x: x.k = '{k}')) AS BIGINT) AS n_{k}" for k in base)
    return f"""
WITH t AS (SELECT *, coalesce(text, '') AS t FROM {table}),
h AS (SELECT *, {hits} FROM t),
p AS (SELECT *, {starts} FROM h),
a AS (SELECT *, list_sort(list_filter(flatten([{rows}]), lambda x: {keep})) AS a FROM p)
SELECT doc_id, {counts}, sha256(array_to_string({text.format(some)}, ',')) AS base_sha256,
       array_to_string({text.format('a')}, ',') AS spans{extra}
FROM a
"""
