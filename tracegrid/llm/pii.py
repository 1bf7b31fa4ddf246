"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Kinds: email, ip, card (Luhn), phone, and iban (mod 97). Each span has a score from 0 to 1: its kind's own
score, higher after a checksum, raised when a word that goes with the kind stands shortly before it.

Edge cases: a null text is empty and gives no spans; every row gives a row, repeated rows and null ids
included; an empty table gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm import spans as sp
from tracegrid.llm.secrets import spans_sql

# The patterns. A run of digits is looked at as a whole, from its first digit to its last, so that the
# card pattern can ask for 14 to 19 digits at once and addresses try each run once; an address's local part begins where
# its run of letters begins. An account number comes in one piece or in groups of four, some of them letters alone.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_FOUR = r"(?:[0-9][A-Z0-9]{3}|[A-Z][0-9][A-Z0-9]{2}|[A-Z]{2}[0-9][A-Z0-9]|[A-Z]{3}[0-9])"
_REST = r"(?:[0-9][A-Z0-9]{0,2}|[A-Z][0-9][A-Z0-9]?|[A-Z]{2}[0-9])"
IBAN = rf"[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?:(?: [A-Z]{{4}}){{0,2}} {_FOUR}){{2,7}}(?: {_REST})?)"
RULES = [("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("iban", IBAN)]
BASE = ["email", "ip", "card", "phone"]
# Score of a kind by itself, and the words that raise it.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT = {"email": "mail|contact|write|@", "ip": "ip|host|server|address|login", "card": "card|visa|credit|pay|debit", "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account|transfer"}
#: How many code points before a span are searched for such words, and what one adds.
WINDOW, BONUS = 40, 0.2


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits of a string pass Luhn's check. Every second digit from the right counts twice."""
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(
        F.split(F.reverse(number), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(False).alias("second")),
        lambda a, c: F.struct((a["sum"] + F.when(a["second"], twice(c.cast("int"))).otherwise(c.cast("int"))).alias("sum"), (~a["second"]).alias("second")),
        lambda a: a["sum"],
    )
    return F.when(number.rlike("^[0-9]+$"), total % 10 == 0).otherwise(False)


def mod97(code: Column) -> Column:
    """True if an account number (spaces apart, upper case) leaves 1 when divided by 97, its first four characters moved to the end."""
    bare = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(value(c) < 10, (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))
    return (F.length(bare).between(15, 34)) & (rest == 1)


def _small_parts(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


VALID = {"ip": _small_parts, "card": lambda h: luhn(digits(h)), "phone": lambda h: F.length(digits(h)).between(10, 15), "iban": mod97}


def find(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array<struct<start,end,kind,hit,score>> by start, then by kind as listed in RULES."""
    cols = [c for c in df.columns if c != out]
    df = sp.with_spans(df, text, RULES, out, valid=VALID)
    df = df.withColumn("__blocks", F.when(F.size(out) > 0, sp.blocks(F.col(text))))

    def score(s: Column) -> Column:
        before = F.lower(sp.piece(F.col("__blocks"), F.greatest(s["start"] - WINDOW, F.lit(0)), s["start"]))
        own, near = F.lit(0.0), F.lit(False)
        for kind in SCORES:
            own = F.when(s["kind"] == kind, F.lit(SCORES[kind])).otherwise(own)
            near = F.when(s["kind"] == kind, before.rlike(CONTEXT[kind])).otherwise(near)
        return F.round(own + F.when(near, F.lit(BONUS)).otherwise(0.0), 3)

    return df.select(*cols, F.transform(out, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"), score(s).alias("score"))).alias(out))


def redact(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """Replace each span that scores ``least`` or more by its kind in brackets; of spans that overlap, what the first leaves goes with it.

    A text without spans, null included, stays as it is.
    """
    cols = df.columns
    found = find(df, text, "__pii").withColumn("__pii", F.filter("__pii", lambda s: s["score"] >= least))
    found = found.withColumn("__reach", F.transform("__pii", lambda s: s["end"]))
    found = sp.running(found, {"__upto": "__reach"}, 0, F.greatest)
    spans, upto = F.col("__pii"), F.col("__upto")
    found = found.withColumns({"__text": F.when(F.size(spans) > 0, sp.blocks(F.col(text))), "__n": F.length(text).cast("bigint")})
    body, zero = F.col("__text"), F.lit(0).cast("bigint")
    before = lambda i: F.when(i > 0, F.get(upto, i - 1)).otherwise(zero)  # noqa: E731  how far the spans before reach
    tag = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    told = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(sp.piece(body, before(i), s["start"]), tag(s))).otherwise(""))
    told = F.concat(F.array_join(told, ""), sp.piece(body, F.element_at(upto, -1), F.col("__n")))
    return found.withColumn(text, F.when(F.size(spans) == 0, F.col(text)).otherwise(told)).select(*cols)


def query(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[sp.count_of(F.col("pii"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(sp.listed(F.col("pii"), BASE).cast("binary"), 256).alias("base_sha256"),
        sp.listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def oracle() -> str:
    """The same rows in DuckDB's SQL, whose patterns can't look behind: it states their plain forms."""
    number = "regexp_replace(h, '[^0-9]', '', 'g')"
    figure = f"TRY_CAST(substr({number}, i, 1) AS INT)"
    luhn = f"list_sum(list_transform(range(1, length({number}) + 1), lambda i: CASE WHEN (length({number}) - i) % 2 = 1 THEN CASE WHEN {figure} > 4 THEN 2 * {figure} - 9 ELSE 2 * {figure} END ELSE {figure} END)) % 10 = 0"
    bare = "replace(h, ' ', '')"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END"
    mod97 = f"length({bare}) BETWEEN 15 AND 34 AND list_reduce(list_prepend('0', string_split({bare}[5:] || {bare}[:4], '')), lambda a, c: CAST(TRY_CAST(a || {value} AS BIGINT) % 97 AS VARCHAR)) = '1'"
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(h, '.'), lambda q: NOT regexp_full_match(q, '0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])'))) = 0"),
        ("card", "[0-9](?:[ -]?[0-9])+", f"length({number}) BETWEEN 14 AND 19 AND {luhn}"),
        ("phone", PHONE, f"length({number}) BETWEEN 10 AND 15"),
        ("iban", IBAN, mod97),
    ]
    before = "lower(substr(t, greatest(x.s - 40, 0) + 1, least(x.s, 40)))"
    own = "CASE x.k " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCORES.items()) + " END"
    near = "CASE x.k " + " ".join(f"WHEN '{k}' THEN regexp_matches({before}, '{v}')" for k, v in CONTEXT.items()) + " END"
    scores = f"array_to_string(list_transform(a, lambda x: CAST(CAST(round({own} + CASE WHEN {near} THEN {BONUS} ELSE 0.0 END, 3) AS DOUBLE) AS VARCHAR)), ',')"
    return spans_sql("documents", rules, BASE, extra=f", {scores} AS scores")
