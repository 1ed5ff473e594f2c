"""Personal data, with DataFrame functions alone.

Regular expressions propose spans, validators confirm them (octets of addresses, Luhn for cards, mod-97 for bank account
numbers, digit counts for phones), and words near a span adjust its score. The four base kinds keep every confirmed match;
the further kinds need a score of MIN_SCORE, which context words give or take.

Places are counted in code points, end exclusive: a text is split at a pattern and its matches are taken in order, so the
lengths of both give each match's place. Context words begin at a word's border, and those that lower a score are whole words.
A null text counts as empty and has no span. Each row is judged alone, so repeated rows have equal spans; spans of different kinds
may overlap, and ties of equal starts stay in the order of kinds. Whole texts of any length are searched. No rows give no rows.
Only doc_id and text are read, so further columns of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import load

#: Patterns. Possessive repeats and the guards before first characters keep matching linear and match the same spans.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "mac": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:])",
}
BASE = ("email", "ip", "card", "phone")
FURTHER = ("iban", "ssn", "mac")
#: What a text must hold before a pattern is tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-", "mac": ":"}
AT_LEAST = {"card": "[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]", "ip": r"[0-9]\.[0-9]"}
#: Score that a confirmed match starts with, words near it that raise the score, and words that lower it.
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "mac": 0.6}
CONTEXT = {
    "email": "e?mail|contact|write|address",
    "ip": r"ip\b|host|server|address|login",
    "card": "card|visa|master|credit|debit|pay",
    "phone": r"(?:tele)?phone|call|tel\b|mobile|fax|contact",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": r"ssn|social|security|tax\b",
    "mac": r"mac\b|device|hardware|ethernet",
}
AGAINST = "version|order|isbn|part no|example only|build"
REACH, RAISE, LOWER, MIN_SCORE = 40, 0.3, 0.3, 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, digits of the doubles summed; the sum must end in 0."""
    values = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _mod97(match: Column) -> Column:
    """The first four characters go to the end, letters become 10 to 35, and the number must leave 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "(?<=.)(?=.)")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """The confirmed matches: kind, start, end, score."""
    pattern = F.lit(PATTERNS[kind])
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["at"] + F.length(x["gap"])
        end = here + F.length(x["match"])
        return F.struct(F.coalesce(end, here).alias("at"), F.when(x["match"].isNotNull() & _confirmed(kind, x["match"]), F.concat(acc["found"], F.array(F.struct(here.alias("start"), end.alias("end"), x["match"].alias("match"))))).otherwise(acc["found"]).alias("found"))

    def scored(x: Column) -> Column:
        first = F.greatest(x["start"] - REACH, F.lit(0))
        near = F.lower(F.substr(text, first + 1, x["end"] + REACH - first))
        score = START[kind] + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), RAISE).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{AGAINST})\b"), LOWER).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    found = F.transform(F.aggregate(pairs, start, step, lambda acc: acc["found"]), scored)
    if kind in FURTHER:
        found = F.filter(found, lambda x: x["score"] >= MIN_SCORE)
    possible = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(possible & text.rlike(AT_LEAST.get(kind, PATTERNS[kind])), found).otherwise(none)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text and, for each kind, an array of its spans (kind, start, end, score). No shuffle, no Python."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({kind: _spans(kind, F.col("text")) for kind in PATTERNS})


def _joined(kinds: tuple[str, ...]) -> Column:
    parts = F.flatten(F.array(*[F.transform(k, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])) for k in kinds]))
    return F.array_join(parts, ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(load(spark, sf_dir, "documents"))
    every = F.flatten(F.array(*PATTERNS))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_joined(BASE).cast("binary"), 256).alias("base_sha256"), _joined(tuple(PATTERNS)).alias("spans"), F.aggregate(every, F.lit(0.0), lambda a, x: a + x["score"]).alias("total_score"))
