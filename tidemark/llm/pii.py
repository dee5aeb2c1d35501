"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score; native columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.registry import query
from tidemark.llm.spans import apart, count, joined, listed, matches, spans

# The base kinds.  Runs are entered at their start only (or right after a match), and
# held on to, so that no text makes the search go back over a run again and again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Further kinds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
RANKS = {k: i for i, k in enumerate(("email", "ip", "card", "phone", "iban", "national", "local_phone"))}
#: Score of a confirmed span without context, what a context word adds, and the score from which a span is reported.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national": 0.3, "local_phone": 0.3}
CONTEXT_BONUS, REPORTED, CONTEXT = 0.3, 0.5, 48
# Context words of each kind, in lower case.
CONTEXT_WORDS = {
    "email": "e-?mail|mail|contact", "ip": "ip|host|server|address", "card": "card|visa|mastercard|credit|payment",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account", "national": "ssn|social|security|tax",
    "local_phone": "phone|tel|call|mobile|fax",
}


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right counts double, nine less where that has two digits; the sum ends in zero."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def mod97(code: Column) -> Column:
    """First four characters moved to the end, letters as 10 to 35: the number leaves 1 modulo 97."""
    plain = F.regexp_replace(code, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def small_parts(address: Column) -> Column:
    """All parts of an address are at most 255, leading zeros aside."""
    return F.forall(F.split(address, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> Column:
    n = lambda m: F.length(digits(m["match"]))
    return joined([
        spans(matches(text, EMAIL), "email", RANKS["email"]),
        spans(matches(text, IP), "ip", RANKS["ip"], lambda m: small_parts(m["match"])),
        spans(matches(text, CARD), "card", RANKS["card"], lambda m: luhn(digits(m["match"]))),
        spans(matches(text, PHONE), "phone", RANKS["phone"], lambda m: n(m).between(10, 15)),
    ])


def more_spans(text: Column) -> Column:
    return joined([
        spans(matches(text, IBAN), "iban", RANKS["iban"], lambda m: mod97(m["match"])),
        spans(matches(text, NATIONAL), "national", RANKS["national"]),
        spans(matches(text, LOCAL_PHONE), "local_phone", RANKS["local_phone"]),
    ])


def scored(text: Column, found: Column) -> Column:
    """Spans (start, rank, end, kind, score): the kind's score, more if one of its context words stands near."""

    def one(s: Column) -> Column:
        at = F.greatest(s["start"] - CONTEXT, F.lit(0))
        near = F.lower(F.concat_ws(" ", F.substring(text, at + 1, s["start"] - at), F.substring(text, s["end"] + 1, F.lit(CONTEXT))))
        score = F.lit(0.0)
        for kind, words in CONTEXT_WORDS.items():
            bonus = F.when(F.regexp_like(near, F.lit(rf"\b(?:{words})\b")), CONTEXT_BONUS).otherwise(0.0)
            score = F.when(s["kind"] == kind, F.least(F.lit(1.0), F.lit(SCORES[kind]) + bonus)).otherwise(score)
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
                        F.round(score, 6).alias("score"))

    return F.transform(found, one)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): spans (start, rank, end, kind) of every whole text; those in ``spans`` also have a score.

    ``base`` holds what the base patterns find and their validators confirm; all of it is in
    ``spans``, which adds further kinds that reach the reported score and overlap no base span.
    Places are code points, end exclusive.  Null texts count as empty and have no spans; rows with
    null ids and repeated rows are scanned like any other.  Nothing is shuffled.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("whole"), base_spans(whole).alias("base"), more_spans(whole).alias("more"))
    added = F.filter(scored(F.col("whole"), apart(F.col("more"), F.col("base"))), lambda s: s["score"] >= REPORTED)
    return found.select("doc_id", "base", joined([scored(F.col("whole"), F.col("base")), added]).alias("spans"))


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("base")
    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(base, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
