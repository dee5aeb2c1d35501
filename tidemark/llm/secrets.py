"""Secret scans with multipart credential linking, in native columns and joins only.

Base kinds are reported wherever they stand.  Weak candidates (a user name, an endpoint, an opaque
string) say nothing alone; they are reported when the parts that make them a usable credential
stand within ``SCOPE`` characters, which an interval join over cells of that length finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, unused
from tidemark.llm.registry import query
from tidemark.llm.spans import SPAN, apart, count, joined, listed, masked, matches, spans
from tidemark.session import cut_lineage

#: Characters between two parts of one credential.
SCOPE = 256
# Patterns of the base kinds.  A shorter run of the last two kinds cannot hide a longer one.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
# Patterns of the weak kinds.
USER = r"""(?i)\b(?:user(?:_?name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
ENDPOINT = r"""(?i)\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+"""
OPAQUE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
RANKS = {k: i for i, k in enumerate(("assign", "access", "hex", "user", "endpoint", "opaque"))}
#: Kinds that may carry base spans inside, such as an address with its token.
HOLDERS = ("endpoint",)
IDENTIFIERS, SECRETS = ("access", "user"), ("assign", "hex", "opaque")


def base_spans(text: Column) -> Column:
    return joined([
        spans(matches(text, ASSIGN, 2), "assign", RANKS["assign"], lambda m: F.length(m["part"]) >= LEAST_ASSIGNED),
        spans(matches(text, ACCESS), "access", RANKS["access"]),
        spans(matches(text, HEX), "hex", RANKS["hex"]),
    ])


def weak_spans(text: Column) -> Column:
    """Candidates; an opaque string mixes upper and lower case."""
    return joined([
        spans(matches(text, USER), "user", RANKS["user"]),
        spans(matches(text, ENDPOINT), "endpoint", RANKS["endpoint"]),
        spans(matches(text, OPAQUE), "opaque", RANKS["opaque"], lambda m: m["match"].rlike("[a-z]") & m["match"].rlike("[A-Z]")),
    ])


def span_key(doc_id: str, text: str) -> tuple[Column, Column]:
    """Two columns that tell rows apart; rows equal in both are copies and have the same spans."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, span_id, span_hash, base, weak): what the patterns propose in every whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    span_id, span_hash = span_key(doc_id, text)
    found = docs.select(F.col(doc_id).alias("doc_id"), span_id.alias("span_id"), span_hash.alias("span_hash"),
                        base_spans(whole).alias("base"), weak_spans(whole).alias("weak"))
    return found.withColumn("weak", apart(F.col("weak"), F.col("base"), HOLDERS))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(span_id, span_hash, linked spans): the weak candidates whose complementary parts are in reach."""
    key = ["span_id", "span_hash", "cell"]
    parts = found.where(F.size("weak") > 0).select(
        "span_id", "span_hash", F.explode(F.concat("base", "weak")).alias("s")).select("span_id", "span_hash", "s.*").distinct()
    first, last = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    stored = parts.withColumn("cell", F.explode(F.sequence(first, last)))
    asked = parts.where(F.col("kind").isin("user", "endpoint", "opaque")).withColumn(
        "cell", F.explode(F.sequence(first - 1, last + 1)))

    def near(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        others = stored.where(F.col("kind").isin(*kinds)).select(
            *key, F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("kind").alias("o_kind"))
        on = [rows[c] == others[c] for c in key]
        gap = F.greatest("start", "o_start") - F.least("end", "o_end") <= scope
        own = (F.col("start") == F.col("o_start")) & (F.col("kind") == F.col("o_kind"))
        return rows.join(others, [*on, gap, ~own], "left_semi")

    def of(kind: str) -> DataFrame:
        return asked.where(F.col("kind") == kind)

    plain = ["span_id", "span_hash", "start", "rank", "end", "kind"]
    opaque = near(of("opaque"), IDENTIFIERS).select(plain)
    user = near(of("user"), SECRETS).select(plain)
    # An endpoint needs both parts, each in reach, if in different cells.
    endpoint = near(of("endpoint"), IDENTIFIERS).select(plain).intersect(near(of("endpoint"), SECRETS).select(plain))
    together = opaque.union(user).union(endpoint).distinct()
    return together.groupBy("span_id", "span_hash").agg(
        F.collect_list(F.struct("start", "rank", "end", "kind")).cast(SPAN).alias("linked"))


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, spans): base spans, and all spans with the linked weak ones, of every whole text.

    Spans are (start, rank, end, kind) in code points, end exclusive, by start and then kind.  A null
    text counts as empty and has none.  Repeated rows come back as often as they occur; rows with a
    null id are scanned like any other.  Weak candidates that overlap a base span are left out,
    but for endpoints, which may carry base spans and link with them.
    """
    found = cut_lineage(candidates(docs, doc_id, text))
    result = found.join(linked(found, scope), ["span_id", "span_hash"], "left")
    extra = F.coalesce("linked", F.array().cast(SPAN))
    return result.select("doc_id", "base", joined([F.col("base"), extra]).alias("spans"))


def redacted(docs: DataFrame, label: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of its text replaced; n_chars follows where there is such a column.

    A null text stays null.  All other columns and all rows stay as they are.
    """
    pairs = linked(cut_lineage(candidates(docs)), scope)
    names = [unused(docs, n) for n in ("span_id", "span_hash", "linked", "all_spans")]
    on_id, on_hash, extra, found = names
    span_id, span_hash = span_key("doc_id", "text")
    rows = docs.withColumns({on_id: span_id, on_hash: span_hash}).join(pairs.toDF(on_id, on_hash, extra), [on_id, on_hash], "left")
    whole = F.coalesce("text", F.lit(""))
    rows = rows.withColumn(found, joined([base_spans(whole), F.coalesce(F.col(extra), F.array().cast(SPAN))]))
    rows = rows.withColumn("text", F.when(F.col("text").isNotNull(), masked(whole, F.col(found), label)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return rows.select(docs.columns)


@query("op7_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("base")
    return secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
