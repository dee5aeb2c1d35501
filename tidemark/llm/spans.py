"""Regular-expression spans of whole texts as native columns: arrays of (start, rank, end, kind) in code points.

Patterns are written so that they need no backtracking over long runs, and find the leftmost
non-overlapping matches of the plain patterns that the operators document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
FOUND = "array<struct<start:int,end:int,match:string,part:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches with their places: what stands between them, and they themselves, add up to the text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), part.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        found = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"), x["part"].alias("part"))
        out = F.when(x["match"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], found))
        return F.struct(end.alias("at"), out.cast(FOUND).alias("out"))

    places = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), places).otherwise(F.array().cast(FOUND))


def spans(found: Column, kind: str, rank: int, keep: Callable[[Column], Column] | None = None) -> Column:
    kept = F.filter(found, keep) if keep else found
    return F.transform(kept, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))).cast(SPAN)


def joined(columns: Iterable[Column]) -> Column:
    """Spans of several kinds by start, then by the rank of their kind."""
    return F.array_sort(F.concat(*columns))


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def listed(found: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(found: Column, others: Column, holders: tuple[str, ...] = ()) -> Column:
    """The spans that overlap none of the others; those of a kind in ``holders`` only must not lie wholly inside one."""

    def clash(s: Column, o: Column) -> Column:
        overlap = (s["start"] < o["end"]) & (o["start"] < s["end"])
        inside = (o["start"] <= s["start"]) & (s["end"] <= o["end"])
        return overlap & (~s["kind"].isin(*holders) | inside) if holders else overlap

    return F.filter(found, lambda s: ~F.exists(others, lambda o: clash(s, o)))


def masked(text: Column, found: Column, label: str) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``label``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(label))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] < acc["at"], acc["out"]).otherwise(new).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(found) > 0, F.aggregate(found, start, step, finish)).otherwise(text)
