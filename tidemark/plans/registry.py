"""Query registry: every query is a DataFrame builder, most with an SQL twin.

Values are compared across engines, whose sums differ in the last bits; doubles are therefore
settled (stepped off exact ties, then rounded) on both sides by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.exprs import settled
from tidemark.session import tune

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None


QUERIES: dict[str, Query] = {}


def settle(df: DataFrame, keys: list[str], doubles: list[str], digits: int) -> DataFrame:
    return df.select(*keys, *[settled(c, digits).alias(c) for c in doubles])


def query(name: str, keys: list[str], doubles: list[str] | None = None, source: str | None = None,
          ctes: str = "", digits: int = 4):
    """Register a builder.  ``source`` is what the SQL twin selects the same columns from."""
    doubles = doubles or []

    def register(build: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return settle(build(tune(spark), sf_dir), keys, doubles, digits)

        sql = None
        if source is not None:
            columns = [*keys, *[f"round({c} + 1e-7, {digits}) AS {c}" for c in doubles]]
            sql = f"{'WITH ' + ctes if ctes else ''}\nSELECT {', '.join(columns)}\nFROM {source}"
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(run, sql)
        return build

    return register
