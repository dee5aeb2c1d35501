"""Registry of this subpackage's queries: a builder each, and its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import prepare

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Builder) -> Builder:
        QUERIES[name] = lambda spark, sf_dir: build(prepare(spark), sf_dir)
        if sql is not None:
            TWINS[name] = sql
        return build

    return register
