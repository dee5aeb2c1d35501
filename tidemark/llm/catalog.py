"""All queries of the subpackage."""

from __future__ import annotations

from tidemark.llm import (  # noqa: F401
    bpe, embeddings, language, licenses, merkle, mixing, pii, quality, ranking, repair, secrets, simhash, toxicity,
)
from tidemark.llm.registry import QUERIES, TWINS


def builders():
    return dict(QUERIES)


def twins():
    return dict(TWINS)
