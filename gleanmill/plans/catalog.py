"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import cards, curation, evaluation, evidence, frames, ingest, material, memory, parts, relational, requirements, retrieval, scoring, stateful, text, writes  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "agg11_bm25_topk"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
