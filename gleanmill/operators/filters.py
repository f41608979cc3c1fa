"""Filter plans: a whitelist of keys decides which of a request's filters apply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def plan(filters: dict, business: set[str], system: set[str] = frozenset()) -> tuple[dict, dict, list[str]]:
    """(business, system, ignored keys); values are trimmed, empty ones dropped, lists kept."""
    kept: tuple[dict, dict] = ({}, {})
    ignored = []
    for key, value in filters.items():
        values = [str(v).strip() for v in (value if isinstance(value, list | tuple | set) else [value]) if v is not None and str(v).strip()]
        if key not in business and key not in system:
            ignored.append(key)
        elif values:
            kept[key in system][key] = values
    return kept[0], kept[1], sorted(ignored)


def matches(filters: dict, business: set[str], system: set[str] = frozenset()) -> Column:
    """All filters hold; a list means any of it, and null equals the empty string."""
    own, forced, _ = plan(filters, business, system)
    tests = [F.coalesce(F.col(k).cast("string"), F.lit("")).isin(v) for k, v in {**own, **forced}.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def tenant_scope(filters: dict, user_id: str, business: set[str]) -> dict:
    """The business filters that the client sent, and the caller's own private data, whatever else it sent."""
    return plan(filters, business - {"userId", "visibilityScope"})[0] | {"userId": [user_id], "visibilityScope": ["private"]}


def scoped(scopes: list[tuple[str, str | None]]) -> Column:
    """Items of one of the scopes (type, id); of USER those without an id. Without a usable scope: all of USER."""
    own = [(F.col("scope_type") == "USER") & F.col("scope_id").isNull() if kind == "USER" else (F.col("scope_type") == kind) & (F.col("scope_id") == key) for kind, key in scopes if kind == "USER" or kind and key]
    return reduce(lambda a, b: a | b, own) if own else F.col("scope_type") == "USER"


def visible(now: Column, user_id=None, namespaces: list[str] | None = None, types: list[str] | None = None, scopes: list[tuple[str, str | None]] | None = None) -> Column:
    """Memory items of the user that are active, not deleted, still valid, not highly sensitive, and of the asked kinds and scopes."""
    tests = [F.col("status") == "ACTIVE", F.col("deleted_at").isNull(), F.col("valid_until").isNull() | (F.col("valid_until") > now), F.coalesce("sensitivity_level", F.lit("LOW")) != "HIGH"]
    if user_id is not None:
        tests.append(F.col("user_id") == user_id)
    tests += [F.col(c).isin(v) for c, v in (("namespace", namespaces), ("memory_type", types)) if v]
    if scopes is not None:
        tests.append(scoped(scopes))
    return reduce(lambda a, b: a & b, tests)
