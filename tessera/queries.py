"""All registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from tessera.plans import activity, choice, identity, linkage, lookups, quality, records, scoring, search, streams, texts  # noqa: F401  registers
from tessera.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
