"""All catalogue entries in one place."""

from __future__ import annotations

from . import (
    catalogue_extract, catalogue_operations, catalogue_risk, catalogue_rules, catalogue_screening, catalogue_training,
)
from .harness import Query

CATALOGUES = [
    catalogue_extract.CATALOGUE, catalogue_rules.CATALOGUE, catalogue_risk.CATALOGUE,
    catalogue_operations.CATALOGUE, catalogue_training.CATALOGUE, catalogue_screening.CATALOGUE,
]


def queries() -> dict[str, Query]:
    return {k: q for c in CATALOGUES for k, q in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for c in CATALOGUES for k, s in c.oracles.items()}
