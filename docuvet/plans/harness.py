"""How catalogue entries are declared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by key, each with the SQL that an independent engine can run."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, key: str, tables: list[str], oracle: str | None = None):
        """Register a function of the named tables.

        Inside ``oracle``, ``@name`` stands for a derived table of that name.
        """

        def register(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(*[fixtures.load(spark, sf_dir, t) for t in tables])

            self.queries[key] = run
            if oracle is not None:
                self.oracles[key] = expand(oracle)
            return fn

        return register


def expand(sql: str) -> str:
    for name in sorted(fixtures.TEXTS, key=len, reverse=True):
        if f"@{name}" in sql:
            sql = sql.replace(f"@{name}", fixtures.oracle(name))
    return sql.strip()


def py_round(value: str, digits: int) -> str:
    """The oracle's exact-binary half-even rounding."""
    return f"(cast(format('{{:.{digits}f}}', cast({value} as double)) as double) + 0.0::double)"
