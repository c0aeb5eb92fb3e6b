"""Registry of the engine's queries and of the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir) -> DataFrame``; ``sql`` follows the fixture views of ``oracle``."""

    def put(f):
        from .oracle import VIEWS

        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            SQL[name] = f"WITH {VIEWS}{'' if body.startswith(',') else ''}{body}"
        return f

    return put


def r6(x: Column | str) -> Column:
    """Six decimals, without a negative zero: doubles whose last bits depend on the order of addition."""
    return F.round(F.expr(x) if isinstance(x, str) else x, 6) + F.lit(0.0)
