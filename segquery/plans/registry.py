"""Queries by name with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str, name: str | None = None) -> Column:
    """A double rounded to six digits."""
    out = F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)
    return out.alias(name or (c if isinstance(c, str) else "value"))


def rounded(df: DataFrame) -> DataFrame:
    """All doubles of a result rounded to six digits, so sums in another order compare equal."""
    return df.select(*[r6(n) if k in ("double", "float") else F.col(n) for n, k in df.dtypes])
