"""Registration of queries: a name, a function of (spark, sf_dir), and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, as sums of them depend on order."""
    return df.select(*[F.round(f"`{n}`", digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])
