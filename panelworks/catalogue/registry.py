"""Registration of queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows can be checked."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that the order of summation does not show."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: tidy(F.col(c), digits) for c in doubles}) if doubles else df


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded value without negative zero."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)
