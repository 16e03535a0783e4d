"""Coercion and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneleffect.functions import scalars as S


def safe_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Turn columns into doubles, 0.0 where missing or no number."""
    return df.withColumns({c: S.number(df, c) for c in columns})


def parse_time(df: DataFrame, column: str, drop_unparseable: bool = True) -> DataFrame:
    out = df.withColumn(column, S.time_or_null(df, column))
    return out.where(S.name(column).isNotNull()) if drop_unparseable else out


def filter_triangle(df: DataFrame, suggestion_type: str, action_type: str, outcome_type: str) -> DataFrame:
    """Rows of one (suggestion, action, outcome) type triple; reaches the scan as one predicate."""
    return df.where(
        (F.col("suggestion_type") == suggestion_type)
        & (F.col("action_type") == action_type)
        & (F.col("outcome_type") == outcome_type)
    )


def filter_period(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the half-open period [start, end); a missing bound is open."""
    if start:
        df = df.where(F.col(column) >= F.to_date(F.lit(start)))
    if end:
        df = df.where(F.col(column) < F.to_date(F.lit(end)))
    return df


def filter_all(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return reduce(DataFrame.where, conditions, df)


def all_null_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, all_null) from one pass."""
    names = list(columns or df.columns)
    counts = df.agg(*[(F.count(S.name(c)) == 0).alias(c) for c in names])
    return counts.unpivot([], names, "column", "all_null")


def numeric_null_to_zero(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Null and NaN become 0 in the numeric ones of the columns; text is left alone."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    return df.fillna(0, subset=numeric) if numeric else df
