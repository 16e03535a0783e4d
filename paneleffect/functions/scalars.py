"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Java's parser reads "1d" and "2f" as numbers; a data value written so is text.
_JAVA_SUFFIX = r"[0-9.][dDfF]\s*$"

# Text layouts tried after ISO, in this order.
TIME_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm", "yyyy/M/d", "d-MMM-yyyy", "yyyyMMdd")


def name(column: str) -> Column:
    """Refer to a column whose name may hold dots."""
    return F.col(f"`{column}`")


def number_or_null(df: DataFrame, column: str) -> Column:
    """The value as a double; text that is no number, and NaN, become null."""
    kind = df.schema[column].dataType
    c = name(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        parsed = c.cast("double")
    elif isinstance(kind, T.StringType):
        parsed = F.when(~c.rlike(_JAVA_SUFFIX), c.try_cast("double"))
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(parsed), parsed)


def number(df: DataFrame, column: str) -> Column:
    """The value as a double, 0.0 where it is missing or no number."""
    return F.coalesce(number_or_null(df, column), F.lit(0.0))


def time_or_null(df: DataFrame, column: str, formats: Iterable[str] = TIME_FORMATS) -> Column:
    """The value as a timestamp; text that no known layout fits becomes null."""
    kind = df.schema[column].dataType
    c = name(column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    if isinstance(kind, T.StringType):
        text = F.trim(c)
        return F.coalesce(
            # A bare number is handled by the layouts, not read as a year.
            F.when(text.rlike(r"^\d{4}-\d"), F.try_to_timestamp(text)),
            *[F.try_to_timestamp(text, F.lit(f)) for f in formats],
        )
    if isinstance(kind, T.NumericType):
        return F.timestamp_micros((c / 1000).try_cast("bigint"))
    return F.lit(None).cast("timestamp")


def month_label(ts: Column) -> Column:
    """``'YYYY-MM'``."""
    return F.date_format(ts, "yyyy-MM")


def year_month_label(year: Column, month: Column) -> Column:
    """``'YYYY_MM'``."""
    return F.concat_ws("_", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def total(columns: Iterable[Column]) -> Column:
    """Sum across columns of one row, nulls as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns], F.lit(0.0))


def flag(column: Column) -> Column:
    """1 where the value is above 0, else 0."""
    return F.when(column > 0, 1).otherwise(0)


def clip_negative(column: Column) -> Column:
    """Negative values become 0; null stays null (``greatest`` would turn it into 0)."""
    return F.when(column < 0, F.lit(0.0)).otherwise(column)


def share(part: Column, whole: Column) -> Column:
    """part / whole with a zero denominator read as 1 and a missing result as 0."""
    return F.coalesce(part / F.when(whole == 0, F.lit(1.0)).otherwise(whole), F.lit(0.0))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0.0 where the denominator is 0 or missing."""
    return F.coalesce(top / F.when(bottom != 0, bottom), F.lit(0.0))


def significant(column: Column, digits: int = 14) -> Column:
    """A double to its first ``digits`` significant digits, at any magnitude.

    Sums that are equal but were added from different terms differ in their last bits; a tree would cut between
    them. Doubles carry 15 to 17 digits, so 14 leave room for the error of a short sum and for nothing else.
    """
    size = F.abs(column)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1.0) - F.floor(F.log10(size)))
    # 0, NaN and what is too large or too small to be scaled stay as they are.
    return F.when((size > 1e-280) & (size < 1e280), F.rint(column * scale) / scale).otherwise(column)
