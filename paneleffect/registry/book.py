"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Book:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = " ".join(sql.split())
            return fn

        return register


BOOK = Book()


def r6(column: str | Column, decimals: int = 6) -> Column:
    """Six decimals, without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), decimals) + F.lit(0.0)


def shaped(
    df: DataFrame, texts: str = "", longs: str = "", doubles: str = "", flags: str = "", decimals: int = 6
) -> DataFrame:
    """Select columns with the types the comparison expects.

    ``decimals`` is raised where results are exact decimals with a 5 in the seventh place, for
    which the last bit of a sum would decide the rounding.
    """
    return df.select(
        *[F.col(c).cast("string").alias(c) for c in texts.split()],
        *[F.col(c).cast("bigint").alias(c) for c in longs.split()],
        *[r6(c, decimals).alias(c) for c in doubles.split()],
        *[F.col(c).cast("boolean").alias(c) for c in flags.split()],
    )
