"""Small frames made by rule."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

WIDE_SCHEMA = (
    "week_end_date timestamp, hcp_id string, rep_id string, suggestion_email string, suggestion_call bigint, "
    "action_email bigint, action_call bigint, trx bigint, nbrx bigint"
)


def wide_sample(spark: SparkSession, first_trx: int | None = None):
    """Twenty weekly rows with one text metric that holds a word."""
    emails, calls = ["1", "2", "bad", "4", "5"], [1, 0, 1, 0, 1]
    rows = []
    for i in range(20):
        trx = first_trx if i == 0 and first_trx is not None else 10 + i % 4
        rows.append(
            (
                datetime(2024, 1, 7) + timedelta(weeks=i),
                f"H{i % 5}",
                f"R{i % 3}",
                emails[i % 5],
                calls[i % 5],
                int(i % 3 == 0),
                int(i % 4 == 0),
                trx,
                5 + i % 3,
            )
        )
    return spark.createDataFrame(rows, WIDE_SCHEMA)


def planted(spark: SparkSession, effect: float, rows: int = 6000):
    """Treatment depends on x; it adds ``effect`` to the action, which counts three times in the outcome."""
    base = spark.range(rows, numPartitions=8).select(
        "id", F.randn(1).alias("x"), F.rand(2).alias("u"), F.randn(3).alias("e1"), F.randn(4).alias("e2")
    )
    treated = (F.col("u") < 1 / (1 + F.exp(-F.col("x")))).cast("int")
    action = 5 + F.col("x") + effect * treated + 0.3 * F.col("e1")
    return base.select(
        "id", "x", treated.alias("treated"), action.alias("action"), (3 * action + 0.3 * F.col("e2")).alias("outcome")
    )


def week(i: int) -> date:
    return date(2024, 1, 7) + timedelta(weeks=i)
