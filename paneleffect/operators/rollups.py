"""Rollups, totals and diagnostics of scored panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.config import Roles
from paneleffect.functions import scalars as S
from paneleffect.operators.clean import parse_time
from paneleffect.operators.features import channel_shares


def monthly_rollup(df: DataFrame, time: str, columns: Sequence[str]) -> DataFrame:
    dated = parse_time(df, time)
    return dated.groupBy(S.month_label(S.name(time)).alias("month")).agg(*[F.sum(c).alias(c) for c in columns])


def _channel_sums(df: DataFrame, effect: str, channels: Sequence[str]) -> list[Column]:
    shares = channel_shares(df, channels)
    return [F.sum(F.col(effect) * shares[c]).alias(c) for c in channels]


def channel_monthly_rollup(
    df: DataFrame, time: str, effect: str, channels: Sequence[str], out: str = "incremental_actions"
) -> DataFrame:
    """(month, channel, total): summed wide per month, turned to rows after the aggregation."""
    dated = parse_time(df, time)
    wide = dated.groupBy(S.month_label(S.name(time)).alias("month")).agg(*_channel_sums(dated, effect, channels))
    return wide.unpivot(["month"], list(channels), "channel", out)


def channel_lift(df: DataFrame, effect: str, channels: Sequence[str]) -> DataFrame:
    """(channel, lift) over the whole panel."""
    return df.agg(*_channel_sums(df, effect, channels)).unpivot([], list(channels), "channel", "lift")


def overall_lift(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(measure, average, total)."""
    one = df.agg(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.avg(c).alias("average"), F.sum(c).alias("total")) for c in columns
    ]).alias("rows"))
    return one.select(F.inline("rows"))


def cohort_diagnostics(df: DataFrame, feature_count: int) -> DataFrame:
    """Cohort sizes of both paths, number of features, and the warning on few treated rows."""
    treated = F.count_if(F.col("treated_suggestion") == 1)
    return df.agg(
        treated.alias("treated_cohort_size"),
        F.count_if(F.col("treated_suggestion") == 0).alias("control_cohort_size"),
        F.count_if(F.col("treated_action") == 1).alias("treated_action_rows"),
        F.count_if(F.col("treated_action") == 0).alias("control_action_rows"),
        F.lit(feature_count).cast("bigint").alias("feature_count"),
        F.when(treated < config.LOW_TREATED_ROWS, "Low treated cohort size").otherwise("").alias("warning"),
    )


def totals_by(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Incremental totals per customer or per rep."""
    return df.groupBy(S.name(key).alias(key)).agg(*[F.sum(c).alias(c) for c in columns])


def reconciliation(before: DataFrame, after: DataFrame, column: str = "action_count") -> DataFrame:
    """(stage, total): the sum of a measure before and after a substitution."""
    parts = [
        frame.agg(F.sum(column).alias("total")).select(F.lit(stage).alias("stage"), "total")
        for stage, frame in (("original", before), ("modified", after))
    ]
    return parts[0].unionByName(parts[1])


def variable_roles(spark: SparkSession, roles: Roles, features: Sequence[str]) -> DataFrame:
    """(path, role, column): what feeds which model."""
    rows = [("A", "propensity_input", c) for c in features]
    rows += [("A", "treatment_effect_input", c) for c in (*features, "propensity_score_path_a")]
    rows += [("B", "outcome", c) for c in roles.outcomes]
    rows += [("B", "treatment_action_driver", c) for c in roles.actions]
    rows += [("B", "confounder_covariate", c) for c in features]
    return spark.createDataFrame(rows, "path string, role string, column string")
