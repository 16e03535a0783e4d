"""Reports on stored results and fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.functions import scalars as S
from paneleffect.operators.clean import filter_all
from paneleffect.operators.encode import FEATURES, feature_labels


def _calendar(week: str) -> dict[str, Column]:
    return {"year": F.year(week), "month": F.month(week)}


def observed_vs_incremental(
    observed: DataFrame,
    outcome: DataFrame,
    action: DataFrame,
    observed_filters: Sequence[Column] = (),
    result_filters: Sequence[Column] = (),
    dimensions: dict[str, Column] | None = None,
) -> DataFrame:
    """Observed, predicted and incremental outcomes and actions per dimension, year and month by default.

    Each side is aggregated before the join, so the join is as small as the report.
    ``result_filters`` restrict both result tables, for example to one outcome type and theme.
    """
    by = dimensions or _calendar(config.WEEK)
    keys = [c.alias(n) for n, c in by.items()]

    def totals(df: DataFrame, filters: Sequence[Column], sums: dict[str, str]) -> DataFrame:
        return filter_all(df, filters).groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])

    left = totals(observed, observed_filters, {"observed_outcome": "outcome_count", "observed_action": "action_count"})
    middle = totals(
        outcome, result_filters, {"incremental_outcome": "incremental_outcome", "predicted_outcome": "predicted_outcome_count"}
    )
    right = totals(
        action, result_filters, {"incremental_action": "incremental_action", "predicted_action": "predicted_action_count"}
    )
    return left.join(middle, list(by), "inner").join(right, list(by), "inner")


def theme_summary(outcome: DataFrame, action: DataFrame, compat: bool = False) -> DataFrame:
    """(theme, incremental_outcome, incremental_action).

    Action rows repeat per outcome type; by default one copy is summed, ``compat`` sums all.
    """
    if not compat:
        action = action.where(F.col("outcome_type") == config.OUTCOME_TYPES[0])
    outcomes = outcome.groupBy("theme").agg(F.sum("incremental_outcome").alias("incremental_outcome"))
    actions = action.groupBy("theme").agg(F.sum("incremental_action").alias("incremental_action"))
    return outcomes.join(actions, "theme", "full_outer")


def actual_vs_predicted(summary: DataFrame, kind: str = "outcome") -> DataFrame:
    """(year_month, actual, predicted) of the outcome or the action."""
    return summary.select(
        S.year_month_label(F.col("year"), F.col("month")).alias("year_month"),
        F.col(f"observed_{kind}").alias("actual"),
        F.col(f"predicted_{kind}").alias("predicted"),
    )


def fit_line(pairs: DataFrame, x: str = "actual", y: str = "predicted") -> DataFrame:
    """Least-squares line of predicted on actual."""
    return pairs.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def summary_long(summary: DataFrame) -> DataFrame:
    """The summary in long form: (year, month, year_month, variable, value)."""
    values = [c for c in summary.columns if c not in ("year", "month")]
    doubles = summary.select("year", "month", *[F.col(c).cast("double").alias(c) for c in values])
    return doubles.unpivot(["year", "month"], values, "variable", "value").withColumn(
        "year_month", S.year_month_label(F.col("year"), F.col("month"))
    )


def rank_by(df: DataFrame, value: str, label: str, descending: bool = True) -> DataFrame:
    """Order by value, ties by label."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return df.orderBy(order, F.col(label).asc())


def importances(spark: SparkSession, encoder: PipelineModel, model: PipelineModel) -> DataFrame:
    """(feature_name, importance), largest first."""
    stage = model.stages[-1]
    if not hasattr(stage, "featureImportances"):
        raise ValueError(f"{type(stage).__name__} has no importances.")
    pairs = list(zip(feature_labels(encoder), stage.featureImportances.toArray().tolist(), strict=True))
    return rank_by(spark.createDataFrame(pairs, "feature_name string, importance double"), "importance", "feature_name")


def contributions(spark: SparkSession, encoder: PipelineModel, model: PipelineModel) -> DataFrame:
    """(feature, contribution), smallest first: coefficients of linear models, importances of trees."""
    stage = model.stages[-1]
    kind = type(stage).__name__
    if kind in ("LogisticRegressionModel", "LinearRegressionModel"):
        values = stage.coefficients.toArray().tolist()
    elif kind == "GBTRegressionModel":
        values = stage.featureImportances.toArray().tolist()
    else:
        raise ValueError(f"Unsupported model type: {kind}")
    labels = feature_labels(encoder)
    if len(labels) != len(values):
        raise ValueError(f"{len(values)} contributions for {len(labels)} features.")
    pairs = spark.createDataFrame(list(zip(labels, values)), "feature string, contribution double")
    return rank_by(pairs, "contribution", "feature", descending=False)


def flat_stages(encoder: PipelineModel, model: PipelineModel) -> list:
    """The stages that explain a model: indexers, the assembler, the fitted estimator."""
    kept = [s for s in encoder.stages if isinstance(s, (StringIndexerModel, VectorAssembler))]
    return [*kept, model.stages[-1]]


def model_matrix(
    encoded: DataFrame,
    encoder: PipelineModel,
    keys: Sequence[str] = (),
    filters: Sequence[Column] = (),
    order_by: Sequence[Column] = (),
) -> DataFrame:
    """Keys as text and one double column per feature, by name."""
    rows = filter_all(encoded, filters)
    if order_by:
        rows = rows.orderBy(*order_by)
    values = vector_to_array(F.col(FEATURES))
    return rows.select(
        *[F.col(k).cast("string").alias(k) for k in keys],
        *[values[i].alias(label) for i, label in enumerate(feature_labels(encoder))],
    )
