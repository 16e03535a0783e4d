"""Fitting and scoring with distributed ML, and the metrics of a fit."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import inf

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.functions import scalars as S
from paneleffect.operators.encode import FEATURES

ESTIMATORS = {
    "LogisticRegression": LogisticRegression,
    "LinearRegression": LinearRegression,
    "GBTRegressor": GBTRegressor,
}
# Shape of one arm of the effect learners.
ARM_PARAMS = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}
PARALLEL_FITS = 4


def fit_model(
    df: DataFrame,
    label: str,
    kind: str = "GBTRegressor",
    features: str = FEATURES,
    seed: int = config.MODEL_SEED,
    params: Mapping | None = None,
) -> PipelineModel:
    """Fit one estimator; the seed goes only to those that take one."""
    if kind not in ESTIMATORS:
        raise ValueError(f"Unsupported model: {kind}")
    estimator = ESTIMATORS[kind](featuresCol=features, labelCol=label, **(params or {}))
    if estimator.hasParam("seed"):
        estimator = estimator.setSeed(seed)
    return Pipeline(stages=[estimator]).fit(df)


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(df)


def add_propensity(scored: DataFrame, model: PipelineModel, column: str) -> DataFrame:
    """Propensity column: class-1 probability of a classifier, else the prediction."""
    kind = type(model.stages[-1]).__name__
    if kind == "LogisticRegressionModel":
        return scored.withColumn(column, vector_to_array("probability")[1])
    if kind in ("LinearRegressionModel", "GBTRegressionModel"):
        return scored.withColumn(column, F.col("prediction"))
    raise ValueError(f"No propensity rule for {kind}.")


def propensity_scores(scored: DataFrame, model: PipelineModel, column: str) -> DataFrame:
    """The score table: panel keys that are present, and the propensity."""
    keys = [k for k in config.PATH_A_KEYS if k in scored.columns]
    return add_propensity(scored, model, column).select(*keys, column)


def fit_score(df: DataFrame, label: str, **how) -> tuple[DataFrame, PipelineModel]:
    model = fit_model(df, label, **how)
    return score(df, model), model


def round_predictions(df: DataFrame, column: str = "prediction", out: str = "rounded_prediction") -> DataFrame:
    return df.withColumn(out, F.round(column))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and weighted precision, recall and F1 from the confusion counts; 0.0 with no rows.

    Rows are counted per (label, prediction) first, so all that follows is as small as the number
    of classes squared.
    """
    cells = df.groupBy(F.col(label).cast("double").alias("l"), F.col(prediction).cast("double").alias("p")).count()
    by_label = cells.groupBy("l").agg(
        F.sum("count").alias("actual"), F.sum(F.when(F.col("l") == F.col("p"), F.col("count")).otherwise(0)).alias("hit")
    )
    by_prediction = cells.groupBy(F.col("p").alias("l")).agg(F.sum("count").alias("predicted"))
    per_class = by_label.join(by_prediction, "l", "left")
    precision = S.safe_ratio(F.col("hit"), F.coalesce(F.col("predicted"), F.lit(0)))
    recall = S.safe_ratio(F.col("hit"), F.col("actual"))
    f1 = S.safe_ratio(2 * precision * recall, precision + recall)
    rows = F.sum("actual")
    return per_class.agg(
        S.safe_ratio(F.sum("hit"), rows).alias("accuracy"),
        S.safe_ratio(F.sum(precision * F.col("actual")), rows).alias("precision"),
        S.safe_ratio(F.sum(recall * F.col("actual")), rows).alias("recall"),
        S.safe_ratio(F.sum(f1 * F.col("actual")), rows).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str, score_column: str) -> float:
    """Exact area under the ROC curve; 0.5 when only one class occurs."""
    classes = df.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
    if classes["low"] == classes["high"]:
        return 0.5
    slim = df.select(F.col(label).cast("double").alias("label"), F.col(score_column).cast("double").alias("score"))
    # No binning: the cumulative counts are computed per range partition of the sorted scores.
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(slim)


@dataclass(frozen=True)
class PropensityFit:
    data: DataFrame
    model: PipelineModel | None
    auc: float


def fit_logistic_propensity(
    df: DataFrame,
    label: str = "treated_action",
    features: str = FEATURES,
    out: str = "propensity_score_path_a",
    max_iter: int = 1000,
    tol: float = 1e-6,
) -> PropensityFit:
    """P(label | features) by logistic regression with unit ridge weight on the summed loss.

    The loss here is a mean over n rows, hence the weight 1 / n. With a single class there is
    nothing to fit: the score is that class and the AUC 0.5.
    """
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("low"), F.max(label).alias("high")).first()
    if facts["low"] == facts["high"]:
        return PropensityFit(df.withColumn(out, F.lit(float(facts["low"] or 0))), None, 0.5)
    params = {"maxIter": max_iter, "tol": tol, "regParam": 1.0 / facts["n"], "elasticNetParam": 0.0, "standardization": False}
    model = fit_model(df, label, "LogisticRegression", features, params=params)
    scored = add_propensity(model.transform(df), model, out)
    return PropensityFit(scored.drop("rawPrediction", "probability", "prediction"), model, roc_auc(scored, label, out))


def score_equations(
    df: DataFrame,
    model: PipelineModel | None,
    label: str,
    names: Sequence[str],
    features: str = FEATURES,
    probability: str = "propensity_score_path_a",
    ridge: float = 1.0,
) -> DataFrame:
    """Per position of a logistic fit, and ``(intercept)``: what its score equation leaves over.

    At the optimum Σ (label − probability) · feature = ridge · coefficient, without ridge for the intercept.
    The two weighted sums of the sparse feature vectors are merged partition by partition, so
    nothing but a few vectors of the model's width is moved. ``remainder`` is per row.

    Without a model, that is with a single class, the coefficients are 0 and the intercept is the infinite one
    whose logistic function is that class; the equations are summed all the same.
    """
    y, p = F.col(label).cast("double"), F.col(probability)
    of = Summarizer.metrics("sum")
    # Both weights are one larger, which cancels: the summarizer refuses weights that are all 0.
    sums = df.agg(of.summary(F.col(features), y + 1).alias("y"), of.summary(F.col(features), p + 1).alias("p"), F.sum(y).alias("y0"), F.sum(p).alias("p0"), F.count(F.lit(1)).alias("n")).first()
    if model is None:
        intercept, coefficients = (inf if sums["p0"] > 0 else -inf), np.zeros(len(names))
    else:
        intercept, coefficients = model.stages[-1].intercept, model.stages[-1].coefficients.toArray()
    left = sums["y"]["sum"].toArray() - sums["p"]["sum"].toArray() - ridge * coefficients
    rows = [("(intercept)", intercept, sums["y0"] - sums["p0"])]
    rows += list(zip(names, coefficients.tolist(), left.tolist(), strict=True))
    spark = df.sparkSession
    return spark.createDataFrame([(name, b, r / sums["n"]) for name, b, r in rows], "feature string, coefficient double, remainder double")


def arm_facts(df: DataFrame, treatment: str, outcomes: Sequence[str]) -> dict:
    """Rows and mean outcomes of both arms, in one aggregate."""
    treated = F.col(treatment) == 1
    # A missing flag counts as not treated.
    control = ~F.coalesce(treated, F.lit(False))
    aggregates = [F.count_if(treated).alias("treated"), F.count_if(control).alias("control")]
    for i, c in enumerate(outcomes):
        aggregates += [
            F.avg(F.when(treated, S.name(c))).alias(f"t{i}"),
            F.avg(F.when(control, S.name(c))).alias(f"c{i}"),
        ]
    return df.agg(*aggregates).first().asDict()


def arm_mean_effect(facts: dict, position: int) -> float:
    """Difference of arm means, not below 0; an empty arm has mean 0."""
    return max((facts[f"t{position}"] or 0.0) - (facts[f"c{position}"] or 0.0), 0.0)


@dataclass(frozen=True)
class EffectFit:
    data: DataFrame
    models: dict[str, PipelineModel]


def side_by_side(spark: SparkSession, work: Callable, items: Sequence, parallelism: int = PARALLEL_FITS) -> list:
    """Run independent fits at the same time. A boosted fit is a long row of short jobs, so one
    alone leaves most of a cluster idle between them."""
    with ThreadPoolExecutor(max(1, min(parallelism, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def fit_effects(
    df: DataFrame,
    outcomes: Mapping[str, str],
    treatment: str,
    features: str = FEATURES,
    seed: int = config.ACTION_ARM_SEED,
    params: Mapping | None = None,
    parallelism: int = PARALLEL_FITS,
) -> EffectFit:
    """T-learner: one boosted model per arm and outcome; effect = max(0, treated − control).

    ``outcomes`` maps outcome column to the name of its effect column. With an empty arm the
    effect is the difference of arm means on every row. Both models score every row. An arm of one row
    is a single leaf; its categories are taken as numbers, since the library asks for as many rows as
    a category has values before it looks for a cut.
    """
    columns = list(outcomes)
    facts = arm_facts(df, treatment, columns)
    if not facts["treated"] or not facts["control"]:
        constants = {outcomes[c]: F.lit(arm_mean_effect(facts, i)) for i, c in enumerate(columns)}
        return EffectFit(df.withColumns(constants), {})
    treated = F.coalesce(F.col(treatment) == 1, F.lit(False))
    arms = {"treated": df.where(treated), "control": df.where(~treated)}

    def fit(task: tuple[str, str]) -> PipelineModel:
        c, arm = task
        estimator = GBTRegressor(
            featuresCol=features, labelCol=c, predictionCol=f"_{arm}", seed=seed, **{**ARM_PARAMS, **(params or {})}
        )
        vector = F.col(features).alias(features, metadata={}) if facts[arm] < 2 else F.col(features)
        return Pipeline(stages=[estimator]).fit(arms[arm].select(vector, S.name(c).cast("double").alias(c)))

    tasks = [(c, arm) for c in columns for arm in arms]
    fitted = dict(zip(tasks, side_by_side(df.sparkSession, fit, tasks, parallelism)))
    out = df
    for c in columns:
        for arm in arms:
            out = fitted[(c, arm)].transform(out)
        out = out.withColumn(outcomes[c], S.clip_negative(F.col("_treated") - F.col("_control"))).drop("_treated", "_control")
    return EffectFit(out, {f"{c}_{arm}": m for (c, arm), m in fitted.items()})
