"""Scenario edits of a panel, and the joins and unions that compare scenarios."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.functions import scalars as S
from paneleffect.functions import skew
from paneleffect.operators.clean import filter_period
from paneleffect.operators.features import channel_shares

CARRIED = ("suggestion_count", "suggestion_count_adstock", "percent_other_hcps_suggested")


def zero_suggestions(df: DataFrame) -> DataFrame:
    """Every column with 'suggest' in its name, but the suggestion type, becomes 0 of its own type."""
    hit = [c for c in df.columns if "suggest" in c and c != "suggestion_type"]
    return df.withColumns({c: F.lit(0).cast(df.schema[c].dataType) for c in hit})


def apply_theme(df: DataFrame, theme: str) -> DataFrame:
    """Suggestions of one theme only; the count before stays as ``total_suggestion_count``."""
    return df.withColumnRenamed("suggestion_count", "total_suggestion_count").withColumn(
        "suggestion_count",
        F.when(F.col("total_suggestion_count") > 0, S.name(theme)).otherwise(F.lit(0.0)),
    )


def unpivot_themes(df: DataFrame, themes: Sequence[str]) -> DataFrame:
    """All theme scenarios in one long frame, told apart by ``theme``, so that one scoring serves all.

    ``explode`` over a short literal list; no shuffle. The theme columns themselves stay.
    """
    pairs = F.array(
        *[F.struct(F.lit(t).alias("theme"), S.name(t).cast("double").alias("_value")) for t in themes]
    )
    long = df.withColumn("_pair", F.explode(pairs)).withColumnRenamed("suggestion_count", "total_suggestion_count")
    return long.withColumns(
        {
            "theme": F.col("_pair.theme"),
            "suggestion_count": F.when(F.col("total_suggestion_count") > 0, F.col("_pair._value")).otherwise(F.lit(0.0)),
        }
    ).drop("_pair")


def scale_effect(df: DataFrame, effect: str, multiplier: float) -> DataFrame:
    return df.withColumn(effect, F.col(effect) * F.lit(float(multiplier)))


def isolate_channel(df: DataFrame, effect: str, channel: str | None, channels: Sequence[str]) -> DataFrame:
    """Keep only the channel's share of the effect; a name that is no channel changes nothing."""
    if not channel or channel not in channels:
        return df
    return df.withColumn(effect, F.col(effect) * channel_shares(df, channels)[channel])


def _carried(df: DataFrame, columns: Sequence[str], suffix: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{suffix}") for c in columns if c in df.columns]


def factual_actions(
    scored: DataFrame, propensity_column: str | None = None, keys: Sequence[str] = config.PATH_A_KEYS
) -> DataFrame:
    """Keys, observed inputs as ``*_factual``, the non-negative prediction and the propensity."""
    extra = [F.col(propensity_column).alias("propensity")] if propensity_column else []
    return scored.select(
        *keys,
        *_carried(scored, (*CARRIED, "action_count"), "factual"),
        S.clip_negative(F.col("prediction")).alias("predicted_action_count"),
        *extra,
    )


def counterfactual_actions(scored: DataFrame, keys: Sequence[str] = config.PATH_A_KEYS) -> DataFrame:
    return scored.select(
        *keys,
        *_carried(scored, CARRIED, "counterfactual"),
        S.clip_negative(F.col("prediction")).alias("counterfactual_action_count"),
    )


def factual_outcomes(
    scored: DataFrame, propensity_column: str | None = None, keys: Sequence[str] = config.PATH_B_KEYS
) -> DataFrame:
    extra = [F.col(propensity_column).alias("propensity")] if propensity_column else []
    return scored.select(*keys, S.clip_negative(F.col("prediction")).alias("predicted_outcome_count"), *extra)


def counterfactual_outcomes(scored: DataFrame, keys: Sequence[str] = config.PATH_B_KEYS) -> DataFrame:
    return scored.select(*keys, S.clip_negative(F.col("prediction")).alias("counterfactual_outcome_count"))


def substitute_actions(
    df: DataFrame, actions: DataFrame, column: str, also_by: Sequence[str] = ()
) -> DataFrame:
    """Replace the observed action count by a predicted or counterfactual one, by rep × customer × week."""
    keys = [*config.PATH_A_KEYS, *also_by]
    slim = actions.select(*keys, F.col(column).alias("action_count"))
    return skew.left_join_unique(df.drop("action_count"), slim, keys)


def restore_spillover(df: DataFrame, actual: DataFrame | None) -> DataFrame:
    """Put the observed spillover share back into a counterfactual frame."""
    if actual is None:
        raise ValueError("The counterfactual frame needs the actual percent_other_hcps_suggested.")
    pattern = re.compile(r"^percent_other_hcps_suggested(_adstock)?$")
    slim = df.drop(*[c for c in df.columns if pattern.match(c)])
    keep = [c for c in actual.columns if c in config.PATH_A_KEYS or pattern.match(c)]
    return skew.left_join_unique(slim, actual.select(*keep), list(config.PATH_A_KEYS))


def join_actions(factual: DataFrame, counterfactual: DataFrame) -> DataFrame:
    return factual.join(counterfactual, list(config.PATH_A_KEYS), "inner")


def join_outcomes(factual: DataFrame, counterfactual: DataFrame, also_by: Sequence[str] = ()) -> DataFrame:
    return factual.join(counterfactual, [*config.PATH_B_KEYS, *also_by], "inner")


def per_outcome(df: DataFrame, outcome_types: Sequence[str] = config.OUTCOME_TYPES) -> DataFrame:
    """The same rows once per outcome type, from a literal list: the join below is not repeated."""
    return df.withColumn("outcome_type", F.explode(F.array(*[F.lit(o) for o in outcome_types])))


def incremental_actions(
    factual: DataFrame,
    counterfactual: DataFrame,
    start: str | None = None,
    end: str | None = None,
    theme_factual: DataFrame | None = None,
    outcome_types: Sequence[str] = config.OUTCOME_TYPES,
) -> DataFrame:
    """Predicted minus counterfactual actions in the study period, per outcome type and theme.

    ``theme_factual`` holds all themes in long form; the counterfactual is the same for each.
    """
    frames = factual.withColumn("theme", F.lit("all"))
    if theme_factual is not None:
        frames = frames.unionByName(theme_factual)
    joined = filter_period(join_actions(frames, counterfactual), config.WEEK, start, end)
    difference = F.col("predicted_action_count") - F.col("counterfactual_action_count")
    return per_outcome(joined.withColumn("incremental_action", difference), outcome_types)


def incremental_outcomes(
    factual: DataFrame,
    counterfactual: DataFrame,
    start: str | None = None,
    end: str | None = None,
    theme_factual: DataFrame | None = None,
) -> DataFrame:
    """Predicted minus counterfactual outcomes; both sides carry ``outcome_type``."""
    frames = factual.withColumn("theme", F.lit("all"))
    if theme_factual is not None:
        frames = frames.unionByName(theme_factual)
    joined = filter_period(join_outcomes(frames, counterfactual, ["outcome_type"]), config.WEEK, start, end)
    return joined.withColumn(
        "incremental_outcome", F.col("predicted_outcome_count") - F.col("counterfactual_outcome_count")
    )


def stack(frames: Mapping[str, DataFrame], column: str) -> DataFrame:
    """Union by name with the frame's name as a literal column."""
    out = None
    for label, frame in frames.items():
        part = frame.withColumn(column, F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out
