"""Preparation of the long panel per model type, from the raw panel to the encoded frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from paneleffect import config
from paneleffect.config import ModelConfig
from paneleffect.functions.skew import durable_for_fitting
from paneleffect.operators import adstock, encode, grain, roles, scenario, spillover
from paneleffect.operators.clean import filter_period, filter_triangle


@dataclass(frozen=True)
class Prepared:
    """An encoded frame and the encoder that made it, to be reused for scenario frames."""

    data: DataFrame
    encoder: PipelineModel


def smelt(
    df: DataFrame,
    model: ModelConfig,
    scores: DataFrame | None = None,
    actual_spillover: DataFrame | None = None,
    also_by: Sequence[str] = (),
    overrides: Mapping[str, str] | None = None,
) -> DataFrame:
    """The model type's own steps: dedupe or collapse, propensity scores, spillover, activity."""
    path_b = model.model_type.startswith("PathB")
    effect = model.model_type.endswith("TreatmentEffectModel")
    if path_b:
        out = grain.collapse_reps(roles.drop_rep_covariates(df), overrides, also_by)
    else:
        out = grain.dedupe_non_personal(df, model.suggestion_type, also_by)
    if not effect:
        return out
    if scores is None:
        raise ValueError(f"{model.model_type} needs the propensity scores.")
    out = grain.attach_propensity(out, scores, model.propensity_column, check_unique=False)
    if path_b:
        return out
    out = spillover.percent_other_suggested(out, also_by=also_by)
    if actual_spillover is not None:
        out = scenario.restore_spillover(out, actual_spillover)
    return spillover.global_index(out, "action_count", also_by=also_by)


def prepare(
    df: DataFrame,
    model: ModelConfig,
    scores: DataFrame | None = None,
    encoder: PipelineModel | None = None,
    actual_spillover: DataFrame | None = None,
    also_by: Sequence[str] = (),
    from_start_date: bool = False,
    overrides: Mapping[str, str] | None = None,
) -> Prepared:
    """Triple → study end → model steps → carry-over → encode → study start if asked.

    The start date is applied last, since carry-over needs the weeks before it. A given encoder is
    reused: scenario frames must be scaled like the frame the model was fitted on.
    """
    rows = filter_triangle(df, model.suggestion_type, model.action_type, model.outcome_type)
    rows = filter_period(rows, config.WEEK, None, model.end_date)
    rows = roles.drop_excluded_covariates(rows, model.suggestion_type, model.action_type)
    path_b = model.model_type.startswith("PathB")
    # The model steps keep the grain or make it unique, so it is looked at on the plain rows.
    unique = path_b or (bool(model.adstock_params) and grain.is_unique(rows, [*config.PATH_A_KEYS, *also_by]))
    rows = smelt(rows, model, scores, actual_spillover, also_by, overrides)
    if model.adstock_params:
        keys = [config.CUSTOMER, *also_by] if path_b else [config.REP, config.CUSTOMER, *also_by]
        rows = adstock.add_adstock(rows, keys, model.adstock_params, unique_grain=unique)
    if encoder is None:
        # Selection, encoder and model fits each read the rows: compute them once.
        rows = durable_for_fitting(rows)
        chosen = encode.select_features(rows, config.FEATURE_PATTERNS[model.model_type])
        encoder = encode.fit_encoder(rows, chosen)
    encoded = encode.encode(rows, encoder)
    if from_start_date:
        encoded = filter_period(encoded, config.WEEK, model.start_date, None)
    return Prepared(encoded, encoder)
