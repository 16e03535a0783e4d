"""The long chain: propensity and effect models of both paths, then incremental actions and outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.config import AdstockSpec, ModelConfig
from paneleffect.functions.skew import durable
from paneleffect.operators import grain, models, roles, scenario
from paneleffect.plans.recipes import Prepared, prepare

PROPENSITY_A = "propensity_score_path_A_suggestion_count"
PROPENSITY_B = "propensity_score_path_B_action_count"


@dataclass(frozen=True)
class Fitted:
    """One trained model with its training frame's encoder and scored rows."""

    config: ModelConfig
    encoder: PipelineModel
    model: PipelineModel
    scored: DataFrame | None


@dataclass(frozen=True)
class FitsA:
    """Path A's models and scores, before any scenario."""

    propensity: Fitted
    effect: Fitted
    scores: DataFrame


@dataclass(frozen=True)
class PathA:
    propensity: Fitted
    effect: Fitted
    scores: DataFrame
    factual: DataFrame
    counterfactual: DataFrame
    theme_factual: DataFrame | None
    incremental: DataFrame


@dataclass(frozen=True)
class PathB:
    propensity: dict[str, Fitted]
    effect: dict[str, Fitted]
    factual: DataFrame
    counterfactual: DataFrame
    theme_factual: DataFrame | None
    incremental: DataFrame


def _fit(prepared: Prepared, model: ModelConfig, kind: str, params: Mapping | None) -> Fitted:
    scored, fitted = models.fit_score(prepared.data, config.MODEL_LABELS[model.model_type], kind=kind, params=params)
    return Fitted(model, prepared.encoder, fitted, scored)


def model_config(
    model_type: str,
    suggestion_type: str,
    action_type: str,
    outcome_type: str,
    start: str | None = None,
    end: str | None = None,
    adstock: Mapping[str, AdstockSpec] | None = None,
) -> ModelConfig:
    column = PROPENSITY_A if model_type.startswith("PathA") else PROPENSITY_B
    return ModelConfig(
        suggestion_type, action_type, outcome_type, column, model_type,
        start_date=start, end_date=end, adstock_params=dict(adstock) if adstock else None,
    )


def fit_propensity_a(df: DataFrame, effect_config: ModelConfig, kind: str = "GBTRegressor", params: Mapping | None = None) -> Fitted:
    """Path A's first model alone."""
    first = replace(effect_config, model_type="PathA_PropensityModel", adstock_params=None)
    return _fit(prepare(df, first), first, kind, params)


def fit_path_a(
    df: DataFrame, effect_config: ModelConfig, kind: str = "GBTRegressor", params: Mapping | None = None, propensity: Fitted | None = None
) -> FitsA:
    """Path A's models without its scenarios; a given propensity model is not fitted again."""
    propensity = propensity or fit_propensity_a(df, effect_config, kind, params)
    scores = durable(models.propensity_scores(propensity.scored, propensity.model, effect_config.propensity_column))
    grain.assert_unique(scores, config.PATH_A_KEYS)
    return FitsA(propensity, _fit(prepare(df, effect_config, scores), effect_config, kind, params), scores)


def run_path_a(
    df: DataFrame,
    effect_config: ModelConfig,
    theme_run: bool = False,
    keep_actual_spillover: bool = False,
    kind: str = "GBTRegressor",
    params: Mapping | None = None,
    fits: FitsA | None = None,
) -> PathA:
    """Suggestion → action. Scenario frames go through the same recipe with the fitted encoder. ``fits`` are the
    models of the same rows and config where they are fitted already."""
    fits = fits or fit_path_a(df, effect_config, kind, params)
    propensity, effect, scores = fits.propensity, fits.effect, fits.scores
    column = effect_config.propensity_column

    factual = durable(scenario.factual_actions(effect.scored, column))
    actual = None
    if keep_actual_spillover:
        actual = effect.scored.select(*config.PATH_A_KEYS, "percent_other_hcps_suggested")
    zeroed = prepare(scenario.zero_suggestions(df), effect_config, scores, effect.encoder, actual)
    counterfactual = durable(scenario.counterfactual_actions(models.score(zeroed.data, effect.model)))

    theme_factual = None
    themes = roles.theme_columns(df.columns, effect_config.suggestion_type) if theme_run else []
    if themes:
        long = prepare(scenario.unpivot_themes(df, themes), effect_config, scores, effect.encoder, also_by=["theme"])
        theme_factual = durable(
            scenario.factual_actions(models.score(long.data, effect.model), column, [*config.PATH_A_KEYS, "theme"])
        )
    incremental = scenario.incremental_actions(
        factual, counterfactual, effect_config.start_date, effect_config.end_date, theme_factual
    )
    return PathA(propensity, effect, scores, factual, counterfactual, theme_factual, incremental)


def run_path_b(
    df: DataFrame,
    path_a: PathA,
    effect_config: ModelConfig,
    outcome_types: Sequence[str] = config.OUTCOME_TYPES,
    kind: str = "GBTRegressor",
    params: Mapping | None = None,
    overrides: Mapping[str, str] | None = None,
) -> PathB:
    """Action → outcome, from predicted actions on the factual side and counterfactual ones on the other.

    The counterfactual has no suggestion of any theme, so it is computed once per outcome and
    serves every theme.
    """
    propensity, effect = {}, {}
    factual, counterfactual, theme_factual = {}, {}, {}
    suggestion = effect_config.suggestion_type
    themes = path_a.theme_factual is not None

    def one(outcome: str) -> None:
        cfg = replace(effect_config, outcome_type=outcome)
        first = replace(cfg, model_type="PathB_PropensityModel", adstock_params=None)
        propensity[outcome] = _fit(prepare(df, first, overrides=overrides), first, kind, params)
        column = cfg.propensity_column
        scores = durable(models.propensity_scores(propensity[outcome].scored, propensity[outcome].model, column))
        effect[outcome] = _fit(prepare(df, cfg, scores, overrides=overrides), cfg, kind, params)

        def scored(frame: DataFrame, also_by: Sequence[str] = ()) -> DataFrame:
            ready = prepare(frame, cfg, scores, effect[outcome].encoder, also_by=also_by, overrides=overrides)
            return models.score(ready.data, effect[outcome].model).withColumn("outcome_type", F.lit(outcome))

        keys = [*config.PATH_B_KEYS, "outcome_type"]
        rows = grain.dedupe_non_personal(df, suggestion)
        predicted = scenario.substitute_actions(rows, path_a.factual, "predicted_action_count")
        factual[outcome] = scenario.factual_outcomes(scored(predicted), column, keys)

        zero = grain.dedupe_non_personal(scenario.zero_suggestions(df), suggestion)
        without = scenario.substitute_actions(zero, path_a.counterfactual, "counterfactual_action_count")
        counterfactual[outcome] = scenario.counterfactual_outcomes(scored(without), keys)

        if themes:
            names = roles.theme_columns(df.columns, suggestion)
            long = scenario.unpivot_themes(rows, names)
            swapped = scenario.substitute_actions(long, path_a.theme_factual, "predicted_action_count", ["theme"])
            theme_factual[outcome] = scenario.factual_outcomes(scored(swapped, ["theme"]), column, [*keys, "theme"])

    models.side_by_side(df.sparkSession, one, list(outcome_types))

    def union(frames: dict[str, DataFrame]) -> DataFrame:
        return durable(reduce(DataFrame.unionByName, [frames[o] for o in outcome_types]))

    fact, counter = union(factual), union(counterfactual)
    theme_fact = union(theme_factual) if themes else None
    incremental = scenario.incremental_outcomes(
        fact, counter, effect_config.start_date, effect_config.end_date, theme_fact
    )
    return PathB(propensity, effect, fact, counter, theme_fact, incremental)


def path_a(
    df: DataFrame,
    suggestion_type: str,
    action_type: str,
    start: str | None = None,
    end: str | None = None,
    theme_run: bool = False,
    adstock: Mapping[str, AdstockSpec] | None = config.DEFAULT_ADSTOCK,
    **how,
) -> PathA:
    """Path A alone. It is fitted on the rows of the first outcome type: its inputs do not depend
    on the outcome. ``how`` are further arguments of ``run_path_a``."""
    effect = model_config("PathA_TreatmentEffectModel", suggestion_type, action_type, config.OUTCOME_TYPES[0], start, end, adstock)
    return run_path_a(df, effect, theme_run, **how)


def run(
    df: DataFrame,
    suggestion_type: str,
    action_type: str,
    start: str | None = None,
    end: str | None = None,
    theme_run: bool = False,
    adstock: Mapping[str, AdstockSpec] | None = config.DEFAULT_ADSTOCK,
    kind: str = "GBTRegressor",
    params: Mapping | None = None,
    overrides: Mapping[str, str] | None = None,
    keep_actual_spillover: bool = False,
) -> tuple[PathA, PathB]:
    """The full chain. ``keep_actual_spillover`` leaves the observed share of a rep's other customers in
    path A's counterfactual rows, whose own suggestions are zero."""
    a = path_a(
        df, suggestion_type, action_type, start, end, theme_run, adstock, kind=kind, params=params, keep_actual_spillover=keep_actual_spillover
    )
    b_config = model_config("PathB_TreatmentEffectModel", suggestion_type, action_type, config.OUTCOME_TYPES[0], start, end, adstock)
    return a, run_path_b(df, a, b_config, kind=kind, params=params, overrides=overrides)
