"""The wide chain: roles → features → propensity → action effect → scenario → outcome effect → reports."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.config import Roles
from paneleffect.functions.skew import durable
from paneleffect.operators import encode, features, idmeans, models, rollups, scenario
from paneleffect.operators.roles import detect_roles, outcome_columns, roles_dict
from paneleffect.sources import sinks

PROPENSITY = "propensity_score_path_a"


@dataclass(frozen=True)
class WideRun:
    """Everything one run produces; frames are lazy over the stored scored panel."""

    roles: Roles
    scored: DataFrame
    feature_columns: list[str]
    auc: float
    channel_lift: DataFrame
    channel_monthly: DataFrame
    action_monthly: DataFrame
    outcome_monthly: DataFrame
    overall: DataFrame
    diagnostics: DataFrame
    variables: DataFrame
    models: dict[str, PipelineModel]
    setup: dict


def run(
    df: DataFrame,
    scenario_multiplier: float = 1.0,
    isolate_channel: str | None = None,
    leak_safe: bool = False,
    consistent: bool = False,
    encode_ids: bool | str = True,
    roles: Roles | None = None,
    model_params: Mapping | None = None,
) -> WideRun:
    """Estimate incremental actions and outcomes of a wide panel.

    The channel lift is taken before the multiplier and isolation, and the channel rollup weights
    the isolated effect by the share again; ``consistent`` uses the final effect, unweighted by a
    second share, for both. ``encode_ids=False`` leaves the customer and rep out of the one-hot
    features, for panels with more of them than a model can have positions; ``encode_ids="means"`` gives each
    three numbers instead, cross-fitted means of the action flag, the actions and the outcome.
    """
    if encode_ids not in (True, False, "means"):
        raise ValueError(f"encode_ids is True, False or 'means', not {encode_ids!r}.")
    roles = roles or detect_roles(df.columns)
    frame = features.build_features(df, roles, leak_safe, store=True)
    if encode_ids is not True:
        frame = replace(frame, categorical=tuple(c for c in frame.categorical if c not in (roles.hcp, roles.rep)))
    if encode_ids == "means":
        data, added = frame.data, []
        for c in (roles.hcp, roles.rep):
            means = idmeans.fit_id_means(data, c, ("treated_action", "action_total", outcome_columns(roles)[0]), (roles.hcp, roles.rep, roles.time))
            data, added = durable(idmeans.add_id_means(data, means)), [*added, *means.columns]
        frame = replace(frame, data=data, numeric=(*frame.numeric, *added))
    base = frame.data
    encoder = encode.fit_wide_encoder(base, frame.numeric, frame.categorical)
    labels = encoder.labels()
    # The propensity model leaves out its own label from the features.
    slim = "features_without_label"
    encoded = encode.encode_wide(base, encoder, {slim: ("treated_action",)})
    propensity = models.fit_logistic_propensity(encoded, "treated_action", slim, out=PROPENSITY)
    with_score = durable(encode.append_feature(propensity.data.drop(slim), PROPENSITY, "features_a"))
    action = models.fit_effects(
        with_score, {"action_total": "incremental_actions"}, "treated_suggestion", "features_a",
        config.ACTION_ARM_SEED, model_params,
    )
    channels = list(roles.actions)
    lift = rollups.channel_lift(action.data, "incremental_actions", channels)
    scaled = scenario.scale_effect(action.data, "incremental_actions", scenario_multiplier)
    chosen = durable(scenario.isolate_channel(scaled, "incremental_actions", isolate_channel, channels))

    trx, nbrx = outcome_columns(roles)
    targets = {trx: "incremental_trx"} if trx == nbrx else {trx: "incremental_trx", nbrx: "incremental_nbrx"}
    outcome = models.fit_effects(
        encode.append_feature(chosen, "incremental_actions", "features_b"), targets, "treated_action", "features_b",
        config.OUTCOME_ARM_SEED, model_params,
    )
    final = outcome.data if trx != nbrx else outcome.data.withColumn("incremental_nbrx", outcome.data["incremental_trx"])
    scored = durable(final.drop("features_a", "features_b", encode.FEATURES))

    isolated = bool(isolate_channel) and isolate_channel in channels
    if consistent and isolated:
        monthly = rollups.monthly_rollup(scored, roles.time, ["incremental_actions"])
        channel_monthly = scenario.stack({isolate_channel: monthly}, "channel")
        total = rollups.overall_lift(scored, ["incremental_actions"])
        lift = scenario.stack({isolate_channel: total.select(total["total"].alias("lift"))}, "channel")
    else:
        channel_monthly = rollups.channel_monthly_rollup(scored, roles.time, "incremental_actions", channels)
        if consistent:
            lift = rollups.channel_lift(scored, "incremental_actions", channels)
    return WideRun(
        roles=roles,
        scored=scored,
        feature_columns=labels,
        auc=propensity.auc,
        channel_lift=lift,
        channel_monthly=channel_monthly,
        action_monthly=rollups.monthly_rollup(scored, roles.time, ["incremental_actions"]),
        outcome_monthly=rollups.monthly_rollup(scored, roles.time, ["incremental_trx", "incremental_nbrx"]),
        overall=rollups.overall_lift(scored, ["incremental_actions", "incremental_trx", "incremental_nbrx"]),
        diagnostics=rollups.cohort_diagnostics(scored, len(labels)).withColumn("auc", F.lit(propensity.auc)),
        variables=rollups.variable_roles(df.sparkSession, roles, labels),
        models={**({"propensity": propensity.model} if propensity.model else {}), **action.models, **outcome.models},
        setup={
            "scenario_multiplier": float(scenario_multiplier), "isolate_channel": isolate_channel, "leak_safe": leak_safe, "consistent": consistent,
            "encode_ids": str(encode_ids),
        },
    )


def write(run: WideRun, folder: str) -> None:
    """Scored panel, rollups, diagnostics, summary and models under one folder."""
    spark = run.scored.sparkSession
    sinks.write_run_table(run.scored, f"{folder}/scored_output")
    sinks.write_rollup_csv(run.action_monthly, f"{folder}/path_a_monthly_rollup")
    sinks.write_rollup_csv(run.outcome_monthly, f"{folder}/path_b_monthly_rollup")
    sinks.write_rollup_csv(run.diagnostics, f"{folder}/path_a_diagnostics")
    plain = {"schema": roles_dict(run.roles), "auc": run.auc, "features": run.feature_columns, "setup": run.setup}
    tables = {
        "variables": run.variables,
        "overall": run.overall,
        "channel_lift": run.channel_lift,
        "channel_monthly_rollup": run.channel_monthly,
        "path_a_monthly_rollup": run.action_monthly,
        "path_b_monthly_rollup": run.outcome_monthly,
        "diagnostics": run.diagnostics,
    }
    sinks.write_summary(sinks.summary_frame(spark, plain, tables), f"{folder}/summary")
    for label, model in run.models.items():
        sinks.write_model(model, f"{folder}/models/{label}")
