"""Registered queries: a table is written, read back and compared with what was computed."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneleffect import config
from paneleffect.functions.skew import shared_folder
from paneleffect.operators import models, roles, rollups, scenario
from paneleffect.plans import lift
from paneleffect.registry import panels as P
from paneleffect.registry.book import BOOK, shaped
from paneleffect.registry.effects import _EFFECT, _FACT, _effect
from paneleffect.registry.learning import _PREDICTED, linear
from paneleffect.sources import sinks, tables

_KEY = "rep_id, customer_id, CAST(week_end_date AS VARCHAR) AS week"


def _place(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid4().hex}"


def _week(df):
    return df.withColumn("week", F.col("week_end_date"))


@BOOK.add(
    "s1_read_run_table",
    f"WITH {P.PREDICTIONS} SELECT {_KEY}, ROUND({_FACT}, 6) AS predicted_action_count, ROUND(propensity_a, 6) AS propensity FROM af",
)
def s1_read_run_table(spark, sf):
    folder = _place(spark, "runs")
    fact = scenario.factual_actions(P.actions_factual(spark, sf), "propensity_a")
    first = F.col("week_end_date") < F.to_date(F.lit("1996-01-01"))
    sinks.write_run_table(fact.where(first), f"{folder}/predicted-a")
    sinks.write_run_table(fact.where(~first), f"{folder}/predicted-b")
    return shaped(_week(tables.read_run_table(spark, f"{folder}/predicted-*")), "rep_id customer_id week", doubles="predicted_action_count propensity")


@BOOK.add(
    "s2_read_keyed_table",
    f"""WITH {P.LONG} SELECT {_KEY}, suggestion_count FROM (SELECT rep_id, customer_id, week_end_date,
      CASE WHEN suggestion_count > 0 THEN theme_o_qualified ELSE 0.0 END AS suggestion_count FROM long
      WHERE outcome_type = 'nbrx' AND suggestion_type = 'call')""",
)
def s2_read_keyed_table(spark, sf):
    folder = _place(spark, "keyed")
    panel = P.long(spark, sf).where(F.col("suggestion_type") == "call")
    sinks.write_keyed_table(scenario.unpivot_themes(panel, ["theme_f_qualified", "theme_o_qualified"]), folder)
    out = tables.read_keyed_table(spark, folder, "nbrx", "theme_o_qualified")
    return shaped(_week(out), "rep_id customer_id week", doubles="suggestion_count")


@BOOK.add("s3_propensity_sink", f"WITH {P.PREDICTIONS} SELECT {_KEY}, propensity_a FROM af")
def s3_propensity_sink(spark, sf):
    folder = _place(spark, "propensity")
    sinks.write_propensity(P.actions_factual(spark, sf), "propensity_a", folder)
    return shaped(_week(tables.read_run_table(spark, folder)), "rep_id customer_id week", doubles="propensity_a")


@BOOK.add("s4_model_round_trip", f"{_PREDICTED} prediction FROM path_a, g")
def s4_model_round_trip(spark, sf):
    folder = _place(spark, "model")
    _, encoded, _, model = linear(spark, sf)
    sinks.write_model(model, folder)
    return shaped(_week(models.score(encoded, sinks.read_model(folder))), "rep_id customer_id week", doubles="prediction")


@BOOK.add(
    "s5_rollup_csv",
    f"WITH {_EFFECT} SELECT month_label AS month, ROUND(SUM(incremental_actions), 6) AS incremental_actions FROM effect GROUP BY 1",
)
def s5_rollup_csv(spark, sf):
    folder = _place(spark, "rollup")
    sinks.write_rollup_csv(rollups.monthly_rollup(_effect(spark, sf), "week_end_date", ["incremental_actions"]), folder)
    back = spark.read.option("header", True).schema("month string, incremental_actions double").csv(folder)
    return shaped(back, "month", doubles="incremental_actions")


_DIAGNOSED = """(VALUES ('treated_cohort_size'), ('control_cohort_size'), ('treated_action_rows'), ('control_action_rows')) m(measure)"""


@BOOK.add(
    "s6_summary_json",
    f"""WITH {_EFFECT}, shares AS (SELECT *, action_email / denom AS e, action_call / denom AS c FROM effect),
      f AS (SELECT *, CAST(suggestion_total > 0 AS INT) AS ts, CAST(action_total > 0 AS INT) AS ta FROM effect)
      SELECT 'overall' AS block, 'incremental_actions' AS label, ROUND(SUM(incremental_actions), 6) + 0.0 AS value FROM effect
      UNION ALL SELECT 'channel_lift', 'action_email', ROUND(SUM(incremental_actions * e), 6) + 0.0 FROM shares
      UNION ALL SELECT 'channel_lift', 'action_call', ROUND(SUM(incremental_actions * c), 6) + 0.0 FROM shares
      UNION ALL SELECT 'path_a_monthly_rollup', month_label, ROUND(SUM(incremental_actions), 6) + 0.0 FROM effect GROUP BY month_label
      UNION ALL SELECT 'diagnostics', measure, CAST(CASE measure WHEN 'treated_cohort_size' THEN SUM(ts) WHEN 'control_cohort_size' THEN SUM(1 - ts)
        WHEN 'treated_action_rows' THEN SUM(ta) ELSE SUM(1 - ta) END AS DOUBLE) FROM f CROSS JOIN {_DIAGNOSED} GROUP BY measure
      UNION ALL SELECT 'setup', 'scenario_multiplier', CAST(1.5 AS DOUBLE)
      UNION ALL SELECT 'schema', 'suggestions', CAST(2 AS DOUBLE)""",
)
def s6_summary_json(spark, sf):
    """The summary written as one JSON text, parsed back by its schema into the rows of its blocks."""
    folder = _place(spark, "summary")
    effect = _effect(spark, sf)
    tables_in = {
        "overall": rollups.overall_lift(effect, ["incremental_actions"]),
        "channel_lift": rollups.channel_lift(effect, "incremental_actions", ["action_email", "action_call"]),
        "path_a_monthly_rollup": rollups.monthly_rollup(effect, "week_end_date", ["incremental_actions"]),
        "diagnostics": rollups.cohort_diagnostics(effect, 3),
    }
    plain = {"schema": roles.roles_dict(P.DENSE_ROLES), "setup": {"scenario_multiplier": 1.5}}
    sinks.write_summary(sinks.summary_frame(spark, plain, tables_in), folder)
    kinds = "schema struct<suggestion_cols: array<string>>, setup struct<scenario_multiplier: double>"
    one = sinks.read_summary(spark, folder, sinks.summary_schema(tables_in, T.StructType.fromDDL(kinds)))
    rows = {
        "overall": one.select(F.inline("overall")).select(F.col("measure").alias("label"), F.col("total").alias("value")),
        "channel_lift": one.select(F.inline("channel_lift")).toDF("label", "value"),
        "path_a_monthly_rollup": one.select(F.inline("path_a_monthly_rollup")).toDF("label", "value"),
        "diagnostics": one.select(F.inline("diagnostics")).unpivot([], ["treated_cohort_size", "control_cohort_size", "treated_action_rows", "control_action_rows"], "label", "value").withColumn("value", F.col("value").cast("double")),
        "setup": one.select(F.lit("scenario_multiplier").alias("label"), F.col("plain.setup.scenario_multiplier").alias("value")),
        "schema": one.select(F.lit("suggestions").alias("label"), F.size("plain.schema.suggestion_cols").cast("double").alias("value")),
    }
    return shaped(scenario.stack(rows, "block"), "block label", doubles="value")


@BOOK.add("s7_load_panel", f"WITH {P.DENSE} SELECT hcp_id, rep_id, CAST(week_end_date AS VARCHAR) AS week, suggestion_call, trx FROM dense")
def s7_load_panel(spark, sf):
    """The panel as CSV, loaded with inferred types and detected roles."""
    folder = _place(spark, "panel")
    P.dense(spark, sf).write.option("header", True).csv(folder)
    df, found = tables.load_panel_with_roles(spark, folder, "csv")
    out = df.withColumn("week", F.date_format(found.time, "yyyy-MM-dd"))
    return shaped(out, f"{found.hcp} {found.rep} week", found.suggestions[1], found.outcomes[0])


@BOOK.add(
    "s8_model_config",
    f"""WITH {P.LONG} SELECT {_KEY}, outcome_count FROM long WHERE suggestion_type = 'call' AND action_type = 'call' AND outcome_type = 'nbrx'
      AND week_end_date >= DATE '1995-01-01' AND week_end_date < DATE '1996-01-07'""",
)
def s8_model_config(spark, sf):
    """A stored config, read back, selects the rows of its model."""
    from paneleffect.operators.clean import filter_period, filter_triangle

    folder = _place(spark, "config")
    cfg = lift.model_config("PathB_TreatmentEffectModel", "call", "call", "nbrx", "1995-01-01", "1996-01-07", config.DEFAULT_ADSTOCK)
    sinks.write_model_config(spark, cfg, folder)
    back = tables.read_model_config(spark, folder)
    rows = filter_triangle(P.long(spark, sf), back.suggestion_type, back.action_type, back.outcome_type)
    out = filter_period(rows, config.WEEK, back.start_date, back.end_date)
    return shaped(_week(out), "rep_id customer_id week", doubles="outcome_count")


@BOOK.add("s9_master_panel", f"WITH {P.LONG} SELECT {_KEY}, suggestion_type, outcome_type, suggestion_count FROM long")
def s9_master_panel(spark, sf):
    folder = _place(spark, "master")
    sinks.write_run_table(P.long(spark, sf), folder)
    out = tables.read_master_panel(spark, "brand_x", {"brand_x": folder})
    return shaped(_week(out), "rep_id customer_id week suggestion_type outcome_type", doubles="suggestion_count")
