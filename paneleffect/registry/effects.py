"""Registered queries: scenarios, incremental tables, rollups and reports.

The effect of a row is plain arithmetic here (0.25 per suggestion, less 0.5, not below 0), so
every table operator is checked without a model in between.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paneleffect.functions import scalars as S
from paneleffect import config
from paneleffect.operators import features, models, report, rollups, scenario
from paneleffect.registry import panels as P
from paneleffect.registry.book import BOOK, r6, shaped

R = P.DENSE_ROLES
START, END = "1994-01-02", "1997-06-01"
_KEY_D = "hcp_id, rep_id, CAST(week_end_date AS VARCHAR) AS week"
_KEY_L = "rep_id, customer_id, CAST(week_end_date AS VARCHAR) AS week"
_PERIOD = f"week_end_date >= DATE '{START}' AND week_end_date < DATE '{END}'"


def _week(df):
    return df.withColumn("week", F.col("week_end_date"))


def _effect(spark, sf):
    panel = features.add_totals_and_flags(P.dense(spark, sf), R)
    raw = F.col("suggestion_total") * 0.25 - 0.5
    return panel.withColumns(
        {
            "raw_effect": raw,
            "incremental_actions": S.clip_negative(raw),
            "incremental_trx": F.col("action_total") * 0.5,
            "incremental_nbrx": F.col("action_total") * 0.125,
        }
    )


_EFFECT = f"""{P.TOTALS}, effect AS (SELECT *, suggestion_total * 0.25 - 0.5 AS raw_effect,
  CASE WHEN suggestion_total * 0.25 - 0.5 < 0 THEN 0.0 ELSE suggestion_total * 0.25 - 0.5 END AS incremental_actions,
  action_total * 0.5 AS incremental_trx, action_total * 0.125 AS incremental_nbrx,
  CASE WHEN action_total = 0 THEN 1 ELSE action_total END AS denom FROM totals)"""


@BOOK.add("p9_scenario_multiplier", f"WITH {_EFFECT} SELECT {_KEY_D}, ROUND(incremental_actions * 1.5, 6) AS incremental_actions FROM effect")
def p9_scenario_multiplier(spark, sf):
    out = scenario.scale_effect(_effect(spark, sf), "incremental_actions", 1.5)
    return shaped(_week(out), "hcp_id rep_id week", doubles="incremental_actions")


@BOOK.add(
    "p10_isolate_channel",
    f"WITH {_EFFECT} SELECT {_KEY_D}, ROUND(incremental_actions * action_call / denom, 6) AS incremental_actions FROM effect",
)
def p10_isolate_channel(spark, sf):
    out = scenario.isolate_channel(_effect(spark, sf), "incremental_actions", "action_call", R.actions)
    out = scenario.isolate_channel(out, "incremental_actions", "no such channel", R.actions)
    return shaped(_week(out), "hcp_id rep_id week", doubles="incremental_actions")


@BOOK.add(
    "p11_zero_suggestions",
    f"""WITH {P.LONG} SELECT {_KEY_L}, suggestion_type, outcome_type, CAST(0.0 AS DOUBLE) AS suggestion_count, action_count FROM long""",
)
def p11_zero_suggestions(spark, sf):
    out = scenario.zero_suggestions(P.long(spark, sf))
    return shaped(_week(out), "rep_id customer_id week suggestion_type outcome_type", doubles="suggestion_count action_count")


@BOOK.add(
    "p12_theme_scenario",
    f"""WITH {P.LONG} SELECT {_KEY_L}, suggestion_type, outcome_type, suggestion_count AS total_suggestion_count,
      CASE WHEN suggestion_count > 0 THEN theme_f_qualified ELSE 0.0 END AS suggestion_count FROM long""",
)
def p12_theme_scenario(spark, sf):
    out = scenario.apply_theme(P.long(spark, sf), "theme_f_qualified")
    return shaped(_week(out), "rep_id customer_id week suggestion_type outcome_type", doubles="total_suggestion_count suggestion_count")


@BOOK.add(
    "p12_theme_scenarios_long",
    f"""WITH {P.LONG} SELECT {_KEY_L}, suggestion_type, outcome_type, 'theme_f_qualified' AS theme,
        CASE WHEN suggestion_count > 0 THEN theme_f_qualified ELSE 0.0 END AS suggestion_count FROM long
      UNION ALL SELECT {_KEY_L}, suggestion_type, outcome_type, 'theme_o_qualified',
        CASE WHEN suggestion_count > 0 THEN theme_o_qualified ELSE 0.0 END FROM long""",
)
def p12_theme_scenarios_long(spark, sf):
    out = scenario.unpivot_themes(P.long(spark, sf), ["theme_f_qualified", "theme_o_qualified"])
    return shaped(_week(out), "rep_id customer_id week suggestion_type outcome_type theme", doubles="suggestion_count")


@BOOK.add(
    "p13_non_negative_prediction",
    f"WITH {P.PREDICTIONS} SELECT {_KEY_L}, ROUND(CASE WHEN prediction < 0 THEN 0.0 ELSE prediction END, 6) AS prediction FROM af",
)
def p13_non_negative_prediction(spark, sf):
    out = P.actions_factual(spark, sf).withColumn("prediction", S.clip_negative(F.col("prediction")))
    return shaped(_week(out), "rep_id customer_id week", doubles="prediction")


@BOOK.add("p14_clip_effect", f"WITH {_EFFECT} SELECT {_KEY_D}, ROUND(raw_effect, 6) AS raw_effect, ROUND(incremental_actions, 6) AS incremental_actions FROM effect")
def p14_clip_effect(spark, sf):
    return shaped(_week(_effect(spark, sf)), "hcp_id rep_id week", doubles="raw_effect incremental_actions")


_FACT = "CASE WHEN prediction < 0 THEN 0.0 ELSE prediction END"


@BOOK.add(
    "p15_factual_projection",
    f"""WITH {P.PREDICTIONS} SELECT {_KEY_L}, suggestion_count AS suggestion_count_factual, action_count AS action_count_factual,
      ROUND({_FACT}, 6) AS predicted_action_count, ROUND(propensity_a, 6) AS propensity FROM af""",
)
def p15_factual_projection(spark, sf):
    out = scenario.factual_actions(P.actions_factual(spark, sf), "propensity_a")
    doubles = "suggestion_count_factual action_count_factual predicted_action_count propensity"
    return shaped(_week(out), "rep_id customer_id week", doubles=doubles)


@BOOK.add(
    "p15_counterfactual_projection",
    f"""WITH {P.PREDICTIONS} SELECT {_KEY_L}, suggestion_count AS suggestion_count_counterfactual, ROUND({_FACT}, 6) AS counterfactual_action_count FROM ac""",
)
def p15_counterfactual_projection(spark, sf):
    out = scenario.counterfactual_actions(P.actions_counterfactual(spark, sf))
    return shaped(_week(out), "rep_id customer_id week", doubles="suggestion_count_counterfactual counterfactual_action_count")


@BOOK.add("p17_round_prediction", f"WITH {P.PREDICTIONS} SELECT {_KEY_L}, ROUND(prediction) AS rounded_prediction FROM af")
def p17_round_prediction(spark, sf):
    out = models.round_predictions(P.actions_factual(spark, sf))
    return shaped(_week(out), "rep_id customer_id week", doubles="rounded_prediction")


_SCORES = f"""{P.PREDICTIONS},
  fa AS (SELECT rep_id, customer_id, week_end_date, suggestion_count AS s_fact, {_FACT} AS predicted, propensity_a AS propensity FROM af),
  ca AS (SELECT rep_id, customer_id, week_end_date, {_FACT} AS counterfactual FROM ac),
  fb AS (SELECT customer_id, week_end_date, outcome_type, {_FACT} AS predicted FROM bf),
  cb AS (SELECT customer_id, week_end_date, outcome_type, {_FACT} AS counterfactual FROM bc),
  themed AS (SELECT * FROM (SELECT rep_id, customer_id, week_end_date, t.theme, action_count * 0.75 - 1.0 + 0.5 * CASE WHEN suggestion_count <= 0 THEN 0.0
      WHEN t.theme = 'theme_f_qualified' THEN theme_f_qualified ELSE theme_o_qualified END AS prediction FROM path_a
      CROSS JOIN (VALUES ('theme_f_qualified'), ('theme_o_qualified')) t(theme))),
  fa_all AS (SELECT rep_id, customer_id, week_end_date, 'all' AS theme, predicted FROM fa
    UNION ALL SELECT rep_id, customer_id, week_end_date, theme, {_FACT} FROM themed),
  inc_a AS (SELECT rep_id, customer_id, week_end_date, theme, outcome_type, predicted, counterfactual, predicted - counterfactual AS incremental
    FROM fa_all JOIN ca USING (rep_id, customer_id, week_end_date) CROSS JOIN (VALUES ('nbrx'), ('trx')) o(outcome_type) WHERE {_PERIOD}),
  fb_all AS (SELECT customer_id, week_end_date, outcome_type, 'all' AS theme, predicted FROM fb
    UNION ALL SELECT customer_id, week_end_date, outcome_type, t.theme, CASE WHEN prediction - t.less < 0 THEN 0.0 ELSE prediction - t.less END
      FROM bf CROSS JOIN (VALUES ('theme_f_qualified', 0.5), ('theme_o_qualified', 0.75)) t(theme, less)),
  inc_b AS (SELECT customer_id, week_end_date, outcome_type, theme, predicted, counterfactual, predicted - counterfactual AS incremental
    FROM fb_all JOIN cb USING (customer_id, week_end_date, outcome_type) WHERE {_PERIOD})"""


def _theme_actions(spark, sf):
    long = scenario.unpivot_themes(P.path_a_panel(spark, sf), ["theme_f_qualified", "theme_o_qualified"])
    scored = long.withColumns(
        {
            "prediction": F.col("action_count") * 0.75 - 1.0 + 0.5 * F.col("suggestion_count"),
            "propensity_a": F.col("total_suggestion_count") * 0.25,
        }
    )
    return scenario.factual_actions(scored, "propensity_a", ["rep_id", "customer_id", "week_end_date", "theme"])


def _theme_outcomes(spark, sf):
    parts = {
        theme: P.outcomes_factual(spark, sf).withColumn("prediction", F.col("prediction") - less)
        for theme, less in (("theme_f_qualified", 0.5), ("theme_o_qualified", 0.75))
    }
    stacked = scenario.stack(parts, "theme")
    return scenario.factual_outcomes(stacked, "propensity_b", ["customer_id", "week_end_date", "outcome_type", "theme"])


def _incremental_actions(spark, sf, themes=True):
    fact = scenario.factual_actions(P.actions_factual(spark, sf), "propensity_a")
    counter = scenario.counterfactual_actions(P.actions_counterfactual(spark, sf))
    return scenario.incremental_actions(fact, counter, START, END, _theme_actions(spark, sf) if themes else None)


def _incremental_outcomes(spark, sf, themes=True):
    keys = ["customer_id", "week_end_date", "outcome_type"]
    fact = scenario.factual_outcomes(P.outcomes_factual(spark, sf), "propensity_b", keys)
    counter = scenario.counterfactual_outcomes(P.outcomes_counterfactual(spark, sf), keys)
    return scenario.incremental_outcomes(fact, counter, START, END, _theme_outcomes(spark, sf) if themes else None)


@BOOK.add(
    "j2_join_actions",
    f"""WITH {_SCORES} SELECT {_KEY_L}, ROUND(predicted, 6) AS predicted_action_count, ROUND(counterfactual, 6) AS counterfactual_action_count
      FROM fa JOIN ca USING (rep_id, customer_id, week_end_date)""",
)
def j2_join_actions(spark, sf):
    fact = scenario.factual_actions(P.actions_factual(spark, sf), "propensity_a")
    counter = scenario.counterfactual_actions(P.actions_counterfactual(spark, sf))
    out = scenario.join_actions(fact, counter)
    return shaped(_week(out), "rep_id customer_id week", doubles="predicted_action_count counterfactual_action_count")


@BOOK.add(
    "j3_join_outcomes",
    f"""WITH {_SCORES} SELECT customer_id, CAST(f.week_end_date AS VARCHAR) AS week, outcome_type, ROUND(predicted, 6) AS predicted_outcome_count,
      ROUND(counterfactual, 6) AS counterfactual_outcome_count FROM fb f JOIN cb c USING (customer_id, week_end_date, outcome_type)""",
)
def j3_join_outcomes(spark, sf):
    """Each outcome type's factual and counterfactual rows joined, both types stacked."""
    parts = []
    for kind in config.OUTCOME_TYPES:
        fact = scenario.factual_outcomes(P.outcomes_factual(spark, sf).where(F.col("outcome_type") == kind), "propensity_b")
        counter = scenario.counterfactual_outcomes(P.outcomes_counterfactual(spark, sf).where(F.col("outcome_type") == kind))
        parts.append(scenario.join_outcomes(fact, counter).withColumn("outcome_type", F.lit(kind)))
    out = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return shaped(_week(out), "customer_id week outcome_type", doubles="predicted_outcome_count counterfactual_outcome_count")


@BOOK.add(
    "u1_stack_outcomes",
    f"""WITH {_SCORES} SELECT {_KEY_L}, outcome_type, ROUND(predicted, 6) AS predicted_action_count FROM fa CROSS JOIN (VALUES ('nbrx'), ('trx')) o(outcome_type)""",
)
def u1_stack_outcomes(spark, sf):
    out = scenario.per_outcome(scenario.factual_actions(P.actions_factual(spark, sf), "propensity_a"))
    return shaped(_week(out), "rep_id customer_id week outcome_type", doubles="predicted_action_count")


@BOOK.add(
    "u2_stack_themes",
    f"""WITH {_SCORES} SELECT theme, outcome_type, COUNT(*) AS panel_rows, ROUND(SUM(incremental), 6) AS incremental_action FROM inc_a GROUP BY 1, 2""",
)
def u2_stack_themes(spark, sf):
    out = _incremental_actions(spark, sf).groupBy("theme", "outcome_type").agg(
        F.count(F.lit(1)).alias("panel_rows"), F.sum("incremental_action").alias("incremental_action")
    )
    return shaped(out, "theme outcome_type", "panel_rows", "incremental_action")


@BOOK.add(
    "c5_incremental_action",
    f"""WITH {_SCORES} SELECT {_KEY_L}, theme, outcome_type, ROUND(predicted, 6) AS predicted_action_count, ROUND(counterfactual, 6) AS counterfactual_action_count,
      ROUND(incremental, 6) + 0.0 AS incremental_action FROM inc_a""",
)
def c5_incremental_action(spark, sf):
    out = _incremental_actions(spark, sf)
    doubles = "predicted_action_count counterfactual_action_count incremental_action"
    return shaped(_week(out), "rep_id customer_id week theme outcome_type", doubles=doubles)


@BOOK.add(
    "c6_incremental_outcome",
    f"""WITH {_SCORES} SELECT customer_id, CAST(week_end_date AS VARCHAR) AS week, theme, outcome_type, ROUND(predicted, 6) AS predicted_outcome_count,
      ROUND(counterfactual, 6) AS counterfactual_outcome_count, ROUND(incremental, 6) + 0.0 AS incremental_outcome FROM inc_b""",
)
def c6_incremental_outcome(spark, sf):
    out = _incremental_outcomes(spark, sf)
    doubles = "predicted_outcome_count counterfactual_outcome_count incremental_outcome"
    return shaped(_week(out), "customer_id week theme outcome_type", doubles=doubles)


@BOOK.add(
    "a14_monthly_rollup",
    f"""WITH {_EFFECT} SELECT month_label AS month, ROUND(SUM(incremental_actions), 6) AS incremental_actions, ROUND(SUM(incremental_trx), 6) AS incremental_trx,
      ROUND(SUM(incremental_nbrx), 6) AS incremental_nbrx FROM effect GROUP BY 1""",
)
def a14_monthly_rollup(spark, sf):
    columns = ["incremental_actions", "incremental_trx", "incremental_nbrx"]
    return shaped(rollups.monthly_rollup(_effect(spark, sf), R.time, columns), "month", doubles=" ".join(columns))


@BOOK.add(
    "a15_channel_monthly_rollup",
    f"""WITH {_EFFECT} SELECT month_label AS month, 'action_email' AS channel, ROUND(SUM(incremental_actions * action_email / denom), 6) AS incremental_actions
      FROM effect GROUP BY 1 UNION ALL SELECT month_label, 'action_call', ROUND(SUM(incremental_actions * action_call / denom), 6) FROM effect GROUP BY 1""",
)
def a15_channel_monthly_rollup(spark, sf):
    out = rollups.channel_monthly_rollup(_effect(spark, sf), R.time, "incremental_actions", R.actions)
    return shaped(out, "month channel", doubles="incremental_actions")


@BOOK.add(
    "a16_channel_lift",
    f"""WITH {_EFFECT} SELECT 'action_email' AS channel, ROUND(SUM(incremental_actions * action_email / denom), 4) AS lift FROM effect
      UNION ALL SELECT 'action_call', ROUND(SUM(incremental_actions * action_call / denom), 4) FROM effect""",
)
def a16_channel_lift(spark, sf):
    out = rollups.channel_lift(_effect(spark, sf), "incremental_actions", R.actions)
    return shaped(out.withColumn("lift", F.round("lift", 4)), "channel", doubles="lift")


@BOOK.add(
    "a17_overall_lift",
    f"WITH {_EFFECT} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS measure, ROUND(AVG({c}), 6) AS average, ROUND(SUM({c}), 6) AS total FROM effect"
        for c in ("incremental_actions", "incremental_trx", "incremental_nbrx")
    ),
)
def a17_overall_lift(spark, sf):
    out = rollups.overall_lift(_effect(spark, sf), ["incremental_actions", "incremental_trx", "incremental_nbrx"])
    return shaped(out, "measure", doubles="average total")


@BOOK.add(
    "a18_cohort_diagnostics",
    f"""WITH {_EFFECT} SELECT COUNT(CASE WHEN suggestion_total > 0 THEN 1 END) AS treated_cohort_size, COUNT(CASE WHEN suggestion_total <= 0 THEN 1 END)
      AS control_cohort_size, COUNT(CASE WHEN action_total > 0 THEN 1 END) AS treated_action_rows, COUNT(CASE WHEN action_total <= 0 THEN 1 END)
      AS control_action_rows, CAST(24 AS BIGINT) AS feature_count, CASE WHEN COUNT(CASE WHEN suggestion_total > 0 THEN 1 END) < 10
      THEN 'Low treated cohort size' ELSE '' END AS warning FROM effect""",
)
def a18_cohort_diagnostics(spark, sf):
    out = rollups.cohort_diagnostics(_effect(spark, sf), 24)
    longs = "treated_cohort_size control_cohort_size treated_action_rows control_action_rows feature_count"
    return shaped(out, "warning", longs)


_OBSERVED = """obs AS (SELECT year(week_end_date) AS year, month(week_end_date) AS month, SUM(outcome_count) AS observed_outcome,
    SUM(action_count) AS observed_action FROM long WHERE suggestion_type = 'call' AND action_type = 'call' AND outcome_type = 'nbrx' GROUP BY 1, 2),
  ob AS (SELECT year(week_end_date) AS year, month(week_end_date) AS month, SUM(incremental) AS incremental_outcome, SUM(predicted) AS predicted_outcome
    FROM inc_b WHERE outcome_type = 'nbrx' AND theme = 'all' GROUP BY 1, 2),
  oa AS (SELECT year(week_end_date) AS year, month(week_end_date) AS month, SUM(incremental) AS incremental_action, SUM(predicted) AS predicted_action
    FROM inc_a WHERE outcome_type = 'nbrx' AND theme = 'all' GROUP BY 1, 2),
  summary AS (SELECT * FROM obs JOIN ob USING (year, month) JOIN oa USING (year, month))"""
_VALUES = "observed_outcome observed_action incremental_outcome predicted_outcome incremental_action predicted_action"


def _summary(spark, sf):
    observed = [F.col("suggestion_type") == "call", F.col("action_type") == "call", F.col("outcome_type") == "nbrx"]
    results = [F.col("outcome_type") == "nbrx", F.col("theme") == "all"]
    return report.observed_vs_incremental(
        P.long(spark, sf), _incremental_outcomes(spark, sf, False), _incremental_actions(spark, sf, False), observed, results
    )


@BOOK.add(
    "a19_observed_vs_incremental",
    f"WITH {_SCORES}, {_OBSERVED} SELECT year, month, " + ", ".join(f"ROUND({c}, 6) + 0.0 AS {c}" for c in _VALUES.split()) + " FROM summary",
)
def a19_observed_vs_incremental(spark, sf):
    return shaped(_summary(spark, sf), "", "year month", _VALUES)


@BOOK.add(
    "j6_monthly_join",
    f"""WITH {_SCORES}, {_OBSERVED}, literal_b AS (SELECT year(week_end_date) AS year, month(week_end_date) AS month, SUM(incremental) AS incremental_outcome
        FROM inc_b GROUP BY 1, 2), literal_a AS (SELECT year(week_end_date) AS year, month(week_end_date) AS month, SUM(incremental) AS incremental_action
        FROM inc_a GROUP BY 1, 2)
      SELECT year, month, ROUND(observed_outcome, 6) AS observed_outcome, ROUND(literal_b.incremental_outcome, 6) + 0.0 AS incremental_outcome,
        ROUND(literal_a.incremental_action, 6) + 0.0 AS incremental_action FROM obs JOIN literal_b USING (year, month) JOIN literal_a USING (year, month)""",
)
def j6_monthly_join(spark, sf):
    """The unrestricted form: observed rows of one triple, results over all outcomes and themes."""
    observed = [F.col("suggestion_type") == "call", F.col("action_type") == "call", F.col("outcome_type") == "nbrx"]
    out = report.observed_vs_incremental(P.long(spark, sf), _incremental_outcomes(spark, sf), _incremental_actions(spark, sf), observed)
    return shaped(out, "", "year month", "observed_outcome incremental_outcome incremental_action")


@BOOK.add(
    "x1_actual_vs_predicted",
    f"""WITH {_SCORES}, {_OBSERVED} SELECT 'outcome' AS kind, CAST(year AS VARCHAR) || '_' || lpad(CAST(month AS VARCHAR), 2, '0') AS year_month,
        ROUND(observed_outcome, 6) AS actual, ROUND(predicted_outcome, 6) AS predicted FROM summary
      UNION ALL SELECT 'action', CAST(year AS VARCHAR) || '_' || lpad(CAST(month AS VARCHAR), 2, '0'), ROUND(observed_action, 6), ROUND(predicted_action, 6) FROM summary""",
)
def x1_actual_vs_predicted(spark, sf):
    summary = _summary(spark, sf)
    out = scenario.stack({k: report.actual_vs_predicted(summary, k) for k in ("outcome", "action")}, "kind")
    return shaped(out, "kind year_month", doubles="actual predicted")


@BOOK.add(
    "x2_fit_line",
    f"""WITH {_SCORES}, {_OBSERVED} SELECT ROUND(REGR_SLOPE(predicted_outcome, observed_outcome), 6) AS slope,
      ROUND(REGR_INTERCEPT(predicted_outcome, observed_outcome), 6) AS intercept, ROUND(REGR_R2(predicted_outcome, observed_outcome), 6) AS r2 FROM summary""",
)
def x2_fit_line(spark, sf):
    return shaped(report.fit_line(report.actual_vs_predicted(_summary(spark, sf), "outcome")), doubles="slope intercept r2")


@BOOK.add(
    "x3_model_summary",
    f"WITH {_SCORES}, {_OBSERVED} "
    + " UNION ALL ".join(
        f"SELECT CAST(year AS VARCHAR) || '_' || lpad(CAST(month AS VARCHAR), 2, '0') AS year_month, '{c}' AS variable, ROUND({c}, 6) + 0.0 AS value FROM summary"
        for c in _VALUES.split()
    ),
)
def x3_model_summary(spark, sf):
    return shaped(report.summary_long(_summary(spark, sf)), "year_month variable", doubles="value")


_THEMES = """SELECT COALESCE(b.theme, a.theme) AS theme, ROUND(b.v, 6) + 0.0 AS incremental_outcome, ROUND(a.v, 6) + 0.0 AS incremental_action
  FROM (SELECT theme, SUM(incremental) AS v FROM inc_b GROUP BY 1) b FULL OUTER JOIN
    (SELECT theme, SUM(incremental) AS v FROM inc_a {0} GROUP BY 1) a ON a.theme = b.theme"""


@BOOK.add("a20_theme_summary", f"WITH {_SCORES} " + _THEMES.format("WHERE outcome_type = 'nbrx'"))
def a20_theme_summary(spark, sf):
    out = report.theme_summary(_incremental_outcomes(spark, sf), _incremental_actions(spark, sf))
    return shaped(out, "theme", doubles="incremental_outcome incremental_action")


@BOOK.add("j7_theme_merge", f"WITH {_SCORES} " + _THEMES.format("WHERE theme <> 'theme_o_qualified'"))
def j7_theme_merge(spark, sf):
    """One theme has no action side; both outcome copies are summed."""
    actions = _incremental_actions(spark, sf).where(F.col("theme") != "theme_o_qualified")
    out = report.theme_summary(_incremental_outcomes(spark, sf), actions, compat=True)
    return shaped(out, "theme", doubles="incremental_outcome incremental_action")


@BOOK.add(
    "a23_reconciliation",
    f"""WITH {P.PREDICTIONS} SELECT 'original' AS stage, ROUND(SUM(action_count), 6) AS total FROM path_a
      UNION ALL SELECT 'modified', ROUND(SUM({_FACT}), 6) FROM af""",
)
def a23_reconciliation(spark, sf):
    before = P.path_a_panel(spark, sf)
    predicted = scenario.factual_actions(P.actions_factual(spark, sf), "propensity_a")
    after = scenario.substitute_actions(before, predicted, "predicted_action_count")
    return shaped(rollups.reconciliation(before, after), "stage", doubles="total")


@BOOK.add(
    "a24_totals_by_hcp_and_rep",
    f"""WITH {_EFFECT} SELECT 'hcp' AS level, hcp_id AS id, ROUND(SUM(incremental_actions), 6) AS incremental_actions, ROUND(SUM(incremental_trx), 6)
        AS incremental_trx FROM effect GROUP BY 2
      UNION ALL SELECT 'rep', rep_id, ROUND(SUM(incremental_actions), 6), ROUND(SUM(incremental_trx), 6) FROM effect GROUP BY 2""",
)
def a24_totals_by_hcp_and_rep(spark, sf):
    columns = ["incremental_actions", "incremental_trx"]
    parts = {
        level: rollups.totals_by(_effect(spark, sf), key, columns).withColumnRenamed(key, "id")
        for level, key in (("hcp", "hcp_id"), ("rep", "rep_id"))
    }
    return shaped(scenario.stack(parts, "level"), "level id", doubles=" ".join(columns))


@BOOK.add(
    "a25_variable_roles",
    f"""WITH {P.DENSE}, n AS (SELECT COUNT(*) AS panel_rows FROM dense) SELECT path, role, "column", panel_rows FROM n, (VALUES
      ('A', 'propensity_input', 'suggestion_total'), ('A', 'treatment_effect_input', 'suggestion_total'),
      ('A', 'treatment_effect_input', 'propensity_score_path_a'), ('B', 'outcome', 'trx'), ('B', 'outcome', 'nbrx'),
      ('B', 'treatment_action_driver', 'action_email'), ('B', 'treatment_action_driver', 'action_call'),
      ('B', 'confounder_covariate', 'suggestion_total')) v(path, role, "column")""",
)
def a25_variable_roles(spark, sf):
    d = P.dense(spark, sf)
    out = rollups.variable_roles(spark, R, ["suggestion_total"])
    return shaped(out.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("panel_rows")))), "path role column", "panel_rows")


_CLASSES = """m AS (SELECT suggestion_call AS l, action_call AS p FROM dense),
  cells AS (SELECT l, p, COUNT(*) AS n FROM m GROUP BY 1, 2),
  per AS (SELECT l, SUM(n) AS actual, SUM(CASE WHEN l = p THEN n ELSE 0 END) AS hit FROM cells GROUP BY 1),
  pp AS (SELECT p AS l, SUM(n) AS predicted FROM cells GROUP BY 1),
  k AS (SELECT actual, hit, COALESCE(hit / NULLIF(predicted, 0), 0) AS pr, COALESCE(hit / NULLIF(actual, 0), 0) AS rc FROM per LEFT JOIN pp USING (l))"""


@BOOK.add(
    "m8_classification_metrics",
    f"""WITH {P.DENSE}, {_CLASSES} SELECT ROUND(SUM(hit) / SUM(actual), 6) AS accuracy, ROUND(SUM(pr * actual) / SUM(actual), 6) AS "precision",
      ROUND(SUM(rc * actual) / SUM(actual), 6) AS recall, ROUND(SUM(COALESCE(2 * pr * rc / NULLIF(pr + rc, 0), 0) * actual) / SUM(actual), 6) AS f1 FROM k""",
)
def m8_classification_metrics(spark, sf):
    out = models.classification_metrics(P.dense(spark, sf), "suggestion_call", "action_call")
    return shaped(out, doubles="accuracy precision recall f1")


@BOOK.add(
    "m11_auc",
    f"""WITH {P.DENSE}, s AS (SELECT CASE WHEN action_email + action_call > 0 THEN 1 ELSE 0 END AS y, suggestion_call + trx AS score FROM dense),
      by_score AS (SELECT score, SUM(y) AS pos, SUM(1 - y) AS neg FROM s GROUP BY 1),
      c AS (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM by_score)
      SELECT ROUND(SUM(pos * (lower + neg / 2.0)) / (SUM(pos) * SUM(neg)), 6) AS auc FROM c""",
)
def m11_auc(spark, sf):
    panel = features.add_totals_and_flags(P.dense(spark, sf), R).withColumn("score", F.col("suggestion_call") + F.col("trx"))
    auc = models.roc_auc(panel, "treated_action", "score")
    return spark.createDataFrame([(auc,)], "auc double").select(r6("auc").alias("auc"))


@BOOK.add(
    "m12_tlearner_fallback",
    f"""WITH {P.TOTALS}, t AS (SELECT * FROM totals WHERE suggestion_total > 0) SELECT {_KEY_D},
      ROUND((SELECT AVG(action_total) FROM t), 6) AS incremental_actions FROM t""",
)
def m12_tlearner_fallback(spark, sf):
    """Only treated rows: the control arm is empty and counts as mean 0."""
    treated = features.add_totals_and_flags(P.dense(spark, sf), R).where(F.col("treated_suggestion") == 1)
    out = models.fit_effects(treated, {"action_total": "incremental_actions"}, "treated_suggestion").data
    return shaped(_week(out), "hcp_id rep_id week", doubles="incremental_actions")


@BOOK.add(
    "m13_outcome_fallback",
    f"""WITH {P.TOTALS}, t AS (SELECT * FROM totals WHERE action_total > 0) SELECT {_KEY_D}, ROUND((SELECT AVG(trx) FROM t), 6) AS incremental_trx,
      ROUND((SELECT AVG(nbrx) FROM t), 6) AS incremental_nbrx FROM t""",
)
def m13_outcome_fallback(spark, sf):
    treated = features.add_totals_and_flags(P.dense(spark, sf), R).where(F.col("treated_action") == 1)
    out = models.fit_effects(treated, {"trx": "incremental_trx", "nbrx": "incremental_nbrx"}, "treated_action").data
    return shaped(_week(out), "hcp_id rep_id week", doubles="incremental_trx incremental_nbrx")


@BOOK.add(
    "m14_outcome_columns",
    f"""WITH {P.DENSE} SELECT 'trx' AS total_column, 'nbrx' AS new_column, SUM(trx) AS total_sum, SUM(nbrx) AS new_sum FROM dense""",
)
def m14_outcome_columns(spark, sf):
    from paneleffect.operators.roles import outcome_columns

    trx, nbrx = outcome_columns(R)
    out = P.dense(spark, sf).agg(
        F.lit(trx).alias("total_column"), F.lit(nbrx).alias("new_column"), F.sum(trx).alias("total_sum"), F.sum(nbrx).alias("new_sum")
    )
    return shaped(out, "total_column new_column", doubles="total_sum new_sum")
