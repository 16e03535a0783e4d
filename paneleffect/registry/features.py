"""Registered queries: wide features, spillover, adstock, grain."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneleffect.config import DEFAULT_ADSTOCK
from paneleffect.functions import scalars as S
from paneleffect.operators import adstock, features, grain, idmeans, report, scenario, spillover
from paneleffect.registry import panels as P
from paneleffect.registry.book import BOOK, shaped

R = P.DENSE_ROLES
_KEY = "hcp_id, rep_id, CAST(week_end_date AS VARCHAR) AS week"


def _week(df):
    return df.withColumn("week", F.col("week_end_date"))


def _totals(spark, sf, panel=P.dense):
    return features.add_totals_and_flags(panel(spark, sf), R)


@BOOK.add("p1_row_totals", f"WITH {P.TOTALS} SELECT {_KEY}, suggestion_total, action_total FROM totals")
def p1_row_totals(spark, sf):
    return shaped(_week(_totals(spark, sf)), "hcp_id rep_id week", doubles="suggestion_total action_total")


@BOOK.add(
    "p2_treatment_flags",
    f"""WITH {P.TOTALS} SELECT {_KEY}, CAST(suggestion_total > 0 AS BIGINT) AS treated_suggestion,
      CAST(action_total > 0 AS BIGINT) AS treated_action FROM totals""",
)
def p2_treatment_flags(spark, sf):
    return shaped(_week(_totals(spark, sf)), "hcp_id rep_id week", "treated_suggestion treated_action")


@BOOK.add(
    "p3_calendar_parts",
    f"WITH {P.DENSE} SELECT {_KEY}, CAST(month(week_end_date) AS BIGINT) AS month, CAST(quarter(week_end_date) AS BIGINT) AS quarter FROM dense",
)
def p3_calendar_parts(spark, sf):
    return shaped(_week(features.add_calendar(P.dense(spark, sf), "week_end_date")), "hcp_id rep_id week", "month quarter")


@BOOK.add("p4_month_label", f"WITH {P.TOTALS} SELECT {_KEY}, month_label FROM totals")
def p4_month_label(spark, sf):
    out = P.dense(spark, sf).withColumn("month_label", S.month_label(F.col("week_end_date")))
    return shaped(_week(out), "hcp_id rep_id week month_label")


_Z = ("suggestion_email", "action_call", "trx", "suggestion_total", "month")
_Z_SQL = ", ".join(
    f"ROUND(COALESCE(({c} - AVG({c}) OVER ()) / NULLIF(STDDEV_SAMP({c}) OVER (), 0), 0), 6) + 0.0 AS z_{c}" for c in _Z
)


@BOOK.add(
    "p5_z_scores",
    f"WITH {P.TOTALS}, m AS (SELECT *, month(week_end_date) AS month FROM totals) SELECT {_KEY}, {_Z_SQL}, CAST(0.0 AS DOUBLE) AS z_flat FROM m",
)
def p5_z_scores(spark, sf):
    panel = features.add_calendar(_totals(spark, sf), "week_end_date").withColumn("flat", F.lit(3.0))
    out = features.add_z_scores(panel)
    return shaped(_week(out), "hcp_id rep_id week", doubles=" ".join(f"z_{c}" for c in (*_Z, "flat")))


_DUMMIES = [f"month_{m}" for m in range(2, 13)] + [f"quarter_{q}" for q in range(2, 5)] + [f"rep_id_R{i}" for i in range(1, 5)]
_DUMMY_SQL = ", ".join(
    [f"CAST(month(week_end_date) = {m} AS BIGINT) AS month_{m}" for m in range(2, 13)]
    + [f"CAST(quarter(week_end_date) = {q} AS BIGINT) AS quarter_{q}" for q in range(2, 5)]
    + [f"CAST(rep_id = 'R{i}' AS BIGINT) AS rep_id_R{i}" for i in range(1, 5)]
)


@BOOK.add("p6_one_hot", f"WITH {P.DENSE} SELECT hcp_id, CAST(week_end_date AS VARCHAR) AS week, trx, {_DUMMY_SQL} FROM dense")
def p6_one_hot(spark, sf):
    out = features.one_hot_columns(features.add_calendar(P.dense(spark, sf), "week_end_date"), ["rep_id", "month", "quarter"])
    return shaped(_week(out), "hcp_id week", " ".join(_DUMMIES), "trx")


_FEATURES = (
    "suggestion_total action_total treated_suggestion treated_action lag_suggestion_total_1 lag_action_total_1 "
    "rolling4_suggestion_total rolling4_action_total baseline_trx_8w z_suggestion_email z_suggestion_call z_action_email "
    "z_action_call z_trx z_nbrx z_suggestion_total z_action_total z_lag_suggestion_total_1 z_lag_action_total_1 "
    "z_rolling4_suggestion_total z_rolling4_action_total z_baseline_trx_8w z_month z_quarter"
).split()
_WINDOWS = """SELECT *,
  COALESCE(LAG(suggestion_total) OVER w, 0) AS lag_suggestion_total_1, COALESCE(LAG(action_total) OVER w, 0) AS lag_action_total_1,
  AVG(suggestion_total) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rolling4_suggestion_total,
  AVG(action_total) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rolling4_action_total,
  COALESCE(AVG(trx) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) AS baseline_trx_8w
  FROM totals WINDOW w AS (PARTITION BY hcp_id, rep_id ORDER BY week_end_date)"""


@BOOK.add(
    "p7_feature_columns",
    "SELECT unnest([" + ", ".join(f"'{c}'" for c in _FEATURES) + "]) AS feature, (SELECT COUNT(*) FROM "
    f"(WITH {P.DENSE} SELECT * FROM dense)) AS panel_rows",
)
def p7_feature_columns(spark, sf):
    frame = features.build_features(P.dense(spark, sf), R)
    rows = frame.data.agg(F.count(F.lit(1)).alias("panel_rows"))
    names = spark.createDataFrame([(c,) for c in frame.numeric], "feature string")
    return shaped(names.crossJoin(F.broadcast(rows)), "feature", "panel_rows")


@BOOK.add(
    "p8_channel_share",
    f"""WITH {P.DENSE} SELECT {_KEY}, ROUND(action_email * 1.0 / CASE WHEN action_email + action_call = 0 THEN 1 ELSE action_email + action_call END, 6)
      AS share_action_email, ROUND(action_call * 1.0 / CASE WHEN action_email + action_call = 0 THEN 1 ELSE action_email + action_call END, 6)
      AS share_action_call FROM dense""",
)
def p8_channel_share(spark, sf):
    out = features.add_channel_shares(P.dense(spark, sf), R.actions)
    return shaped(_week(out), "hcp_id rep_id week", doubles="share_action_email share_action_call")


@BOOK.add("w1_lags", f"WITH {P.TOTALS}, h AS ({_WINDOWS}) SELECT {_KEY}, lag_suggestion_total_1, lag_action_total_1 FROM h")
def w1_lags(spark, sf):
    out = features.add_history(_totals(spark, sf), R)
    return shaped(_week(out), "hcp_id rep_id week", doubles="lag_suggestion_total_1 lag_action_total_1")


@BOOK.add(
    "w2_rolling_mean",
    f"""WITH {P.TOTALS}, h AS ({_WINDOWS}) SELECT {_KEY}, ROUND(rolling4_suggestion_total, 6) AS rolling4_suggestion_total,
      ROUND(rolling4_action_total, 6) AS rolling4_action_total FROM h""",
)
def w2_rolling_mean(spark, sf):
    out = features.add_history(_totals(spark, sf), R)
    return shaped(_week(out), "hcp_id rep_id week", doubles="rolling4_suggestion_total rolling4_action_total")


@BOOK.add("w3_baseline", f"WITH {P.TOTALS}, h AS ({_WINDOWS}) SELECT {_KEY}, ROUND(baseline_trx_8w, 6) AS baseline_trx_8w FROM h")
def w3_baseline(spark, sf):
    return shaped(_week(features.add_history(_totals(spark, sf), R)), "hcp_id rep_id week", doubles="baseline_trx_8w")


_FINE_TOTALS = """ft AS (SELECT *, CAST(suggestion_email + suggestion_call AS DOUBLE) AS suggestion_total,
  CAST(action_email + action_call AS DOUBLE) AS action_total FROM fine)"""


@BOOK.add(
    "w1_w3_history_fine",
    f"""WITH {P.FINE}, {_FINE_TOTALS}, h AS ({_WINDOWS.replace("FROM totals", "FROM ft")}) SELECT hcp_id, rep_id, CAST(week_end_date AS VARCHAR) AS week,
      lag_suggestion_total_1, ROUND(rolling4_action_total, 6) AS rolling4_action_total, ROUND(baseline_trx_8w, 6) AS baseline_trx_8w FROM h""",
)
def w1_w3_history_fine(spark, sf):
    out = features.add_history(_totals(spark, sf, P.fine), R)
    return shaped(_week(out), "week", "hcp_id rep_id", "lag_suggestion_total_1 rolling4_action_total baseline_trx_8w")


@BOOK.add(
    "w4_percent_other",
    f"""WITH {P.FINE}, s AS (SELECT hcp_id, rep_id, week_end_date, CASE WHEN suggestion_call > 0 THEN 1.0 ELSE 0.0 END AS got FROM fine)
      SELECT hcp_id, rep_id, CAST(week_end_date AS VARCHAR) AS week, ROUND(COALESCE((SUM(got) OVER w - got) / NULLIF(COUNT(*) OVER w - 1, 0), 0), 6) + 0.0
      AS percent_other_hcps_suggested FROM s WINDOW w AS (PARTITION BY rep_id, week_end_date)""",
)
def w4_percent_other(spark, sf):
    out = spillover.percent_other_suggested(P.fine(spark, sf), count="suggestion_call")
    return shaped(_week(out), "week", "hcp_id rep_id", "percent_other_hcps_suggested")


@BOOK.add(
    "w4_percent_other_dense",
    f"""WITH {P.DENSE}, s AS (SELECT hcp_id, rep_id, week_end_date, CASE WHEN suggestion_call > 0 THEN 1.0 ELSE 0.0 END AS got FROM dense)
      SELECT {_KEY}, ROUND(COALESCE((SUM(got) OVER w - got) / NULLIF(COUNT(*) OVER w - 1, 0), 0), 6) + 0.0
      AS percent_other_hcps_suggested FROM s WINDOW w AS (PARTITION BY rep_id, week_end_date)""",
)
def w4_percent_other_dense(spark, sf):
    out = spillover.percent_other_suggested(P.dense(spark, sf), count="suggestion_call")
    return shaped(_week(out), "hcp_id rep_id week", doubles="percent_other_hcps_suggested")


def _index_sql(by: str, out: str) -> str:
    return f"WITH {P.DENSE} SELECT {_KEY}, CAST(SUM(action_call) OVER (PARTITION BY {by}) AS BIGINT) AS {out} FROM dense"


@BOOK.add("w5_global_index", _index_sql("week_end_date", "action_call_global_index"))
def w5_global_index(spark, sf):
    return shaped(_week(spillover.global_index(P.dense(spark, sf), "action_call")), "hcp_id rep_id week", "action_call_global_index")


@BOOK.add("w6_rep_index", _index_sql("rep_id, week_end_date", "action_call_rep_global_index"))
def w6_rep_index(spark, sf):
    return shaped(_week(spillover.rep_index(P.dense(spark, sf), "action_call")), "hcp_id rep_id week", "action_call_rep_global_index")


@BOOK.add("w7_customer_index", _index_sql("hcp_id, week_end_date", "action_call_hcp_global_index"))
def w7_customer_index(spark, sf):
    out = spillover.customer_index(P.dense(spark, sf), "action_call", customer="hcp_id")
    return shaped(_week(out), "hcp_id rep_id week", "action_call_hcp_global_index")


def _adstock_sql(source: str, keys: list[str], column: str, decay: float, steps: int) -> str:
    joined = " AND ".join(f"b.{k} = a.{k}" for k in keys)
    weight = f"POWER({decay}, (a.week_end_date - b.week_end_date) / 7)"
    return f"""SELECT a.hcp_id, a.rep_id, CAST(a.week_end_date AS VARCHAR) AS week, ROUND(SUM({weight} * b.{column}), 9) AS {column}_adstock
      FROM {source} a JOIN {source} b ON {joined} AND b.week_end_date BETWEEN a.week_end_date - {7 * steps} AND a.week_end_date
      GROUP BY 1, 2, 3"""


_ADSTOCK = {"suggestion_call": DEFAULT_ADSTOCK["suggestion_count"], "action_call": DEFAULT_ADSTOCK["action_count"]}


@BOOK.add("w8_adstock", f"WITH {P.DENSE} {_adstock_sql('dense', ['hcp_id', 'rep_id'], 'action_call', 0.69, 4)}")
def w8_adstock(spark, sf):
    out = adstock.add_adstock(P.dense(spark, sf), ["hcp_id", "rep_id"], _ADSTOCK, unique_grain=True)
    return shaped(_week(out), "hcp_id rep_id week", doubles="action_call_adstock", decimals=9)


@BOOK.add("w8_adstock_customer", f"WITH {P.DENSE} {_adstock_sql('dense', ['hcp_id'], 'suggestion_call', 0.3, 4)}")
def w8_adstock_customer(spark, sf):
    """Several reps share a customer's week: days are summed before they carry over."""
    out = adstock.add_adstock(P.dense(spark, sf), ["hcp_id"], _ADSTOCK)
    return shaped(_week(out), "hcp_id rep_id week", doubles="suggestion_call_adstock", decimals=9)


@BOOK.add("w8_adstock_fine", f"WITH {P.FINE} {_adstock_sql('fine', ['hcp_id', 'rep_id'], 'action_call', 0.69, 4)}")
def w8_adstock_fine(spark, sf):
    out = adstock.add_adstock(P.fine(spark, sf), ["hcp_id", "rep_id"], _ADSTOCK, unique_grain=True)
    return shaped(_week(out), "week", "hcp_id rep_id", "action_call_adstock", decimals=9)


@BOOK.add(
    "a21_collapse_reps",
    f"""WITH {P.LONG} SELECT customer_id, CAST(week_end_date AS VARCHAR) AS week, suggestion_type, outcome_type, SUM(suggestion_count) AS suggestion_count,
      SUM(action_count) AS action_count, SUM(outcome_count) AS outcome_count, MAX(covariate_path_a_segment) AS covariate_path_a_segment,
      ROUND(MAX(confound_path_a_suppbal), 6) AS confound_path_a_suppbal, SUM(theme_f_qualified) AS theme_f_qualified
      FROM long GROUP BY customer_id, week_end_date, suggestion_type, outcome_type""",
)
def a21_collapse_reps(spark, sf):
    out = grain.collapse_reps(P.long(spark, sf), {"theme_f_qualified": "sum"})
    doubles = "suggestion_count action_count outcome_count confound_path_a_suppbal theme_f_qualified"
    return shaped(_week(out), "customer_id week suggestion_type outcome_type covariate_path_a_segment", doubles=doubles)


@BOOK.add(
    "a22_dedupe_non_personal",
    f"""WITH {P.LONG} SELECT rep_id, customer_id, CAST(week_end_date AS VARCHAR) AS week, suggestion_type, outcome_type, suggestion_count, action_count
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id, week_end_date, suggestion_type, action_type, outcome_type ORDER BY rep_id) AS k
        FROM long) WHERE k = 1""",
)
def a22_dedupe_non_personal(spark, sf):
    out = grain.dedupe_non_personal(P.long(spark, sf), "npp")
    return shaped(_week(out), "rep_id customer_id week suggestion_type outcome_type", doubles="suggestion_count action_count")


@BOOK.add(
    "j1_attach_propensity",
    f"""WITH {P.ACTION_SCORES}, scores AS (SELECT rep_id, customer_id, week_end_date, propensity_a FROM af WHERE suggestion_count > 0)
      SELECT l.rep_id, l.customer_id, CAST(l.week_end_date AS VARCHAR) AS week, l.suggestion_type, l.outcome_type, s.propensity_a
      FROM long l LEFT JOIN scores s USING (rep_id, customer_id, week_end_date)""",
)
def j1_attach_propensity(spark, sf):
    scores = P.actions_factual(spark, sf).where(F.col("suggestion_count") > 0).select("rep_id", "customer_id", "week_end_date", "propensity_a")
    out = grain.attach_propensity(P.long(spark, sf), scores, "propensity_a")
    return shaped(_week(out), "rep_id customer_id week suggestion_type outcome_type", doubles="propensity_a")


@BOOK.add(
    "j1_attach_propensity_customer",
    f"""WITH {P.PREDICTIONS}, scores AS (SELECT customer_id, week_end_date, propensity_b FROM bf WHERE outcome_type = 'trx' AND action_count > 1)
      SELECT b.customer_id, CAST(b.week_end_date AS VARCHAR) AS week, b.outcome_type, s.propensity_b
      FROM path_b b LEFT JOIN scores s USING (customer_id, week_end_date)""",
)
def j1_attach_propensity_customer(spark, sf):
    b = P.outcomes_factual(spark, sf)
    scores = b.where((F.col("outcome_type") == "trx") & (F.col("action_count") > 1)).select("customer_id", "week_end_date", "propensity_b")
    out = grain.attach_propensity(b.drop("propensity_b"), scores, "propensity_b")
    return shaped(_week(out), "customer_id week outcome_type", doubles="propensity_b")


@BOOK.add(
    "j4_substitute_actions",
    f"""WITH {P.ACTION_SCORES}, p AS (SELECT rep_id, customer_id, week_end_date, CASE WHEN prediction < 0 THEN 0.0 ELSE prediction END AS action_count FROM af)
      SELECT l.rep_id, l.customer_id, CAST(l.week_end_date AS VARCHAR) AS week, l.suggestion_type, l.outcome_type, l.suggestion_count,
        ROUND(p.action_count, 6) AS action_count FROM long l LEFT JOIN p USING (rep_id, customer_id, week_end_date)""",
)
def j4_substitute_actions(spark, sf):
    predicted = scenario.factual_actions(P.actions_factual(spark, sf), "propensity_a")
    out = scenario.substitute_actions(P.long(spark, sf), predicted, "predicted_action_count")
    return shaped(_week(out), "rep_id customer_id week suggestion_type outcome_type", doubles="suggestion_count action_count")


@BOOK.add(
    "j5_restore_spillover",
    f"""WITH {P.PREDICTIONS}, a AS (SELECT rep_id, customer_id, week_end_date, SUM(CASE WHEN suggestion_count > 0 THEN 1.0 ELSE 0.0 END) OVER w AS s,
        CASE WHEN suggestion_count > 0 THEN 1.0 ELSE 0.0 END AS got, COUNT(*) OVER w AS n FROM path_a WINDOW w AS (PARTITION BY rep_id, week_end_date))
      SELECT rep_id, customer_id, CAST(week_end_date AS VARCHAR) AS week, CAST(0.0 AS DOUBLE) AS suggestion_count,
        ROUND(COALESCE((s - got) / NULLIF(n - 1, 0), 0), 6) + 0.0 AS percent_other_hcps_suggested FROM a""",
)
def j5_restore_spillover(spark, sf):
    panel = P.path_a_panel(spark, sf)
    actual = spillover.percent_other_suggested(panel)
    zeroed = spillover.percent_other_suggested(scenario.zero_suggestions(panel))
    out = scenario.restore_spillover(zeroed, actual)
    return shaped(_week(out), "rep_id customer_id week", doubles="suggestion_count percent_other_hcps_suggested")


@BOOK.add(
    "p18_long_summary",
    f"""WITH {P.TOTALS}, s AS (SELECT year(week_end_date) AS year, month(week_end_date) AS month, SUM(trx) AS observed_outcome, SUM(action_total) AS observed_action
        FROM totals GROUP BY 1, 2)
      SELECT year, month, CAST(year AS VARCHAR) || '_' || lpad(CAST(month AS VARCHAR), 2, '0') AS year_month, 'observed_outcome' AS variable,
        ROUND(observed_outcome, 6) AS value FROM s
      UNION ALL SELECT year, month, CAST(year AS VARCHAR) || '_' || lpad(CAST(month AS VARCHAR), 2, '0'), 'observed_action', ROUND(observed_action, 6) FROM s""",
)
def p18_long_summary(spark, sf):
    totals = _totals(spark, sf).groupBy(F.year("week_end_date").alias("year"), F.month("week_end_date").alias("month")).agg(
        F.sum("trx").alias("observed_outcome"), F.sum("action_total").alias("observed_action")
    )
    return shaped(report.summary_long(totals), "year_month variable", "year month", "value")


_MEAN = "CASE WHEN hcp_id % 97 = 0 THEN NULL ELSE hcp_id END"


@BOOK.add(
    "p6_id_means",
    f"""WITH {P.FINE}, x AS (SELECT {_MEAN} AS hcp_id, rep_id, week_end_date, CAST(action_email + action_call AS DOUBLE) AS y, trx AS z,
        ('0x' || SUBSTR(MD5(COALESCE(CAST({_MEAN} AS VARCHAR), '') || '|' || rep_id || '|' || CAST(week_end_date AS VARCHAR)), 1, 8))::UBIGINT % 5 AS fold FROM fine),
      g AS (SELECT fold, (SUM(SUM(y)) OVER () - SUM(y)) / (SUM(COUNT(*)) OVER () - COUNT(*)) AS my, (SUM(SUM(z)) OVER () - SUM(z)) / (SUM(COUNT(*)) OVER () - COUNT(*)) AS mz FROM x GROUP BY fold),
      t AS (SELECT hcp_id, fold, COUNT(*) AS n, SUM(y) AS y, SUM(z) AS z FROM x WHERE hcp_id IS NOT NULL GROUP BY 1, 2),
      w AS (SELECT hcp_id, SUM(n) AS n, SUM(y) AS y, SUM(z) AS z FROM t GROUP BY 1)
      SELECT CAST(x.hcp_id AS VARCHAR) AS hcp_id, CAST(x.rep_id AS VARCHAR) AS rep_id, CAST(week_end_date AS VARCHAR) AS week,
        ROUND((COALESCE(w.y - t.y, 0) + 20 * my) / (COALESCE(w.n - t.n, 0) + 20), 9) + 0.0 AS mean_action_total_by_hcp_id,
        ROUND((COALESCE(w.z - t.z, 0) + 20 * mz) / (COALESCE(w.n - t.n, 0) + 20), 9) + 0.0 AS mean_trx_by_hcp_id
      FROM x JOIN g USING (fold) LEFT JOIN t ON t.hcp_id = x.hcp_id AND t.fold = x.fold LEFT JOIN w ON w.hcp_id = x.hcp_id""",
)
def p6_id_means(spark, sf):
    """Customers as cross-fitted means; some rows have no customer."""
    panel = _totals(spark, sf, P.fine).withColumn("hcp_id", F.when(F.col("hcp_id") % 97 != 0, F.col("hcp_id")))
    means = idmeans.fit_id_means(panel, "hcp_id", ("action_total", "trx"), ("hcp_id", "rep_id", "week_end_date"))
    return shaped(_week(idmeans.add_id_means(panel, means)), "hcp_id rep_id week", doubles=" ".join(means.columns), decimals=9)
