"""Registered queries: exploratory profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneleffect.operators import profile, report
from paneleffect.registry import panels as P
from paneleffect.registry.book import BOOK, shaped

METRICS = list(P.DENSE_ROLES.metrics)
_SUMS = ", ".join(f"ROUND(CAST(SUM({m}) AS DOUBLE), 6) AS {m}" for m in METRICS)


def _prepared(spark, sf):
    return profile.prepare(P.dense(spark, sf), P.DENSE_ROLES)


@BOOK.add("a1_monthly_totals", f"WITH {P.TOTALS} SELECT month_label AS month, {_SUMS} FROM totals GROUP BY 1")
def a1_monthly_totals(spark, sf):
    return shaped(profile.monthly_totals(_prepared(spark, sf), METRICS), "month", doubles=" ".join(METRICS))


_UNPIVOTED = " UNION ALL ".join(
    f"SELECT month_label AS month, '{m}' AS \"column\", '{r}' AS role, ROUND(CAST(SUM({m}) AS DOUBLE), 6) AS total FROM totals GROUP BY 1"
    for r, names in (
        ("suggestions", P.DENSE_ROLES.suggestions), ("actions", P.DENSE_ROLES.actions), ("outcomes", P.DENSE_ROLES.outcomes)
    )
    for m in names
)


@BOOK.add("a2_monthly_totals_by_role", f"WITH {P.TOTALS} {_UNPIVOTED}")
def a2_monthly_totals_by_role(spark, sf):
    return shaped(profile.monthly_totals_by_role(_prepared(spark, sf), P.DENSE_ROLES), "month column role", doubles="total")


@BOOK.add("a3_action_uptake_rate", f"WITH {P.TOTALS} SELECT ROUND(AVG(CASE WHEN action_total > 0 THEN 1.0 ELSE 0.0 END), 6) AS action_uptake_rate FROM totals")
def a3_action_uptake_rate(spark, sf):
    return shaped(profile.action_uptake_rate(_prepared(spark, sf)), doubles="action_uptake_rate")


@BOOK.add(
    "a4_conversion",
    f"""WITH {P.TOTALS} SELECT ROUND(AVG(CASE WHEN suggestion_total > 0 AND action_total > 0 THEN 1.0 ELSE 0.0 END), 6)
      AS suggestion_to_action_conversion FROM totals""",
)
def a4_conversion(spark, sf):
    return shaped(profile.suggestion_to_action_conversion(_prepared(spark, sf)), doubles="suggestion_to_action_conversion")


_RAW_COLUMNS = ["hcp_id", "rep_id", "week_end_date", *METRICS]


@BOOK.add(
    "a5_missing_counts",
    f"WITH {P.RAW} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing FROM raw" for c in _RAW_COLUMNS),
)
def a5_missing_counts(spark, sf):
    return shaped(profile.missing_counts(P.raw(spark, sf)), "column", "missing")


def _profile_sql(source: str, m: str) -> str:
    return f"""SELECT '{m}' AS variable, ROUND(AVG({m}), 6) AS mean, ROUND(STDDEV_POP({m}), 6) AS std_dev, ROUND(CAST(MIN({m}) AS DOUBLE), 6) AS "min",
      ROUND(QUANTILE_CONT(CAST({m} AS DOUBLE), 0.25), 6) AS q1, ROUND(QUANTILE_CONT(CAST({m} AS DOUBLE), 0.5), 6) AS median,
      ROUND(QUANTILE_CONT(CAST({m} AS DOUBLE), 0.75), 6) AS q3, ROUND(CAST(MAX({m}) AS DOUBLE), 6) AS "max" FROM {source}"""


@BOOK.add("a6_profile", f"WITH {P.FINE} " + " UNION ALL ".join(_profile_sql("fine", m) for m in METRICS))
def a6_profile(spark, sf):
    out = profile.variable_profile(profile.prepare(P.fine(spark, sf), P.DENSE_ROLES), METRICS)
    return shaped(out, "variable", doubles="mean std_dev min q1 median q3 max")


def _outlier_sql(source: str, m: str, zscore: bool) -> str:
    z = f", COUNT(CASE WHEN s > 0 AND ABS(({m} - a) / s) > 3 THEN 1 END) AS z_count" if zscore else ""
    return f"""SELECT '{m}' AS variable, ROUND(MIN(q1 - 1.5 * (q3 - q1)), 6) AS lower_bound, ROUND(MIN(q3 + 1.5 * (q3 - q1)), 6) AS upper_bound,
      COUNT(CASE WHEN {m} < q1 - 1.5 * (q3 - q1) OR {m} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS iqr_count{z}
      FROM {source}, (SELECT QUANTILE_CONT(CAST({m} AS DOUBLE), 0.25) AS q1, QUANTILE_CONT(CAST({m} AS DOUBLE), 0.75) AS q3, AVG({m}) AS a,
        STDDEV_POP({m}) AS s FROM {source})"""


@BOOK.add("a7_iqr_outliers", f"WITH {P.DENSE} " + " UNION ALL ".join(_outlier_sql("dense", m, False) for m in METRICS))
def a7_iqr_outliers(spark, sf):
    return shaped(profile.outliers(_prepared(spark, sf), METRICS), "variable", "iqr_count", "lower_bound upper_bound")


@BOOK.add("a8_z_outliers", f"WITH {P.FINE} " + " UNION ALL ".join(_outlier_sql("fine", m, True) for m in METRICS))
def a8_z_outliers(spark, sf):
    out = profile.outliers(profile.prepare(P.fine(spark, sf), P.DENSE_ROLES), METRICS, include_zscore=True)
    return shaped(out, "variable", "iqr_count z_count", "lower_bound upper_bound")


@BOOK.add(
    "a9_variable_trend",
    f"""WITH {P.TOTALS}, monthly AS (SELECT month_label AS month, SUM(trx) AS total FROM totals GROUP BY 1),
      b AS (SELECT QUANTILE_CONT(total, 0.25) AS q1, QUANTILE_CONT(total, 0.75) AS q3 FROM monthly)
      SELECT month, ROUND(total, 6) AS total, total < q1 - 1.5 * (q3 - q1) OR total > q3 + 1.5 * (q3 - q1) AS is_outlier FROM monthly, b""",
)
def a9_variable_trend(spark, sf):
    return shaped(profile.monthly_variable_trend(_prepared(spark, sf), "trx"), "month", doubles="total", flags="is_outlier")


def _describe_sql(m: str) -> str:
    return f"""SELECT '{m}' AS variable, COUNT({m}) AS "count", ROUND(AVG({m}), 6) AS mean, ROUND(STDDEV_SAMP({m}), 6) AS std,
      ROUND(CAST(MIN({m}) AS DOUBLE), 6) AS "min", ROUND(QUANTILE_CONT(CAST({m} AS DOUBLE), 0.25), 6) AS p25,
      ROUND(QUANTILE_CONT(CAST({m} AS DOUBLE), 0.5), 6) AS p50, ROUND(QUANTILE_CONT(CAST({m} AS DOUBLE), 0.75), 6) AS p75,
      ROUND(CAST(MAX({m}) AS DOUBLE), 6) AS "max" FROM dense"""


@BOOK.add("a10_describe", f"WITH {P.DENSE} " + " UNION ALL ".join(_describe_sql(m) for m in METRICS))
def a10_describe(spark, sf):
    out = profile.describe(_prepared(spark, sf), METRICS)
    return shaped(out, "variable", "count", "mean std min p25 p50 p75 max")


def _corr_sql(a: str, b: str) -> str:
    if "flat" in (a, b):
        return f"SELECT '{a}' AS a, '{b}' AS b, 0.0 AS correlation"
    return f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CORR({a}, {b}), 6) + 0.0 AS correlation FROM dense"


@BOOK.add(
    "a11_correlations",
    f"WITH {P.DENSE} " + " UNION ALL ".join(_corr_sql(a, b) for a in [*METRICS, "flat"] for b in [*METRICS, "flat"]),
)
def a11_correlations(spark, sf):
    panel = _prepared(spark, sf).withColumn("flat", F.lit(2.0))
    return shaped(profile.correlations(panel, [*METRICS, "flat"]), "a b", doubles="correlation")


def _gappy_corr_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, ROUND(COALESCE(CASE WHEN MIN({a}) < MAX({a}) AND MIN({b}) < MAX({b}) THEN CORR({a}, {b}) END, 0), 6) + 0.0 AS correlation
      FROM gappy WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""


_GAPPY = ", ".join(f"CASE WHEN {m} = {i} THEN NULL ELSE {m} END AS {m}" for i, m in enumerate(METRICS))


@BOOK.add(
    "a11_correlations_with_gaps",
    f"WITH {P.DENSE}, gappy AS (SELECT {_GAPPY} FROM dense) " + " UNION ALL ".join(_gappy_corr_sql(a, b) for a in METRICS for b in METRICS),
)
def a11_correlations_with_gaps(spark, sf):
    panel = _prepared(spark, sf)
    panel = panel.withColumns({m: F.when(F.col(m) != i, F.col(m)) for i, m in enumerate(METRICS)})
    return shaped(profile.correlations(panel, METRICS), "a b", doubles="correlation")


@BOOK.add("a12_row_counts", f"WITH {P.DENSE} SELECT COUNT(*) AS total_rows, COUNT(*) AS sampled_rows FROM dense")
def a12_row_counts(spark, sf):
    return shaped(profile.row_counts(_prepared(spark, sf)), "", "total_rows sampled_rows")


@BOOK.add(
    "a13_explore",
    f"""WITH {P.TOTALS}, p AS ({_profile_sql("totals", "trx")}) SELECT 'Outcomes' AS selected_group, variable, mean, median,
      (SELECT ROUND(AVG(CASE WHEN action_total > 0 THEN 1.0 ELSE 0.0 END), 6) FROM totals) AS action_uptake_rate,
      (SELECT COUNT(*) FROM totals) AS total_rows FROM p""",
)
def a13_explore(spark, sf):
    found = profile.explore(P.dense(spark, sf), P.DENSE_ROLES, "Outcomes", "no such variable", include_zscore=True)
    out = found["variable_profile"].crossJoin(F.broadcast(found["rates"])).withColumn("selected_group", F.lit(found["selected_group"]))
    return shaped(out, "selected_group variable", "total_rows", "mean median action_uptake_rate")


@BOOK.add(
    "o2_order_rows",
    f"""WITH {P.DENSE} SELECT hcp_id, rep_id, CAST(week_end_date AS VARCHAR) AS week, trx FROM dense ORDER BY trx DESC, hcp_id, rep_id, week""",
)
def o2_order_rows(spark, sf):
    out = P.dense(spark, sf).orderBy(F.col("trx").desc(), "hcp_id", "rep_id", "week_end_date")
    return shaped(out.withColumn("week", F.col("week_end_date")), "hcp_id rep_id week", doubles="trx")


@BOOK.add(
    "o3_ranking",
    f"""WITH {P.DENSE} SELECT hcp_id, SUM(trx) AS total FROM dense GROUP BY 1 ORDER BY total DESC, hcp_id""",
)
def o3_ranking(spark, sf):
    totals = P.dense(spark, sf).groupBy("hcp_id").agg(F.sum("trx").alias("total"))
    return shaped(report.rank_by(totals, "total", "hcp_id"), "hcp_id", doubles="total")


@BOOK.add(
    "o4_last_months",
    f"""WITH {P.TOTALS}, monthly AS (SELECT month_label AS month, {_SUMS} FROM totals GROUP BY 1) SELECT * FROM monthly ORDER BY month DESC LIMIT 12""",
)
def o4_last_months(spark, sf):
    return shaped(profile.monthly_totals(_prepared(spark, sf), METRICS, points=12), "month", doubles=" ".join(METRICS))
