"""Registered queries: roles, data checks, coercion, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneleffect.config import REP_LEVEL_COVARIATES
from paneleffect.functions import scalars as S
from paneleffect.operators import checks, clean, encode, roles
from paneleffect.registry import panels as P
from paneleffect.registry.book import BOOK, shaped


@BOOK.add(
    "f1_roles",
    f"""WITH {P.DENSE}, names AS (SELECT unnest(['hcp_id', 'rep_id', 'week_end_date', 'suggestion_email', 'suggestion_call',
      'action_email', 'action_call', 'trx', 'nbrx']) AS c, generate_subscripts([1,2,3,4,5,6,7,8,9], 1) AS p),
    tagged AS (SELECT c, p, CASE WHEN c LIKE '%suggest%' OR c LIKE '%recommend%' THEN 'suggestion'
        WHEN c LIKE '%action%' OR c LIKE '%call%' OR c LIKE '%email%' OR c LIKE '%insight%' THEN 'action'
        WHEN c LIKE '%trx%' OR c LIKE '%nbrx%' OR c LIKE '%outcome%' OR c LIKE '%script%' THEN 'outcome'
        WHEN c LIKE '%date%' OR c LIKE '%week%' OR c LIKE '%month%' OR c LIKE '%time%' THEN 'time'
        WHEN c LIKE '%hcp%' OR c LIKE '%customer%' OR c LIKE '%npi%' THEN 'hcp'
        WHEN c LIKE '%rep%' OR c LIKE '%territory%' THEN 'rep' END AS role FROM names)
    SELECT role, CAST(ROW_NUMBER() OVER (PARTITION BY role ORDER BY p) AS BIGINT) AS position, c AS "column",
      (SELECT COUNT(*) FROM dense) AS panel_rows FROM tagged""",
)
def f1_roles(spark, sf):
    d = P.dense(spark, sf)
    found = roles.roles_table(spark, roles.detect_roles(d.columns))
    rows = d.agg(F.count(F.lit(1)).alias("panel_rows"))
    return shaped(found.crossJoin(F.broadcast(rows)), "role column", "position panel_rows")


@BOOK.add(
    "f2_parseable_time",
    f"WITH {P.RAW} SELECT ROUND(AVG(CASE WHEN try_cast(week_end_date AS TIMESTAMP) IS NULL THEN 0.0 ELSE 1.0 END), 6) AS parseable_share FROM raw",
)
def f2_parseable_time(spark, sf):
    return shaped(checks.parseable_time_share(P.raw(spark, sf), P.DENSE_ROLES), doubles="parseable_share")


@BOOK.add(
    "f3_ids_present",
    f"""WITH {P.RAW}, {P.EVENTS} SELECT 'raw' AS panel, bool_and(hcp_id IS NOT NULL AND rep_id IS NOT NULL) AS ids_present FROM raw
    UNION ALL SELECT 'events', bool_and(hcp_id IS NOT NULL AND rep_id IS NOT NULL) FROM events_panel""",
)
def f3_ids_present(spark, sf):
    a = checks.ids_present(P.raw(spark, sf), P.DENSE_ROLES).withColumn("panel", F.lit("raw"))
    b = checks.ids_present(P.events(spark, sf), P.EVENT_ROLES).withColumn("panel", F.lit("events"))
    return shaped(a.unionByName(b), "panel", flags="ids_present")


@BOOK.add(
    "f4_numeric_share",
    f"""WITH {P.RAW} SELECT ROUND((COUNT(try_cast(suggestion_email AS DOUBLE)) + COUNT(suggestion_call) + COUNT(action_email)
      + COUNT(action_call) + COUNT(trx) + COUNT(nbrx)) * 1.0 / (COUNT(suggestion_email) + COUNT(suggestion_call) + COUNT(action_email)
      + COUNT(action_call) + COUNT(trx) + COUNT(nbrx)), 6) AS numeric_share FROM raw""",
)
def f4_numeric_share(spark, sf):
    return shaped(checks.numeric_share(P.raw(spark, sf), P.DENSE_ROLES), doubles="numeric_share")


_GRAIN = "SELECT COALESCE(MAX(n) <= 1, FALSE) AS grain_consistent FROM (SELECT COUNT(*) AS n FROM {0} WHERE {1} GROUP BY {2})"


@BOOK.add(
    "f5_grain_check",
    f"""WITH {P.DENSE}, lines_grain AS (SELECT COUNT(*) AS n FROM lines GROUP BY c_nationkey, n_regionkey, week_end_date)
    SELECT 'panel' AS input, COALESCE(MAX(n) <= 1, FALSE) AS grain_consistent
      FROM (SELECT COUNT(*) AS n FROM dense GROUP BY hcp_id, rep_id, week_end_date)
    UNION ALL SELECT 'lines', COALESCE(MAX(n) <= 1, FALSE) FROM lines_grain""",
)
def f5_grain_check(spark, sf):
    a = checks.grain_check(P.dense(spark, sf), P.DENSE_ROLES).withColumn("input", F.lit("panel"))
    raw_lines = P.lines(spark, sf).select(
        F.col("c_nationkey").alias("hcp_id"), F.col("n_regionkey").alias("rep_id"), "week_end_date"
    )
    b = checks.grain_check(raw_lines, P.DENSE_ROLES).withColumn("input", F.lit("lines"))
    return shaped(a.unionByName(b), "input", flags="grain_consistent")


@BOOK.add(
    "f6_month_depth",
    f"""WITH {P.RAW}, {P.EVENTS} SELECT 'raw' AS panel, COUNT(DISTINCT date_trunc('month', try_cast(week_end_date AS TIMESTAMP))) AS months FROM raw
    UNION ALL SELECT 'events', COUNT(DISTINCT date_trunc('month', event_date)) FROM events_panel""",
)
def f6_month_depth(spark, sf):
    a = checks.month_depth(P.raw(spark, sf), P.DENSE_ROLES).withColumn("panel", F.lit("raw"))
    b = checks.month_depth(P.events(spark, sf), P.EVENT_ROLES).withColumn("panel", F.lit("events"))
    return shaped(a.unionByName(b), "panel", "months")


def _checklist_sql(source: str, time: str, metrics: str) -> str:
    names = metrics.split()
    good = " + ".join(f"COUNT(try_cast({m} AS DOUBLE))" for m in names)
    filled = " + ".join(f"COUNT({m})" for m in names)
    return f"""facts AS (SELECT AVG(CASE WHEN try_cast({time} AS TIMESTAMP) IS NULL THEN 0.0 ELSE 1.0 END) AS t,
      bool_and(hcp_id IS NOT NULL AND rep_id IS NOT NULL) AS ids, ({good}) * 1.0 / ({filled}) AS num,
      COUNT(DISTINCT date_trunc('month', try_cast({time} AS TIMESTAMP))) AS months FROM {source}),
    g AS (SELECT MAX(n) AS n FROM (SELECT COUNT(*) AS n FROM {source} WHERE hcp_id IS NOT NULL AND rep_id IS NOT NULL
      AND try_cast({time} AS TIMESTAMP) IS NOT NULL GROUP BY hcp_id, rep_id, try_cast({time} AS TIMESTAMP)))
    SELECT CAST(1 AS BIGINT) AS position, 'parseable_time_column' AS key, 'Parseable time column' AS label,
      CASE WHEN t >= 0.95 THEN 'pass' ELSE 'warn' END AS status, printf('%.1f%%', t * 100) || ' rows parse to datetime.' AS detail FROM facts
    UNION ALL SELECT 2, 'stable_hcp_rep_ids', 'Stable HCP/Rep IDs', CASE WHEN ids THEN 'pass' ELSE 'warn' END,
      CASE WHEN ids THEN 'All rows have HCP and Rep IDs.' ELSE 'Missing HCP/Rep IDs detected.' END FROM facts
    UNION ALL SELECT 3, 'numeric_convertible_suggestion_action_outcome', 'Numeric-convertible suggestions/actions/outcomes',
      CASE WHEN num >= 0.9 THEN 'pass' ELSE 'warn' END, printf('%.1f%%', num * 100) || ' metric values are numeric-convertible.' FROM facts
    UNION ALL SELECT 4, 'grain_consistency', 'Grain consistency', CASE WHEN n <= 1 THEN 'pass' ELSE 'warn' END,
      CASE WHEN n <= 1 THEN 'No duplicate HCP/Rep/time grain rows.' ELSE 'Duplicate grain rows found.' END FROM g
    UNION ALL SELECT 5, 'temporal_depth_for_lags', 'Enough temporal depth for lags/rolling/adstock',
      CASE WHEN months >= 6 THEN 'pass' ELSE 'warn' END, 'Detected ' || CAST(months AS VARCHAR) || ' unique months.' FROM facts"""


@BOOK.add(
    "f7_checklist",
    f"WITH {P.RAW}, {_checklist_sql('raw', 'week_end_date', 'suggestion_email suggestion_call action_email action_call trx nbrx')}",
)
def f7_checklist(spark, sf):
    return shaped(checks.checklist(P.raw(spark, sf), P.DENSE_ROLES), "key label status detail", "position")


@BOOK.add(
    "f7_checklist_events",
    f"WITH {P.EVENTS}, {_checklist_sql('events_panel', 'event_date', 'suggestion_view action_click outcome_trx')}",
)
def f7_checklist_events(spark, sf):
    return shaped(checks.checklist(P.events(spark, sf), P.EVENT_ROLES), "key label status detail", "position")


@BOOK.add(
    "f7_checklist_fine",
    f"WITH {P.FINE}, {_checklist_sql('fine', 'week_end_date', 'suggestion_email suggestion_call action_email action_call trx nbrx')}",
)
def f7_checklist_fine(spark, sf):
    return shaped(checks.checklist(P.fine(spark, sf), P.DENSE_ROLES), "key label status detail", "position")


@BOOK.add(
    "f8_safe_numeric",
    f"""WITH {P.RAW} SELECT hcp_id, rep_id, week_end_date, ROUND(COALESCE(try_cast(suggestion_email AS DOUBLE), 0.0), 6) AS suggestion_email,
      ROUND(COALESCE(trx, 0.0), 6) AS trx FROM raw""",
)
def f8_safe_numeric(spark, sf):
    out = clean.safe_numeric(P.raw(spark, sf), ["suggestion_email", "trx"])
    return shaped(out, "hcp_id rep_id week_end_date", doubles="suggestion_email trx")


@BOOK.add(
    "f9_parse_time",
    f"""WITH {P.RAW} SELECT hcp_id, rep_id, strftime(try_cast(week_end_date AS TIMESTAMP), '%Y-%m-%d') AS day, nbrx
      FROM raw WHERE try_cast(week_end_date AS TIMESTAMP) IS NOT NULL""",
)
def f9_parse_time(spark, sf):
    out = clean.parse_time(P.raw(spark, sf), "week_end_date").withColumn("day", F.date_format("week_end_date", "yyyy-MM-dd"))
    return shaped(out, "hcp_id rep_id day", doubles="nbrx")


@BOOK.add(
    "f10_model_triangle",
    f"""WITH {P.LONG} SELECT rep_id, customer_id, CAST(week_end_date AS VARCHAR) AS week, suggestion_count, action_count, outcome_count
      FROM long WHERE suggestion_type = 'email' AND action_type = 'email' AND outcome_type = 'nbrx'""",
)
def f10_model_triangle(spark, sf):
    out = clean.filter_triangle(P.long(spark, sf), "email", "email", "nbrx").withColumn("week", F.col("week_end_date"))
    return shaped(out, "rep_id customer_id week", doubles="suggestion_count action_count outcome_count")


@BOOK.add(
    "f11_study_period",
    f"""WITH {P.DENSE} SELECT hcp_id, rep_id, CAST(week_end_date AS VARCHAR) AS week, trx FROM dense
      WHERE week_end_date >= DATE '1995-01-01' AND week_end_date < DATE '1996-01-07'""",
)
def f11_study_period(spark, sf):
    out = clean.filter_period(P.dense(spark, sf), "week_end_date", "1995-01-01", "1996-01-07")
    return shaped(out.withColumn("week", F.col("week_end_date")), "hcp_id rep_id week", doubles="trx")


@BOOK.add(
    "f12_filter_list",
    f"""WITH {P.DENSE} SELECT hcp_id, rep_id, CAST(week_end_date AS VARCHAR) AS week, suggestion_call FROM dense
      WHERE rep_id = 'R1' AND suggestion_call > 1 AND trx < 100""",
)
def f12_filter_list(spark, sf):
    out = clean.filter_all(P.dense(spark, sf), [F.col("rep_id") == "R1", F.col("suggestion_call") > 1, F.col("trx") < 100])
    return shaped(out.withColumn("week", F.col("week_end_date")), "hcp_id rep_id week", "suggestion_call")


_EXCLUDED = "covariate_path_b_hcp_total_irep_emails_last_8_weeks"


@BOOK.add(
    "f13_exclude_covariates",
    f"""WITH {P.LONG} SELECT 'email' AS suggestion_type, 'email' AS action_type, COUNT(*) AS panel_rows, FALSE AS covariate_kept FROM long
      UNION ALL SELECT 'call', 'call', COUNT(*), TRUE FROM long""",
)
def f13_exclude_covariates(spark, sf):
    panel = P.long(spark, sf).withColumnRenamed("covariate_path_b_lines", _EXCLUDED)
    parts = []
    for kind in ("email", "call"):
        out = roles.drop_excluded_covariates(panel, kind, kind)
        parts.append(
            out.agg(F.count(F.lit(1)).alias("panel_rows")).select(
                F.lit(kind).alias("suggestion_type"), F.lit(kind).alias("action_type"), "panel_rows",
                F.lit(_EXCLUDED in out.columns).alias("covariate_kept"),
            )
        )
    return shaped(parts[0].unionByName(parts[1]), "suggestion_type action_type", "panel_rows", flags="covariate_kept")


def _selection_panel(spark, sf):
    """The long panel with a constant covariate, an all-null one and an adstock pair."""
    return P.long(spark, sf).withColumns(
        {
            "covariate_path_a_constant": F.lit(1.0),
            "covariate_path_a_empty": F.lit(None).cast("string"),
            "covariate_path_a_gappy": F.when(F.col("suggestion_count") > 1, F.col("outcome_count")),
            "covariate_path_a_halfzero": F.when(F.col("suggestion_count") > 1, F.lit(0.0)),
            "suggestion_count_adstock": F.col("suggestion_count") * 1.3,
            "percent_other_hcps_suggested": F.lit(0.0),
        }
    )


def _kept_sql(column: str, expression: str, kept_if: str, otherwise: str) -> str:
    return f"""SELECT '{column}' AS "column", {kept_if} AS kept, {otherwise} AS reason FROM
      (SELECT MIN({expression}) AS lo, MAX({expression}) AS hi, COUNT({expression}) AS n FROM long)"""


def _kept_all_sql() -> str:
    varies = "COALESCE(lo <> hi, FALSE)"
    why = f"CASE WHEN {varies} THEN 'varies' WHEN n = 0 THEN 'all_null' ELSE 'constant' END"
    rows = {
        "covariate_path_a_segment": "covariate_path_a_segment",
        "covariate_path_a_constant": "1.0",
        "covariate_path_a_empty": "CAST(NULL AS VARCHAR)",
        "covariate_path_a_gappy": "COALESCE(CASE WHEN suggestion_count > 1 THEN outcome_count END, 0)",
        "covariate_path_a_halfzero": "COALESCE(CASE WHEN suggestion_count > 1 THEN 0.0 END, 0)",
    }
    parts = [_kept_sql(c, e, varies, why) for c, e in rows.items()]
    parts.append(_kept_sql("suggestion_count_adstock", "suggestion_count * 1.3", "TRUE", "CASE WHEN lo <> hi THEN 'varies' ELSE 'protected' END"))
    parts.append(_kept_sql("suggestion_count", "suggestion_count", "FALSE", "'adstocked'"))
    parts.append(_kept_sql("percent_other_hcps_suggested", "0.0", "TRUE", "'protected'"))
    return " UNION ALL ".join(parts)


@BOOK.add("f14_feature_columns", f"WITH {P.LONG} {_kept_all_sql()}")
def f14_feature_columns(spark, sf):
    from paneleffect.config import FEATURE_PATTERNS

    out = encode.feature_table(_selection_panel(spark, sf), FEATURE_PATTERNS["PathA_TreatmentEffectModel"])
    return shaped(out, "column reason", flags="kept")


@BOOK.add(
    "f15_adstock_precedence",
    f"""WITH {P.LONG} SELECT "column", FALSE AS raw_kept, panel_rows FROM (VALUES ('suggestion_count')) v("column"),
      (SELECT COUNT(*) AS panel_rows FROM long)""",
)
def f15_adstock_precedence(spark, sf):
    panel = _selection_panel(spark, sf)
    kept = roles.prefer_adstock([c for c in panel.columns if c.startswith("suggestion_count")])
    rows = panel.agg(F.count(F.lit(1)).alias("panel_rows"))
    out = rows.select(F.lit("suggestion_count").alias("column"), F.lit("suggestion_count" in kept).alias("raw_kept"), "panel_rows")
    return shaped(out, "column", "panel_rows", flags="raw_kept")


@BOOK.add(
    "f16_all_null_columns",
    f"""WITH {P.LONG} SELECT 'covariate_path_a_empty' AS "column", COUNT(CAST(NULL AS VARCHAR)) = 0 AS all_null FROM long
      UNION ALL SELECT 'covariate_path_a_gappy', COUNT(CASE WHEN suggestion_count > 1 THEN outcome_count END) = 0 FROM long
      UNION ALL SELECT 'outcome_count', COUNT(outcome_count) = 0 FROM long""",
)
def f16_all_null_columns(spark, sf):
    names = ["covariate_path_a_empty", "covariate_path_a_gappy", "outcome_count"]
    return shaped(clean.all_null_columns(_selection_panel(spark, sf), names), "column", flags="all_null")


@BOOK.add(
    "f17_null_to_zero",
    f"""WITH {P.LONG} SELECT rep_id, customer_id, CAST(week_end_date AS VARCHAR) AS week, suggestion_type, outcome_type,
      ROUND(COALESCE(CASE WHEN suggestion_count > 1 THEN outcome_count END, 0), 6) AS covariate_path_a_gappy,
      CAST(NULL AS VARCHAR) AS covariate_path_a_empty FROM long""",
)
def f17_null_to_zero(spark, sf):
    panel = _selection_panel(spark, sf).withColumn(
        "covariate_path_a_gappy",
        F.when(F.col("suggestion_count") == 1, F.lit(float("nan"))).otherwise(F.col("covariate_path_a_gappy")),
    )
    out = clean.numeric_null_to_zero(panel, ["covariate_path_a_gappy", "covariate_path_a_empty"])
    out = out.withColumn("week", F.col("week_end_date"))
    return shaped(out, "rep_id customer_id week suggestion_type outcome_type covariate_path_a_empty", doubles="covariate_path_a_gappy")


@BOOK.add(
    "f18_theme_columns",
    f"""WITH {P.LONG} SELECT 'theme_f_qualified' AS theme, SUM(theme_f_qualified) AS total FROM long
      UNION ALL SELECT 'theme_o_qualified', SUM(theme_o_qualified) FROM long""",
)
def f18_theme_columns(spark, sf):
    panel = P.long(spark, sf)
    themes = roles.theme_columns(panel.columns, "call")
    out = panel.agg(*[F.sum(S.name(t)).alias(t) for t in themes]).unpivot([], themes, "theme", "total")
    return shaped(out, "theme", doubles="total")


@BOOK.add(
    "f19_drop_rep_covariates",
    f"""WITH {P.LONG} SELECT rep_id, covariate_path_a_segment, COUNT(*) AS panel_rows, FALSE AS rep_region_kept FROM long GROUP BY 1, 2""",
)
def f19_drop_rep_covariates(spark, sf):
    panel = P.long(spark, sf).withColumn(REP_LEVEL_COVARIATES[0], F.col("rep_id"))
    out = roles.drop_rep_covariates(panel)
    kept = REP_LEVEL_COVARIATES[0] in out.columns
    counted = out.groupBy("rep_id", "covariate_path_a_segment").agg(F.count(F.lit(1)).alias("panel_rows"))
    return shaped(counted.withColumn("rep_region_kept", F.lit(kept)), "rep_id covariate_path_a_segment", "panel_rows", flags="rep_region_kept")
