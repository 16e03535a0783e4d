"""Registered queries: encoders, fits, chains, model inspection.

Linear fits are checked against SQL regression; boosted and logistic fits have no SQL form and are
covered by the invariants in the tests. One chain per input folder is fitted and shared.
"""

from __future__ import annotations

from functools import cache
from uuid import uuid4

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.functions import skew
from paneleffect.operators import encode, ensembles, features, models, report, scenario
from paneleffect.plans import lift, recipes, store, wide
from paneleffect.registry import panels as P
from paneleffect.registry import refit
from paneleffect.registry.book import BOOK, shaped

START, END = "1994-01-02", "1997-06-01"
OVERRIDES = {"theme_f_qualified": "sum", "theme_o_qualified": "sum", "covariate_path_b_lines": "sum"}
_SEGMENT, _COUNT = "covariate_path_a_segment", "suggestion_count"


def _week(df: DataFrame) -> DataFrame:
    return df.withColumn("week", F.col("week_end_date"))


def _effect_config(path: str) -> config.ModelConfig:
    return lift.model_config(f"{path}_TreatmentEffectModel", "call", "call", config.OUTCOME_TYPES[0], START, END, config.DEFAULT_ADSTOCK)


@cache
def _propensity_a(app: str, spark: SparkSession, sf: str) -> lift.Fitted:
    return lift.fit_propensity_a(P.long(spark, sf), _effect_config("PathA"), params=refit.EXACT)


@cache
def _fits_a(app: str, spark: SparkSession, sf: str) -> lift.FitsA:
    return lift.fit_path_a(P.long(spark, sf), _effect_config("PathA"), params=refit.EXACT, propensity=propensity_a(spark, sf))


@cache
def _path_a(app: str, spark: SparkSession, sf: str) -> lift.PathA:
    return lift.run_path_a(P.long(spark, sf), _effect_config("PathA"), theme_run=True, params=refit.EXACT, fits=fits_a(spark, sf))


@cache
def _path_b(app: str, spark: SparkSession, sf: str) -> lift.PathB:
    return lift.run_path_b(P.long(spark, sf), path_a(spark, sf), _effect_config("PathB"), params=refit.EXACT, overrides=OVERRIDES)


def propensity_a(spark: SparkSession, sf: str) -> lift.Fitted:
    """The chain's steps, each computed when a query first needs it: path A's first model, both its models, its scenarios."""
    return _propensity_a(spark.sparkContext.applicationId, spark, sf)


def fits_a(spark: SparkSession, sf: str) -> lift.FitsA:
    return _fits_a(spark.sparkContext.applicationId, spark, sf)


def path_a(spark: SparkSession, sf: str) -> lift.PathA:
    return _path_a(spark.sparkContext.applicationId, spark, sf)


def chain(spark: SparkSession, sf: str) -> tuple[lift.PathA, lift.PathB]:
    """The whole chain with small ensembles, which SQL fits again from the tables alone."""
    return path_a(spark, sf), _path_b(spark.sparkContext.applicationId, spark, sf)


@cache
def _wide(app: str, spark: SparkSession, sf: str) -> wide.WideRun:
    return wide.run(P.dense(spark, sf))


def wide_run(spark: SparkSession, sf: str) -> wide.WideRun:
    return _wide(spark.sparkContext.applicationId, spark, sf)


@cache
def _linear(app: str, spark: SparkSession, sf: str):
    panel = P.path_a_panel(spark, sf)
    encoder = encode.fit_encoder(panel, [_COUNT])
    encoded = encode.encode(panel, encoder)
    scored, model = models.fit_score(encoded, "action_count", kind="LinearRegression", params={"solver": "normal"})
    return encoder, encoded, scored, model


def linear(spark: SparkSession, sf: str):
    """Actions regressed on suggestions: a fit SQL can repeat."""
    return _linear(spark.sparkContext.applicationId, spark, sf)


_MATRIX = f"""{P.LONG}, path_a AS (SELECT * FROM long WHERE suggestion_type = 'call' AND action_type = 'call' AND outcome_type = 'trx'),
  counted AS (SELECT {_SEGMENT} AS label, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {_SEGMENT}) AS position FROM path_a GROUP BY 1)"""


def _encoded(spark, sf):
    panel = P.path_a_panel(spark, sf)
    encoder = encode.fit_encoder(panel, [_SEGMENT, _COUNT])
    return encoder, encode.encode(panel, encoder)


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_HOT = ", ".join(
    f"ROUND(CASE WHEN {_SEGMENT} = '{s}' THEN 1 ELSE 0 END / STDDEV_SAMP(CASE WHEN {_SEGMENT} = '{s}' THEN 1 ELSE 0 END) OVER (), 6) AS \"{_SEGMENT}_{s}\""
    for s in _SEGMENTS
)
_MATRIX_COLUMNS = [f"{_SEGMENT}_{s}" for s in _SEGMENTS] + [_COUNT]


@BOOK.add(
    "m1_encoder",
    f"""WITH {_MATRIX} SELECT rep_id, customer_id, CAST(week_end_date AS VARCHAR) AS week_end_date, {_HOT},
      ROUND({_COUNT} / STDDEV_SAMP({_COUNT}) OVER (), 6) AS {_COUNT} FROM path_a""",
)
def m1_encoder(spark, sf):
    encoder, encoded = _encoded(spark, sf)
    out = report.model_matrix(encoded, encoder, ["rep_id", "customer_id", "week_end_date"])
    return shaped(out, "rep_id customer_id week_end_date", doubles=" ".join(_MATRIX_COLUMNS))


@BOOK.add(
    "x4_feature_labels",
    f"""WITH {_MATRIX} SELECT position, '{_SEGMENT}_' || label AS feature FROM counted
      UNION ALL SELECT (SELECT COUNT(*) + 1 FROM counted), '{_COUNT}'""",
)
def x4_feature_labels(spark, sf):
    encoder, _ = _encoded(spark, sf)
    rows = list(enumerate(encode.feature_labels(encoder), 1))
    return shaped(spark.createDataFrame(rows, "position int, feature string"), "feature", "position")


@BOOK.add(
    "x7_model_matrix",
    f"""WITH {_MATRIX}, x AS (SELECT *, {_COUNT} / STDDEV_SAMP({_COUNT}) OVER () AS scaled FROM path_a)
      SELECT customer_id, rep_id, CAST(week_end_date AS VARCHAR) AS week_end_date, ROUND(scaled, 6) AS {_COUNT} FROM x
      WHERE rep_id = 'R2' AND week_end_date >= DATE '1996-01-07' ORDER BY customer_id, week_end_date""",
)
def x7_model_matrix(spark, sf):
    encoder, encoded, _, _ = linear(spark, sf)
    filters = [F.col("rep_id") == "R2", F.col("week_end_date") >= F.to_date(F.lit("1996-01-07"))]
    keys = ["customer_id", "rep_id", "week_end_date"]
    out = report.model_matrix(encoded, encoder, keys, filters, [F.col("customer_id"), F.col("week_end_date")])
    return shaped(out, "customer_id rep_id week_end_date", doubles=_COUNT)


def _recipe_config(model_type: str, outcome: str = "trx", adstock: bool = True):
    return lift.model_config(
        model_type, "call", "call", outcome, "1994-01-02", "1996-12-29", config.DEFAULT_ADSTOCK if adstock else None
    )


@BOOK.add(
    "m2_path_a_engineer",
    f"""WITH {P.PREDICTIONS}, a AS (SELECT * FROM path_a WHERE week_end_date < DATE '1996-12-29'),
      s AS (SELECT rep_id, customer_id, week_end_date, propensity_a FROM af WHERE action_count > 0),
      p AS (SELECT a.*, s.propensity_a, COALESCE((SUM(CASE WHEN suggestion_count > 0 THEN 1.0 ELSE 0.0 END) OVER w
          - CASE WHEN suggestion_count > 0 THEN 1.0 ELSE 0.0 END) / NULLIF(COUNT(*) OVER w - 1, 0), 0) AS other,
          CAST(SUM(action_count) OVER (PARTITION BY a.week_end_date) AS BIGINT) AS idx
        FROM a LEFT JOIN s USING (rep_id, customer_id, week_end_date) WINDOW w AS (PARTITION BY rep_id, week_end_date)),
      c AS (SELECT x.rep_id, x.customer_id, x.week_end_date,
          SUM(POWER(0.3, (x.week_end_date - y.week_end_date) / 7) * y.suggestion_count) AS sa, SUM(POWER(0.3, (x.week_end_date - y.week_end_date) / 7) * y.other) AS oa,
          SUM(POWER(0.69, (x.week_end_date - y.week_end_date) / 7) * y.action_count) AS aa
        FROM p x JOIN p y ON x.rep_id = y.rep_id AND x.customer_id = y.customer_id AND y.week_end_date BETWEEN x.week_end_date - 28 AND x.week_end_date GROUP BY 1, 2, 3)
      SELECT rep_id, customer_id, CAST(week_end_date AS VARCHAR) AS week, COALESCE(propensity_a, 0) AS propensity, ROUND(other, 9) AS percent_other_hcps_suggested, idx AS action_count_global_index,
        ROUND(sa, 9) AS suggestion_count_adstock, ROUND(oa, 9) AS percent_other_hcps_suggested_adstock, ROUND(aa, 9) AS action_count_adstock
      FROM p JOIN c USING (rep_id, customer_id, week_end_date) WHERE week_end_date >= DATE '1994-01-02'""",
)
def m2_path_a_engineer(spark, sf):
    cfg = _recipe_config("PathA_TreatmentEffectModel")
    scores = P.actions_factual(spark, sf).where(F.col("action_count") > 0).select(
        *config.PATH_A_KEYS, F.col("propensity_a").alias(cfg.propensity_column)
    )
    out = recipes.prepare(P.long(spark, sf), cfg, scores, from_start_date=True).data
    out = _week(out).withColumn("propensity", F.col(cfg.propensity_column))
    doubles = "propensity percent_other_hcps_suggested suggestion_count_adstock percent_other_hcps_suggested_adstock action_count_adstock"
    return shaped(out, "rep_id customer_id week", "action_count_global_index", doubles, decimals=9)


@BOOK.add(
    "m3_path_b_recipe",
    f"""WITH {P.PREDICTIONS}, b AS (SELECT * FROM path_b WHERE outcome_type = 'trx' AND week_end_date < DATE '1996-12-29'),
      s AS (SELECT customer_id, week_end_date, propensity_b FROM bf WHERE outcome_type = 'trx' AND action_count > 1),
      c AS (SELECT x.customer_id, x.week_end_date, SUM(POWER(0.3, (x.week_end_date - y.week_end_date) / 7) * y.suggestion_count) AS sa,
          SUM(POWER(0.69, (x.week_end_date - y.week_end_date) / 7) * y.action_count) AS aa
        FROM b x JOIN b y ON x.customer_id = y.customer_id AND y.week_end_date BETWEEN x.week_end_date - 28 AND x.week_end_date GROUP BY 1, 2)
      SELECT customer_id, CAST(week_end_date AS VARCHAR) AS week, action_count, outcome_count, COALESCE(propensity_b, 0) AS propensity,
        ROUND(sa, 9) AS suggestion_count_adstock, ROUND(aa, 9) AS action_count_adstock
      FROM b JOIN c USING (customer_id, week_end_date) LEFT JOIN s USING (customer_id, week_end_date)""",
)
def m3_path_b_recipe(spark, sf):
    cfg = _recipe_config("PathB_TreatmentEffectModel")
    scores = P.outcomes_factual(spark, sf).where((F.col("outcome_type") == "trx") & (F.col("action_count") > 1)).select(
        *config.PATH_B_KEYS, F.col("propensity_b").alias(cfg.propensity_column)
    )
    out = recipes.prepare(P.long(spark, sf), cfg, scores, overrides=OVERRIDES).data
    out = _week(out).withColumn("propensity", F.col(cfg.propensity_column))
    return shaped(out, "customer_id week", doubles="action_count outcome_count propensity suggestion_count_adstock action_count_adstock", decimals=9)


_REGRESSION = f"""{_MATRIX}, g AS (SELECT REGR_SLOPE(action_count, {_COUNT}) AS b, REGR_INTERCEPT(action_count, {_COUNT}) AS a,
  STDDEV_SAMP({_COUNT}) AS s FROM path_a)"""
_PREDICTED = f"""WITH {_REGRESSION} SELECT rep_id, customer_id, CAST(week_end_date AS VARCHAR) AS week, ROUND(a + b * {_COUNT}, 6) AS """


@BOOK.add("m4_linear_fit", f"{_PREDICTED} prediction FROM path_a, g")
def m4_linear_fit(spark, sf):
    _, _, scored, _ = linear(spark, sf)
    return shaped(_week(scored), "rep_id customer_id week", doubles="prediction")


@BOOK.add("m6_score", f"{_PREDICTED} prediction FROM path_a, g")
def m6_score(spark, sf):
    _, encoded, _, model = linear(spark, sf)
    return shaped(_week(models.score(encoded, model)), "rep_id customer_id week", doubles="prediction")


@BOOK.add("p16_propensity_linear", f"{_PREDICTED} propensity FROM path_a, g")
def p16_propensity_linear(spark, sf):
    _, _, scored, model = linear(spark, sf)
    return shaped(_week(models.propensity_scores(scored, model, "propensity")), "rep_id customer_id week", doubles="propensity")


@BOOK.add("x6_linear_contributions", f"WITH {_REGRESSION} SELECT '{_COUNT}' AS feature, ROUND(b * s, 6) AS contribution FROM g")
def x6_linear_contributions(spark, sf):
    encoder, _, _, model = linear(spark, sf)
    return shaped(report.contributions(spark, encoder, model), "feature", doubles="contribution")


_KEYS = "rep_id, customer_id, CAST(week_end_date AS VARCHAR) AS week"


def _r9(*columns: str) -> str:
    """SQL: ``column`` or ``expression AS name``, to nine decimals, without a negative zero."""
    pairs = [c.rsplit(" AS ", 1) if " AS " in c else (c, c) for c in columns]
    return ", ".join(f"ROUND({value}, 9) + 0.0 AS {name}" for value, name in pairs)


@BOOK.add("m4_boosted_fit", f"{refit.FIT_PROPENSITY_A} SELECT {_KEYS}, {_r9('suggestion_count', 'prediction')} FROM a0 JOIN pa USING (k)")
def m4_boosted_fit(spark, sf):
    """Suggestion propensity of path A, scored on the rows it was fitted on."""
    return shaped(_week(propensity_a(spark, sf).scored), "rep_id customer_id week", doubles="suggestion_count prediction", decimals=9)


def _nodes(f: lift.Fitted) -> DataFrame:
    return ensembles.nodes(f.model, encode.feature_labels(f.encoder), f.encoder.stages[-1].std.toArray().tolist())


def _node_rows(f: lift.Fitted) -> DataFrame:
    out = _nodes(f).withColumn("left_values", F.array_join(F.col("left_values").cast("array<string>"), ","))
    return shaped(out, "feature left_values", "tree node left_node right_node rows", "weight threshold value")


@BOOK.add("m4_ensemble_nodes", f"{refit.FIT_PROPENSITY_A} {refit.node_rows('pa', refit.PROPENSITY_A)}")
def m4_ensemble_nodes(spark, sf):
    """The fitted propensity trees as a table of nodes."""
    return _node_rows(propensity_a(spark, sf))


@BOOK.add("m7_ensemble_nodes", f"{refit.FIT_A} {refit.node_rows('ea', refit.EFFECT_A)}")
def m7_ensemble_nodes(spark, sf):
    return _node_rows(fits_a(spark, sf).effect)


@BOOK.add(
    "m5_model_labels",
    f"""WITH {P.LONG}, rows AS (SELECT * FROM long WHERE suggestion_type = 'call' AND action_type = 'call' AND week_end_date < DATE '{refit.END}')
      SELECT 'PathA_PropensityModel' AS model, '' AS outcome_type, 'suggestion_count' AS label, {_r9("SUM(suggestion_count) AS total")} FROM rows WHERE outcome_type = 'nbrx'
      UNION ALL SELECT 'PathA_TreatmentEffectModel', '', 'action_count', ROUND(SUM(action_count), 9) FROM rows WHERE outcome_type = 'nbrx'
      UNION ALL SELECT 'PathB_PropensityModel', outcome_type, 'action_count', ROUND(SUM(action_count), 9) FROM rows GROUP BY outcome_type
      UNION ALL SELECT 'PathB_TreatmentEffectModel', outcome_type, 'outcome_count', ROUND(SUM(outcome_count), 9) FROM rows GROUP BY outcome_type""",
)
def m5_model_labels(spark, sf):
    """Total of each model's label over the rows it was fitted on."""
    a, b = chain(spark, sf)
    fitted = [("", a.propensity), ("", a.effect), *((o, m) for o, m in b.propensity.items()), *((o, m) for o, m in b.effect.items())]
    parts = []
    for outcome, f in fitted:
        label = config.MODEL_LABELS[f.config.model_type]
        total = f.scored.agg(F.sum(label).alias("total"))
        parts.append(total.select(F.lit(f.config.model_type).alias("model"), F.lit(outcome).alias("outcome_type"), F.lit(label).alias("label"), "total"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return shaped(out, "model outcome_type label", doubles="total")


@BOOK.add("m7_fit_and_score", f"{refit.FIT_A} SELECT {_KEYS}, {_r9('action_count', 'prediction')} FROM a3 JOIN ea USING (k)")
def m7_fit_and_score(spark, sf):
    """Action effect model of path A, fitted and scored."""
    return shaped(_week(fits_a(spark, sf).effect.scored), "rep_id customer_id week", doubles="action_count prediction", decimals=9)


@BOOK.add("m7_full_sized_fit", "SELECT CAST(tree AS BIGINT) AS tree, TRUE AS leaves_hold, TRUE AS walk_agrees FROM RANGE(0, 20) t(tree)")
def m7_full_sized_fit(spark, sf):
    """A fit of path A's effect with the usual parameters: per tree, whether every leaf is its rows' mean target; and whether
    the walk down the node table predicts what the model does, on every row."""
    a = fits_a(spark, sf)
    scored, model = models.fit_score(a.effect.scored.drop("prediction"), "action_count")
    rows = skew.durable(ensembles.add_leaves(scored, ensembles.nodes(model, encode.feature_labels(a.effect.encoder))).select("action_count", "prediction", ensembles.LEAVES))
    agrees = rows.agg(F.bool_and(F.abs(ensembles.walked_prediction() - F.col("prediction")) < 1e-9).alias("walk_agrees"))
    holds = ensembles.leaf_report(rows, "action_count").groupBy("tree").agg(F.bool_and(F.abs(F.col("mean_target") - F.col("value")) < 1e-9).alias("leaves_hold"))
    return shaped(holds.crossJoin(F.broadcast(agrees)), "", "tree", flags="leaves_hold walk_agrees")


@BOOK.add("m9_importances", f"{refit.FIT_A} SELECT feature AS feature_name, importance FROM ({refit.importance_rows('ea', refit.EFFECT_A)})")
def m9_importances(spark, sf):
    effect = fits_a(spark, sf).effect
    return shaped(report.importances(spark, effect.encoder, effect.model), "feature_name", doubles="importance")


@BOOK.add("x5_flat_stages")
def x5_flat_stages(spark, sf):
    effect = fits_a(spark, sf).effect
    stages = report.flat_stages(effect.encoder, effect.model)
    rows = [(i, type(s).__name__) for i, s in enumerate(stages, 1)]
    return spark.createDataFrame(rows, "position int, stage string")


_EXPLAINED = {
    "PathA_PropensityModel": ("pa", refit.PROPENSITY_A),
    "PathB_PropensityModel": ("pbnbrx", refit.PROPENSITY_B),
    "PathA_TreatmentEffectModel": ("ea", refit.EFFECT_A),
    "PathB_TreatmentEffectModel__nbrx": ("ebnbrx", refit.EFFECT_B),
    "PathB_TreatmentEffectModel__trx": ("ebtrx", refit.EFFECT_B),
}
_CONTRIBUTIONS = " UNION ALL ".join(
    f"SELECT '{model}' AS model, feature, importance AS contribution FROM ({refit.importance_rows(n, features)})" for model, (n, features) in _EXPLAINED.items()
)


@BOOK.add("x6_boosted_contributions", f"{refit.CHAIN} {_CONTRIBUTIONS}")
def x6_boosted_contributions(spark, sf):
    """One table over all fitted models."""
    a, b = chain(spark, sf)
    fitted = {
        "PathA_PropensityModel": a.propensity,
        "PathB_PropensityModel": b.propensity["nbrx"],
        "PathA_TreatmentEffectModel": a.effect,
        "PathB_TreatmentEffectModel__nbrx": b.effect["nbrx"],
        "PathB_TreatmentEffectModel__trx": b.effect["trx"],
    }
    out = scenario.stack({n: report.contributions(spark, f.encoder, f.model) for n, f in fitted.items()}, "model")
    return shaped(out, "model feature", doubles="contribution")


@cache
def _design(app: str, spark: SparkSession, sf: str):
    """The wide panel with history, ids and months as features; some suggestion flags are missing."""
    frame = features.build_features(P.dense(spark, sf), P.DENSE_ROLES, leak_safe=True, store=True)
    base = frame.data.withColumn("treated_suggestion", F.when(F.col("trx") % 7 != 0, F.col("treated_suggestion")))
    encoder = encode.fit_wide_encoder(base, refit.HISTORY, ("rep_id", "month"))
    return encoder, skew.durable_for_fitting(encode.encode_wide(base, encoder))


def design(spark: SparkSession, sf: str):
    return _design(spark.sparkContext.applicationId, spark, sf)


@cache
def _arms(app: str, spark: SparkSession, sf: str):
    _, encoded = design(spark, sf)
    action = models.fit_effects(encoded, {"action_total": "incremental_actions"}, "treated_suggestion", params=refit.EXACT)
    rows = skew.durable_for_fitting(encode.append_feature(action.data, "incremental_actions", "features_b"))
    targets = {"trx": "incremental_trx", "nbrx": "incremental_nbrx"}
    return action, models.fit_effects(rows, targets, "treated_action", "features_b", config.OUTCOME_ARM_SEED, refit.EXACT)


def arms(spark: SparkSession, sf: str):
    """Both T-learners of the wide panel with small ensembles, which SQL fits again."""
    return _arms(spark.sparkContext.applicationId, spark, sf)


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("week", F.col("week_end_date").cast("date"))


_WIDE_KEYS = "hcp_id, rep_id, CAST(week_end_date AS VARCHAR) AS week"


@BOOK.add("m10_logistic_propensity", f"{refit.LOGISTIC} SELECT {_WIDE_KEYS}, treated_action, ROUND(p, 4) + 0.0 AS propensity FROM wide JOIN lr USING (k)")
def m10_logistic_propensity(spark, sf):
    """A fit on two features to the end of its convergence; SQL takes Newton's steps."""
    _, encoded = design(spark, sf)
    rows = VectorAssembler(inputCols=["suggestion_total", "lag_action_total_1"], outputCol="two").transform(encoded)
    fit = models.fit_logistic_propensity(rows, features="two", out="propensity", tol=1e-14)
    out = shaped(_day(fit.data), "hcp_id rep_id week", "treated_action", "propensity", decimals=4)
    return out.withColumn("treated_action", F.col("treated_action").cast("int"))


_POSITIONS = " UNION ALL ".join(f"SELECT '{name}' AS feature" for name in ("(intercept)", *refit.WIDE))


@BOOK.add("m10_score_equations", f"SELECT feature, TRUE AS holds FROM ({_POSITIONS})")
def m10_score_equations(spark, sf):
    """Each position's score equation of a fit on the whole design leaves nothing over."""
    encoder, encoded = design(spark, sf)
    fit = models.fit_logistic_propensity(encoded, out="propensity", tol=1e-10)
    left = models.score_equations(fit.data, fit.model, "treated_action", encoder.labels(), probability="propensity")
    return left.select("feature", (F.abs("remainder") < 1e-5).alias("holds"))


@BOOK.add(
    "p16_propensity_logistic",
    f"""{refit.LOGISTIC} SELECT '(intercept)' AS feature, ROUND(a, 3) + 0.0 AS coefficient, TRUE AS recomputed FROM lrb9
      UNION ALL SELECT 'suggestion_total', ROUND(b, 3) + 0.0, TRUE FROM lrb9 UNION ALL SELECT 'lag_action_total_1', ROUND(c, 3) + 0.0, TRUE FROM lrb9""",
)
def p16_propensity_logistic(spark, sf):
    """Coefficients of the fit, and whether every row's score is the logistic function of them."""
    _, encoded = design(spark, sf)
    names = ["suggestion_total", "lag_action_total_1"]
    rows = VectorAssembler(inputCols=names, outputCol="two").transform(encoded)
    fit = models.fit_logistic_propensity(rows, features="two", out="propensity", tol=1e-14)
    left = models.score_equations(fit.data, fit.model, "treated_action", names, "two", "propensity")
    b = {r["feature"]: r["coefficient"] for r in left.collect()}
    again = 1 / (1 + F.exp(-(F.lit(b["(intercept)"]) + F.col(names[0]) * b[names[0]] + F.col(names[1]) * b[names[1]])))
    same = fit.data.agg(F.bool_and(F.abs(again - F.col("propensity")) < 1e-12).alias("recomputed"))
    return shaped(left.crossJoin(F.broadcast(same)), "feature", doubles="coefficient", flags="recomputed", decimals=3)


@BOOK.add("m12_tlearner", f"{refit.ACTION_ARMS} SELECT {_WIDE_KEYS}, CAST(treated_suggestion AS BIGINT) AS treated_suggestion, {_r9('effect AS incremental_actions')} FROM wide JOIN ia USING (k)")
def m12_tlearner(spark, sf):
    return shaped(_day(arms(spark, sf)[0].data), "hcp_id rep_id week", "treated_suggestion", "incremental_actions", decimals=9)


@BOOK.add(
    "m13_outcome_tlearner",
    f"""{refit.OUTCOME_ARMS} SELECT {_WIDE_KEYS}, CAST(treated_action AS BIGINT) AS treated_action, {_r9('ot.effect AS incremental_trx', 'onb.effect AS incremental_nbrx')}
      FROM wide2 JOIN ot USING (k) JOIN onb USING (k)""",
)
def m13_outcome_tlearner(spark, sf):
    return shaped(_day(arms(spark, sf)[1].data), "hcp_id rep_id week", "treated_action", "incremental_trx incremental_nbrx", decimals=9)


def _leaf_rows(n: str, arm: str) -> str:
    """SQL: rows, mean target and value of every leaf of a fit. Two leaves of one parent with the same value are one."""
    leaves = " UNION ALL ".join(f"SELECT {t} AS tree, node, COUNT(*) AS c, SUM(y) AS s FROM {n}_a{t}_{refit.DEPTH} GROUP BY node" for t in range(refit.ITERATIONS))
    for level in range(refit.DEPTH, 0, -1):
        pair = f"x.node >= {2**level} AND y.node = CASE WHEN x.node % 2 = 0 THEN x.node + 1 ELSE x.node - 1 END AND x.s / x.c = y.s / y.c"
        leaves = f"""SELECT tree, node, SUM(c) AS c, SUM(s) AS s FROM (SELECT x.tree, x.c, x.s, CASE WHEN y.node IS NULL THEN x.node ELSE x.node // 2 END AS node
          FROM ({leaves}) x LEFT JOIN ({leaves}) y ON x.tree = y.tree AND {pair}) GROUP BY tree, node"""
    return f"SELECT '{arm}' AS arm, CAST(tree AS BIGINT) AS tree, node, CAST(c AS BIGINT) AS rows, ROUND(s / c, 6) + 0.0 AS mean_target, ROUND(s / c, 6) + 0.0 AS value FROM ({leaves})"


_ARMS = {"action_total_treated": "iat", "action_total_control": "iac", "trx_treated": "ott", "trx_control": "otc", "nbrx_treated": "onbt", "nbrx_control": "onbc"}


@BOOK.add("m12_ensemble_nodes", f"{refit.ACTION_ARMS} SELECT 'treated' AS arm, * FROM ({refit.node_rows('iat', refit.WIDE)}) UNION ALL SELECT 'control', * FROM ({refit.node_rows('iac', refit.WIDE)})")
def m12_ensemble_nodes(spark, sf):
    """Both arms' trees as tables of nodes."""
    names = design(spark, sf)[0].labels()
    out = scenario.stack({arm.rpartition("_")[2]: ensembles.nodes(m, names) for arm, m in arms(spark, sf)[0].models.items()}, "arm")
    out = out.withColumn("left_values", F.array_join(F.col("left_values").cast("array<string>"), ","))
    return shaped(out, "arm feature left_values", "tree node left_node right_node rows", "weight threshold value")


@BOOK.add("m13_leaf_values", f"""{refit.OUTCOME_ARMS} {" UNION ALL ".join(_leaf_rows(n, arm) for arm, n in _ARMS.items())}""")
def m13_leaf_values(spark, sf):
    """Every leaf of every arm of both T-learners: its rows, the mean of what the trees before it left, and its value."""
    encoder, _ = design(spark, sf)
    action, outcome = arms(spark, sf)
    reports = {}
    for fit, treatment, vector, names in ((action, "treated_suggestion", encode.FEATURES, encoder.labels()), (outcome, "treated_action", "features_b", [*encoder.labels(), "incremental_actions"])):
        treated = F.coalesce(F.col(treatment) == 1, F.lit(False))
        for arm, model in fit.models.items():
            label, _, side = arm.rpartition("_")
            rows = fit.data.where(treated if side == "treated" else ~treated)
            reports[arm] = ensembles.leaf_report(ensembles.add_leaves(rows, ensembles.nodes(model, names), vector), label)
    return shaped(scenario.stack(reports, "arm"), "arm", "tree node rows", "mean_target value")


@BOOK.add("m15_wide_chain")
def m15_wide_chain(spark, sf):
    """Monthly result of the wide chain."""
    run = wide_run(spark, sf)
    return run.action_monthly.join(run.outcome_monthly, "month")


_CARRIED = "suggestion_count suggestion_count_adstock percent_other_hcps_suggested".split()


@BOOK.add(
    "c1_counterfactual_actions",
    f"""{refit.COUNTERFACTUAL_A} SELECT {_KEYS}, {", ".join(f"CAST(0 AS DOUBLE) AS {c}_counterfactual" for c in _CARRIED)}, {_r9("counterfactual_action_count")} FROM ac""",
)
def c1_counterfactual_actions(spark, sf):
    doubles = " ".join(f"{c}_counterfactual" for c in _CARRIED) + " counterfactual_action_count"
    return shaped(_week(path_a(spark, sf).counterfactual), "rep_id customer_id week", doubles=doubles, decimals=9)


@BOOK.add(
    "c2_predicted_actions",
    f"""{refit.FACTUAL_A} SELECT {_KEYS}, theme, {_r9("suggestion_count AS suggestion_count_factual", "sa AS suggestion_count_adstock_factual",
      "other AS percent_other_hcps_suggested_factual", "action_count AS action_count_factual", "predicted_action_count", "propensity")} FROM af""",
)
def c2_predicted_actions(spark, sf):
    a = path_a(spark, sf)
    out = a.factual.withColumn("theme", F.lit("all")).unionByName(a.theme_factual)
    doubles = " ".join(f"{c}_factual" for c in (*_CARRIED, "action_count")) + " predicted_action_count propensity"
    return shaped(_week(out), "rep_id customer_id week theme", doubles=doubles, decimals=9)


_OUTCOME_KEYS = "customer_id, CAST(week_end_date AS VARCHAR) AS week, outcome_type"


@BOOK.add("c3_counterfactual_outcomes", f"{refit.CHAIN} SELECT {_OUTCOME_KEYS}, {_r9('counterfactual_outcome_count')} FROM bc")
def c3_counterfactual_outcomes(spark, sf):
    return shaped(_week(chain(spark, sf)[1].counterfactual), "customer_id week outcome_type", doubles="counterfactual_outcome_count", decimals=9)


@BOOK.add("c4_predicted_outcomes", f"{refit.CHAIN} SELECT {_OUTCOME_KEYS}, theme, {_r9('predicted_outcome_count', 'propensity')} FROM bf")
def c4_predicted_outcomes(spark, sf):
    b = chain(spark, sf)[1]
    out = b.factual.withColumn("theme", F.lit("all")).unionByName(b.theme_factual)
    return shaped(_week(out), "customer_id week outcome_type theme", doubles="predicted_outcome_count propensity", decimals=9)


_STUDY = f"week_end_date >= DATE '{START}' AND week_end_date < DATE '{END}'"


_THEME_SUMMARY = f"""{refit.CHAIN}, x AS (SELECT theme, SUM(predicted_action_count - counterfactual_action_count) AS incremental_action
        FROM af JOIN ac USING (rep_id, customer_id, week_end_date) WHERE {_STUDY} GROUP BY theme),
      y AS (SELECT theme, SUM(predicted_outcome_count - counterfactual_outcome_count) AS incremental_outcome
        FROM bf JOIN bc USING (customer_id, week_end_date, outcome_type) WHERE {_STUDY} GROUP BY theme)
      SELECT theme, ROUND(incremental_outcome, 6) + 0.0 AS incremental_outcome, ROUND(incremental_action, 6) + 0.0 AS incremental_action FROM x FULL JOIN y USING (theme)"""


@BOOK.add("c7_full_chain", _THEME_SUMMARY)
def c7_full_chain(spark, sf):
    """Incremental actions and outcomes of the fitted chain, by theme."""
    a, b = chain(spark, sf)
    return shaped(report.theme_summary(b.incremental, a.incremental), "theme", doubles="incremental_outcome incremental_action")


@BOOK.add("c7_store_and_reload", _THEME_SUMMARY)
def c7_store_and_reload(spark, sf):
    """Path A stored, path B run from its stored tables alone, both loaded again."""
    folder = f"{skew.shared_folder(spark)}/run-{uuid4().hex}"
    store.save(path_a(spark, sf), folder)
    run = store.run_path_b(P.long(spark, sf), folder, params=refit.EXACT, overrides=OVERRIDES)
    return shaped(report.theme_summary(run.b.incremental, run.a.incremental), "theme", doubles="incremental_outcome incremental_action")


_OBSERVED = f"""{refit.FIT_A}, az AS MATERIALIZED (SELECT k, rep_id, customer_id, week_end_date, segment, propensity, 0.0 AS sa, oa, other FROM a3),
  {refit.walked('zw', 'ea', 'az', refit.EFFECT_A)}"""


@BOOK.add(
    "c1_observed_spillover",
    f"""{_OBSERVED} SELECT {_KEYS}, {_r9("other AS percent_other_hcps_suggested_counterfactual", "GREATEST(prediction, 0) AS counterfactual_action_count")} FROM az JOIN zw USING (k)""",
)
def c1_observed_spillover(spark, sf):
    """Counterfactual actions with the rep's other customers suggested as they were."""
    a = _observed(spark.sparkContext.applicationId, spark, sf)
    return shaped(_week(a.counterfactual), "rep_id customer_id week", doubles="percent_other_hcps_suggested_counterfactual counterfactual_action_count", decimals=9)


@cache
def _observed(app: str, spark: SparkSession, sf: str):
    return lift.run_path_a(P.long(spark, sf), _effect_config("PathA"), keep_actual_spillover=True, params=refit.EXACT, fits=fits_a(spark, sf))
