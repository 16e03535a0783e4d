"""Encoders, fits, effects and their invariants."""

from decimal import Decimal

import pytest
from fixtures import planted, week, wide_sample
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paneleffect.operators import encode, ensembles, features, models, report
from paneleffect.operators.roles import detect_roles

FAST = {"maxIter": 15}


def _vector(df, columns):
    return VectorAssembler(inputCols=columns, outputCol=encode.FEATURES).transform(df)


def _mean_lift(spark, effect):
    df = _vector(planted(spark, effect), ["x"])
    out = models.fit_effects(df, {"action": "lift"}, "treated", params=FAST).data
    assert out.count() == 6000
    assert out.agg(F.min("lift")).first()[0] >= 0
    return out.agg(F.avg("lift")).first()[0]


def test_planted_effect_is_recovered(spark):
    found = _mean_lift(spark, 2.0)
    assert found == pytest.approx(2.0, rel=0.2)
    assert _mean_lift(spark, 0.0) < found / 4


def test_planted_outcome_effect(spark):
    df = _vector(planted(spark, 2.0), ["x"])
    out = models.fit_effects(df, {"action": "la", "outcome": "lo"}, "treated", params=FAST).data
    means = out.agg(F.avg("la").alias("a"), F.avg("lo").alias("o")).first()
    assert means["o"] == pytest.approx(3 * means["a"], rel=0.2)


@pytest.mark.parametrize(("kept", "want"), [("treated", 3.0), ("control", 0.0)])
def test_empty_arm_falls_back_to_arm_means(spark, kept, want):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (0, 5.0)], "treated int, y double")
    df = _vector(df.where("treated = 1" if kept == "treated" else "treated = 0"), ["y"])
    fit = models.fit_effects(df, {"y": "lift"}, "treated")
    assert fit.models == {}
    assert {r["lift"] for r in fit.data.collect()} == {want}


def test_arm_of_one_row_with_categories_is_one_leaf(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (1, "c", 5.0), (1, "a", 3.0), (0, "b", 1.0)], "treated int, word string, y double")
    encoder = encode.fit_wide_encoder(df, (), ("word",))
    fit = models.fit_effects(encode.encode_wide(df, encoder), {"y": "lift"}, "treated", params={"maxIter": 2, "maxDepth": 2})
    leaf = ensembles.nodes(fit.models["y_control"], encoder.labels()).where("tree = 0").collect()
    assert [(r["feature"], r["rows"], r["value"]) for r in leaf] == [(None, 1, 1.0)]
    lifts = {r["word"]: r["lift"] for r in fit.data.where("treated = 1").collect()}
    assert lifts == {"a": 1.5, "b": 3.0, "c": 4.0}


def test_sample_falls_back_to_its_arm_mean(spark):
    df = wide_sample(spark)
    roles = detect_roles(df.columns)
    frame = features.build_features(df, roles).data
    assert frame.where("treated_suggestion = 0").count() == 0
    fit = models.fit_effects(frame, {"action_total": "lift"}, "treated_suggestion")
    assert fit.data.agg(F.sum("lift")).first()[0] == pytest.approx(12.0)


def test_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)], "y int, s double")
    assert models.roc_auc(df, "y", "s") == pytest.approx(0.875)
    assert models.roc_auc(df.where("y = 1"), "y", "s") == 0.5


def test_logistic_propensity(spark):
    df = _vector(planted(spark, 1.0), ["x"])
    fit = models.fit_logistic_propensity(df, "treated", out="p")
    assert fit.data.agg(F.min("p"), F.max("p")).first()[0] > 0
    assert fit.auc == pytest.approx(0.7, abs=0.08)
    assert fit.data.agg(F.avg("p")).first()[0] == pytest.approx(df.agg(F.avg("treated")).first()[0], abs=0.01)
    single = models.fit_logistic_propensity(df.where("treated = 1"), "treated", out="p")
    assert single.auc == 0.5 and single.model is None


@pytest.mark.parametrize(("label", "intercept"), [(1, float("inf")), (0, float("-inf"))])
def test_score_equations_hold_with_a_single_class(spark, label, intercept):
    df = _vector(spark.createDataFrame([(label, 2.0, 0.0), (label, 4.0, 1.0), (label, 5.0, 3.0)], "treated_action int, x double, z double"), ["x", "z"])
    fit = models.fit_logistic_propensity(df, out="propensity")
    assert fit.model is None and fit.auc == 0.5
    left = {r["feature"]: (r["coefficient"], r["remainder"]) for r in models.score_equations(fit.data, fit.model, "treated_action", ["x", "z"], probability="propensity").collect()}
    assert left == {"(intercept)": (intercept, 0.0), "x": (0.0, 0.0), "z": (0.0, 0.0)}


def test_seed_only_where_taken(spark):
    df = _vector(planted(spark, 1.0, 500), ["x"])
    for kind, label in (("LinearRegression", "action"), ("LogisticRegression", "treated")):
        model = models.fit_model(df, label, kind)
        out = models.add_propensity(model.transform(df), model, "p")
        assert out.where("p is null").count() == 0
    with pytest.raises(ValueError):
        models.fit_model(df, "action", "RandomForest")


@pytest.fixture(scope="module")
def panel(spark):
    rows = [("a", 1.0, 5.0, 2.0), ("a", 2.0, None, 2.0), ("b", 3.0, float("nan"), 2.0), (None, 4.0, 1.0, 2.0)]
    return spark.createDataFrame(rows, "covariate_path_a_kind string, suggestion_count double, covariate_path_a_gap double, covariate_path_a_flat double")


PATTERNS = (r"^covariate_path_a_.*", r"^suggestion_count(_adstock)?$", r"^percent_other_hcps_suggested$")


def test_selection_reasons(spark, panel):
    df = panel.withColumns({"covariate_path_a_none": F.lit(None).cast("string"), "suggestion_count_adstock": F.col("suggestion_count") * 2})
    found = {c: (kept, why) for c, kept, why in encode.feature_report(df, PATTERNS)}
    assert found == {
        "covariate_path_a_kind": (True, "varies"),
        "suggestion_count": (False, "adstocked"),
        "covariate_path_a_gap": (True, "varies"),
        "covariate_path_a_flat": (False, "constant"),
        "covariate_path_a_none": (False, "all_null"),
        "suggestion_count_adstock": (True, "varies"),
    }


def test_encoder_keeps_rows_with_missing_or_new_values(spark, panel):
    encoder = encode.fit_encoder(panel, ["covariate_path_a_kind", "suggestion_count", "covariate_path_a_gap"])
    assert encode.feature_labels(encoder) == [
        "covariate_path_a_kind_a", "covariate_path_a_kind_b", "suggestion_count", "covariate_path_a_gap",
    ]
    new = panel.withColumn("covariate_path_a_kind", F.lit("never seen"))
    out = encode.encode(new, encoder)
    assert out.count() == 4
    assert {tuple(r[0][:2]) for r in out.select(vector_to_array(encode.FEATURES)).collect()} == {(0.0, 0.0)}
    with pytest.raises(ValueError):
        encode.fit_encoder(panel, [])


def test_scenario_frames_are_scaled_by_the_fitted_encoder(spark, panel):
    encoder = encode.fit_encoder(panel, ["suggestion_count"])
    doubled = encode.encode(panel.withColumn("suggestion_count", F.col("suggestion_count") * 2), encoder)
    plain = encode.encode(panel, encoder)
    total = lambda df: df.select(F.sum(vector_to_array(encode.FEATURES)[0])).first()[0]
    assert total(doubled) == pytest.approx(2 * total(plain))


def test_importances_and_contributions(spark):
    df = planted(spark, 2.0, 1500)
    encoder = encode.fit_encoder(df, ["x", "treated"])
    encoded = encode.encode(df, encoder)
    model = models.fit_model(encoded, "action", params={"maxIter": 5})
    rows = report.importances(spark, encoder, model).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    ranked = [r["feature_name"] for r in rows]
    assert set(ranked) == {"x", "treated"}
    assert [r["feature"] for r in report.contributions(spark, encoder, model).collect()] == ranked[::-1]
    matrix = report.model_matrix(encoded, encoder, ["id"], [F.col("id") < 10], [F.col("id").desc()])
    assert matrix.columns == ["id", "x", "treated"] and matrix.count() == 10
    other = encode.fit_encoder(df, ["x"])
    with pytest.raises(ValueError, match="contributions"):
        report.contributions(spark, other, model)


def test_one_hot_drops_the_first_category(spark):
    df = spark.createDataFrame([("b", 2), ("a", 10), (None, 2)], "k string, m int")
    out = features.one_hot_columns(df, ["k", "m"])
    assert out.columns == ["k_b", "m_10"]
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 1), (0, 0)]
    assert len(features.one_hot_columns(spark.range(60), ["id"]).columns) == 59
    assert features.one_hot_columns(df, ["m"], {"m": [2, 10, 30]}).columns == ["k", "m_10", "m_30"]


def test_wide_encoder_is_sparse_and_drops_the_first(spark):
    df = spark.createDataFrame([("b", 2, 1.5), ("a", 10, 2.5), ("c", 1, 0.5)], "k string, m int, v double")
    out = encode.encode_wide(df, encode.fit_wide_encoder(df, ["v"], ["k", "m"]))
    got = {r["k"]: list(r[encode.FEATURES].toArray()) for r in out.collect()}
    assert got == {"c": [0.5, 1.0, 0.0, 0.0, 0.0], "b": [1.5, 0.0, 1.0, 0.0, 1.0], "a": [2.5, 0.0, 0.0, 1.0, 0.0]}


def test_wide_encoder_takes_null_one_valued_and_long_categories(spark):
    rows = [("b", 10**25 + 1, 7, -3), ("", 10**25 + 2, 7, -10), (None, None, 7, 2), ("a", 10**25 + 1, None, -3)]
    df = spark.createDataFrame([(k, Decimal(i) if i else None, o, n) for k, i, o, n in rows], "k string, i decimal(30,0), o int, n int")
    encoder = encode.fit_wide_encoder(df, [], ["k", "i", "o", "n"])
    assert encoder.labels() == ["k_b", "k_a", f"i_{10**25 + 2}", "n_2", "n_-3"]
    out = encode.encode_wide(df, encoder)
    got = {(r["k"], r["n"]): list(r[encode.FEATURES].toArray()) for r in out.collect()}
    assert got == {("b", -3): [1, 0, 0, 0, 1], ("", -10): [0, 0, 1, 0, 0], (None, 2): [0, 0, 0, 1, 0], ("a", -3): [0, 1, 0, 0, 1]}
    unseen = spark.createDataFrame([("zz", Decimal(5), 1, 99)], df.schema)
    assert list(encode.encode_wide(unseen, encoder).first()[encode.FEATURES].toArray()) == [0] * 5


def test_wide_encoder_takes_any_number_of_categories(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    encoder = encode.fit_wide_encoder(df, [], ["k"])
    assert encoder.sizes == {"k": 3000}
    assert encode.encode_wide(df, encoder).select(vector_to_array(encode.FEATURES).alias("f")).agg(F.sum(F.size("f"))).first()[0] == 3000 * 2999


def test_leak_safe_features(spark):
    df = wide_sample(spark)
    roles = detect_roles(df.columns)
    safe = set(features.build_features(df, roles, leak_safe=True).numeric)
    assert not safe & {"action_total", "z_action_total", "treated_action", "z_trx", "z_nbrx", "z_action_email", "rolling4_action_total"}
    assert {"suggestion_total", "lag_action_total_1", "baseline_trx_8w"} <= safe


def test_z_scores_of_constant_and_single_row(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "v double, flat double")
    out = features.add_z_scores(df).orderBy("v").collect()
    assert [r["z_v"] for r in out] == pytest.approx([-(0.5**0.5), 0.5**0.5])
    assert {r["z_flat"] for r in out} == {0.0}
    assert features.add_z_scores(df.limit(1)).first()["z_v"] == 0.0


def test_history_ties_follow_the_tie_break(spark):
    rows = [(i, "H", "R", week(0), float(i), float(i), float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, hcp_id string, rep_id string, week_end_date date, suggestion_total double, action_total double, trx double")
    from test_skew import ROLES

    out = features.add_history(df, ROLES, ["id"]).orderBy("id").collect()
    assert [r["lag_action_total_1"] for r in out] == [0.0, 0.0, 1.0, 2.0, 3.0]
    assert [r["baseline_trx_8w"] for r in out] == [0.0, 0.0, 0.5, 1.0, 1.5]
