"""The exploratory profile and the data checks on small frames."""

import math

import numpy as np
import pytest
from fixtures import wide_sample
from pyspark.sql import functions as F

from paneleffect.functions import scalars as S
from paneleffect.operators import checks, clean, profile
from paneleffect.operators.quantiles import exact_quantiles
from paneleffect.operators.roles import detect_roles, outcome_columns, theme_columns


def test_mixed_type_metric_is_profiled(spark):
    df = wide_sample(spark)
    found = profile.explore(df, detect_roles(df.columns), "Suggestions", "suggestion_email")
    assert found["volume_trends"].count() == 5
    assert found["variable_profile"].first()["mean"] == pytest.approx(2.4)


def test_months_of_the_trend(spark):
    df = wide_sample(spark)
    found = profile.explore(df, detect_roles(df.columns), "Outcomes", "trx")
    months = {r["month"] for r in found["volume_trends"].collect()}
    assert months == {"2024-01", "2024-02", "2024-03", "2024-04", "2024-05"}


def test_planted_outlier_is_found(spark):
    df = wide_sample(spark, first_trx=1000)
    found = profile.explore(df, detect_roles(df.columns), "Outcomes", "trx", include_zscore=True)
    row = found["outliers"].first()
    assert row["iqr_count"] >= 1
    assert row["z_count"] == 1 and row["z_threshold"] == 3.0


def test_unknown_choices_fall_back(spark):
    df = wide_sample(spark)
    found = profile.explore(df, detect_roles(df.columns), "No such group", "no such variable")
    assert (found["selected_group"], found["selected_variable"]) == ("Suggestions", "suggestion_email")
    assert found["metric_groups"]["Other Variables"] == []


def test_empty_group_gives_the_profile_of_zero(spark):
    df = wide_sample(spark)
    found = profile.explore(df, detect_roles(df.columns), "Other Variables")
    assert found["selected_variable"] is None
    assert found["variable_profile"].first()["max"] == 0.0
    assert found["monthly_variable_trend"] is None


def test_checklist_of_the_sample(spark):
    df = wide_sample(spark)
    rows = {r["key"]: r for r in checks.checklist(df, detect_roles(df.columns)).collect()}
    assert [r["position"] for r in sorted(rows.values(), key=lambda r: r["position"])] == [1, 2, 3, 4, 5]
    assert rows["numeric_convertible_suggestion_action_outcome"]["detail"] == "96.7% metric values are numeric-convertible."
    assert rows["grain_consistency"]["status"] == "pass"
    assert (rows["temporal_depth_for_lags"]["status"], rows["temporal_depth_for_lags"]["detail"]) == ("warn", "Detected 5 unique months.")


def test_checklist_of_an_empty_frame(spark):
    df = wide_sample(spark).limit(0)
    rows = {r["key"]: r for r in checks.checklist(df, detect_roles(df.columns)).collect()}
    assert rows["grain_consistency"]["status"] == "warn"
    assert rows["grain_consistency"]["detail"] == "No rows to check."


def test_duplicate_grain_and_missing_ids(spark):
    df = wide_sample(spark)
    twice = df.unionByName(df.limit(1))
    roles = detect_roles(df.columns)
    assert checks.grain_check(twice, roles).first()[0] is False
    unnamed = df.withColumn("hcp_id", F.lit(None).cast("string"))
    assert checks.ids_present(unnamed, roles).first()[0] is False
    assert checks.grain_check(unnamed, roles).first()[0] is False


@pytest.mark.parametrize(
    ("text", "value"),
    [("4", 4.0), (" 4 ", 4.0), ("1e2", 100.0), ("-.5", -0.5), ("bad", 0.0), ("NaN", 0.0), ("", 0.0), (None, 0.0), ("1d", 0.0), ("2.5f", 0.0)],
)
def test_number_from_text(spark, text, value):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(S.number(df, "v")).first()[0] == value


@pytest.mark.parametrize(
    ("text", "day"),
    [("2024-01-07", "2024-01-07"), ("2024-01-07 10:30:00", "2024-01-07"), ("1/7/2024", "2024-01-07"), ("never", None), ("", None), (None, None)],
)
def test_time_from_text(spark, text, day):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(F.date_format(S.time_or_null(df, "v"), "yyyy-MM-dd")).first()[0] == day


def test_unparseable_rows_are_dropped(spark):
    df = spark.createDataFrame([("2024-01-07",), ("x",)], "v string")
    assert clean.parse_time(df, "v").count() == 1
    assert clean.parse_time(df, "v", drop_unparseable=False).count() == 2


def test_roles_report_all_missing_ones(spark):
    with pytest.raises(ValueError, match="suggestion .*action .*time .*rep "):
        detect_roles(["hcp_id", "trx"])
    with pytest.raises(ValueError, match="action "):
        detect_roles(["week", "hcp_id", "rep_id", "suggest_a", "trx"])
    roles = detect_roles(["week", "customer", "territory", "insight_suggest", "insight", "nbrx"])
    assert roles.suggestions == ("insight_suggest",) and roles.actions == ("insight",)
    with pytest.raises(ValueError, match="trx"):
        outcome_columns(roles)


def test_theme_columns_by_suggestion_type():
    names = ["theme_x_qualified", "theme_x_triggered_emails_ho_npp", "x_qualified"]
    assert theme_columns(names, "call") == ["theme_x_qualified"]
    assert theme_columns(names, "npp") == ["theme_x_triggered_emails_ho_npp"]


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_quantiles_agree_with_numpy(spark, partitions):
    """The ranges' number does not change the result; ties, gaps and empty columns are exact."""
    rng = np.random.default_rng(5)
    smooth = rng.normal(size=4001)
    heavy = np.where(rng.random(4001) < 0.4, 0.0, rng.gamma(2.0, 50.0, size=4001))
    df = spark.createDataFrame(
        [(float(a), float(b), None if i % 7 == 0 else float(a), None) for i, (a, b) in enumerate(zip(smooth, heavy))],
        "smooth double, heavy double, gappy double, empty double",
    ).repartition(8)
    levels = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = exact_quantiles(df, ["smooth", "heavy", "gappy", "empty"], levels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    gappy = np.array([a for i, a in enumerate(smooth) if i % 7])
    for column, values in (("smooth", smooth), ("heavy", heavy), ("gappy", gappy)):
        assert got[column] == pytest.approx(list(np.quantile(values, levels)), rel=1e-12)
    assert got["empty"] == [None] * len(levels)


def test_constant_column_and_single_row(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "flat double, v double")
    r = {(x["a"], x["b"]): x["correlation"] for x in profile.correlations(df, ["flat", "v"]).collect()}
    assert r[("flat", "flat")] == 0.0 and r[("flat", "v")] == 0.0 and r[("v", "v")] == pytest.approx(1.0)
    one = profile.describe(df.limit(1), ["v"]).first()
    assert one["count"] == 1 and one["std"] is None
    assert profile.outliers(df, ["flat"], include_zscore=True).first()["z_count"] == 0


def test_correlations_are_pairwise_whatever_their_number(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(200, 45))
    values[:, 1] += values[:, 0]
    values[rng.random(values.shape) < 0.2] = np.nan
    names = [f"c{k}" for k in range(45)]
    rows = [[None if np.isnan(x) else float(x) for x in row] for row in values]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    few = {(r["a"], r["b"]): r["correlation"] for r in profile.correlations(df, names[:3]).collect()}
    many = {(r["a"], r["b"]): r["correlation"] for r in profile.correlations(df, names).collect()}
    assert len(many) == 45 * 45
    both = ~np.isnan(values[:, 0]) & ~np.isnan(values[:, 1])
    want = np.corrcoef(values[both, 0], values[both, 1])[0, 1]
    assert few["c0", "c1"] == pytest.approx(want) and many["c1", "c0"] == pytest.approx(want)
    assert all(many[k] == pytest.approx(v) for k, v in few.items())


def test_correlations_by_blocks_are_the_same_and_rows_are_not_repeated(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(300, 11)) * 10.0 ** rng.integers(-3, 6, 11) + 1e6
    values[:, 4] = 7.0
    values[rng.random(values.shape) < 0.15] = np.nan
    values[3, 2], values[4, 3] = np.inf, -np.inf
    names = [f"c{k}" for k in range(11)]
    rows = [[None if np.isnan(x) and k % 2 else float(x) for k, x in enumerate(row)] for row in values]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(4)
    whole = {(r["a"], r["b"]): r["correlation"] for r in profile.correlations(df, names).collect()}
    for block in (1, 4):
        assert {(r["a"], r["b"]): r["correlation"] for r in profile.correlations(df, names, block).collect()} == pytest.approx(whole, abs=1e-9)
    finite = np.where(np.isfinite(values), values, np.nan)
    for i in range(11):
        for j in range(11):
            both = ~np.isnan(finite[:, i]) & ~np.isnan(finite[:, j])
            want = 0.0 if 4 in (i, j) else np.corrcoef(finite[both, i], finite[both, j])[0, 1]
            assert whole[names[i], names[j]] == pytest.approx(want, abs=1e-9)
    wide = spark.range(20_000, numPartitions=2).select(*[F.rand(k).alias(f"c{k}") for k in range(60)])
    plan = profile.correlations(wide, wide.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow accumulate") == 1 and "Generate" not in plan.split("MapInArrow accumulate")[1]  # rows are read once, none is repeated
    cells = profile._gram_rows(wide, [(k, F.col(f"c{k}")) for k in range(60)], [(k, F.col(f"c{k}")) for k in range(60)])
    assert cells.count() == 2 * 60 * 61 // 2


def test_trend_flags_an_odd_month(spark):
    rows = [(f"2024-{m:02d}", 10.0 + m % 2) for m in range(1, 13)] + [("2025-01", 500.0)]
    trend = profile.monthly_variable_trend(spark.createDataFrame(rows, "month string, v double"), "v")
    assert [r["month"] for r in trend.where("is_outlier").collect()] == ["2025-01"]


def test_months_are_cut_on_request_only(spark):
    df = spark.createDataFrame([(f"{1900 + i // 12}-{i % 12 + 1:02d}", 1.0) for i in range(1600)], "month string, v double")
    assert profile.monthly_totals(df, ["v"]).count() == 1600
    kept = profile.monthly_totals(df, ["v"], points=1500)
    assert kept.count() == 1500
    assert kept.agg(F.min("month")).first()[0] == "1908-05"


def test_share_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 3), (None, 2)], "a int, b int")
    from paneleffect.operators.features import add_channel_shares

    out = [(r["share_a"], r["share_b"]) for r in add_channel_shares(df, ["a", "b"]).collect()]
    assert out == [(0.0, 0.0), (0.25, 0.75), (0.0, 1.0)]
    assert not any(math.isnan(v) for pair in out for v in pair)
