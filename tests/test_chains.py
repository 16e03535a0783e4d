"""The wide and the long chain end to end, and storage round trips."""

import json

import pytest
from fixtures import wide_sample
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.config import AdstockSpec, ModelConfig
from paneleffect.operators import encode, features, rollups
from paneleffect.operators.roles import detect_roles
from paneleffect.plans import lift, recipes, wide
from paneleffect.registry import panels as P
from paneleffect.sources import sinks, tables

SF = "/root/testdata/sf0.001"
FEW = {"maxIter": 3}


@pytest.fixture(scope="module")
def sample_run(spark):
    return wide.run(wide_sample(spark), model_params=FEW)


def test_wide_chain_on_the_sample(sample_run):
    overall = {r["measure"]: r for r in sample_run.overall.collect()}
    assert overall["incremental_actions"]["total"] == pytest.approx(12.0)
    assert overall["incremental_trx"]["total"] >= 0
    assert sample_run.action_monthly.count() == 5
    assert sample_run.diagnostics.first()["treated_cohort_size"] == 20
    assert sample_run.scored.count() == 20


def test_channel_rollup_adds_up(spark, sample_run):
    with_action = sample_run.scored.where("action_total > 0").agg(F.sum("incremental_actions")).first()[0]
    assert sample_run.channel_monthly.agg(F.sum("incremental_actions")).first()[0] == pytest.approx(with_action)
    assert sample_run.channel_lift.agg(F.sum("lift")).first()[0] == pytest.approx(with_action)
    monthly = sample_run.action_monthly.agg(F.sum("incremental_actions")).first()[0]
    assert monthly == pytest.approx(12.0)


def test_numeric_ids_are_named_without_padding_or_left_out(spark):
    df = wide_sample(spark).withColumns({c: F.substring(c, 2, 1).cast("int") for c in ("hcp_id", "rep_id")})
    frame = features.build_features(df, detect_roles(df.columns))
    encoder = encode.fit_wide_encoder(frame.data, frame.numeric, frame.categorical)
    labels = encoder.labels()
    assert {"hcp_id_4", "rep_id_1", "month_5", "quarter_2", "z_hcp_id"} <= set(labels) and "hcp_id_0" not in labels
    encoded = encode.encode_wide(frame.data, encoder)
    assert len(labels) == encoded.first()[encode.FEATURES].size
    run = wide.run(wide_sample(spark), encode_ids=False, model_params=FEW)
    assert not [c for c in run.feature_columns if c.startswith(("hcp_id", "rep_id"))]


def test_wide_chain_takes_null_ids_and_one_quarter(spark):
    df = wide_sample(spark).limit(12).withColumn("hcp_id", F.when(F.col("hcp_id") != "H1", F.col("hcp_id"))).withColumn("rep_id", F.lit("R1"))
    run = wide.run(df.where("week_end_date < '2024-03-25'"), model_params=FEW)
    assert run.scored.where("hcp_id is null").count() > 0
    assert not [c for c in run.feature_columns if c.startswith(("rep_id", "quarter"))]


def test_scenario_and_isolation(spark):
    run = wide.run(wide_sample(spark), scenario_multiplier=2.0, isolate_channel="action_email", model_params=FEW)
    total = run.overall.where("measure = 'incremental_actions'").first()["total"]
    # 1.2 per row times the email share: five rows email only, two rows half.
    assert total == pytest.approx(1.2 * 6.0)
    consistent = wide.run(
        wide_sample(spark), scenario_multiplier=2.0, isolate_channel="action_email", consistent=True, model_params=FEW
    )
    assert consistent.channel_lift.first()["lift"] == pytest.approx(total)


def test_wide_outputs_are_written(spark, sample_run, tmp_path):
    wide.write(sample_run, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/scored_output")).count() == 20
    text = spark.read.text(str(tmp_path / "out/summary")).first()[0]
    summary = json.loads(text)
    assert len(summary["path_a_monthly_rollup"]) == 5
    assert summary["plain"]["schema"]["time_col"] == "week_end_date"
    assert spark.read.option("header", True).csv(str(tmp_path / "out/path_b_monthly_rollup")).count() == 5


@pytest.fixture(scope="module")
def long_run(spark):
    panel = P.long(spark, SF)
    return panel, lift.run(
        panel, "call", "call", "1995-01-01", "1997-01-05", theme_run=True, params=FEW,
        overrides={"theme_f_qualified": "sum", "theme_o_qualified": "sum"},
    )


def test_long_chain_keeps_rows_and_bounds(long_run):
    panel, (a, b) = long_run
    grain = panel.select(*config.PATH_A_KEYS).where(F.col("week_end_date") < F.lit("1997-01-05").cast("date")).distinct().count()
    assert a.factual.count() == a.counterfactual.count() == grain
    assert a.theme_factual.count() == 2 * grain
    for frame, column in ((a.factual, "predicted_action_count"), (a.counterfactual, "counterfactual_action_count"), (b.factual, "predicted_outcome_count")):
        assert frame.agg(F.min(column)).first()[0] >= 0
    themes = {(r["theme"], r["outcome_type"]) for r in a.incremental.select("theme", "outcome_type").distinct().collect()}
    assert themes == {(t, o) for t in ("all", "theme_f_qualified", "theme_o_qualified") for o in ("trx", "nbrx")}
    weeks = b.incremental.agg(F.min("week_end_date").cast("string"), F.max("week_end_date").cast("string")).first()
    assert weeks[0] >= "1995-01-01" and weeks[1] < "1997-01-05"
    assert b.incremental.where("predicted_outcome_count is null or counterfactual_outcome_count is null").count() == 0


def test_counterfactual_has_no_suggestions(long_run):
    _, (a, _) = long_run
    top = a.counterfactual.agg(F.max("suggestion_count_counterfactual"), F.max("suggestion_count_adstock_counterfactual")).first()
    assert tuple(top) == (0.0, 0.0)


def test_actual_spillover_can_be_kept(spark):
    cfg = lift.model_config("PathA_TreatmentEffectModel", "call", "call", "trx", adstock=None)
    a = lift.run_path_a(P.long(spark, SF), cfg, keep_actual_spillover=True, params=FEW)
    same = a.factual.join(a.counterfactual, list(config.PATH_A_KEYS)).where(
        "percent_other_hcps_suggested_factual <> percent_other_hcps_suggested_counterfactual"
    )
    assert same.count() == 0


def test_effect_recipe_needs_scores(spark):
    cfg = lift.model_config("PathB_TreatmentEffectModel", "call", "call", "trx")
    with pytest.raises(ValueError, match="propensity"):
        recipes.prepare(P.long(spark, SF), cfg)
    with pytest.raises(ValueError, match="Unknown model"):
        ModelConfig("a", "b", "c", "p", "PathC")


def test_keyed_table_prunes_folders(spark, tmp_path):
    df = spark.createDataFrame([("trx", "all", 1), ("nbrx", "all", 2), ("nbrx", "t", 3)], "outcome_type string, theme string, v int")
    place = str(tmp_path / "keyed")
    sinks.write_keyed_table(df, place)
    one = tables.read_keyed_table(spark, place, "nbrx", "t")
    assert [r["v"] for r in one.collect()] == [3]
    assert "PartitionFilters: [isnotnull(outcome_type" in one._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert set(tables.read_keyed_tables(spark, place)) == {("trx", "all"), ("nbrx", "all"), ("nbrx", "t")}
    numbers = spark.createDataFrame([("trx", "01", 1.0), ("trx", "a=b c", 2.0)], "outcome_type string, theme string, v double")
    sinks.write_keyed_table(numbers, f"{place}-numbers")
    stored = tables.read_keyed_tables(spark, f"{place}-numbers")
    assert {k: f.first()["v"] for k, f in stored.items()} == {("trx", "01"): 1.0, ("trx", "a=b c"): 2.0}
    assert stored["trx", "01"].first()["theme"] == "01"


def test_model_config_round_trip(spark, tmp_path):
    cfg = lift.model_config("PathA_PropensityModel", "call", "email", "trx", "2024-01-01", None, {"suggestion_count": AdstockSpec(0.3, 4)})
    sinks.write_model_config(spark, cfg, str(tmp_path / "cfg"))
    assert tables.read_model_config(spark, str(tmp_path / "cfg")) == cfg


def test_master_panel_by_name(spark, tmp_path):
    sinks.write_run_table(spark.range(3).toDF("v"), str(tmp_path / "m"))
    assert tables.read_master_panel(spark, "x", {"x": str(tmp_path / "m")}).count() == 3
    with pytest.raises(ValueError, match="No panel"):
        tables.read_master_panel(spark, "y", {})


def test_few_treated_rows_are_warned_about(spark):
    df = spark.createDataFrame([(1, 1)] * 9 + [(0, 0)] * 5, "treated_suggestion int, treated_action int")
    assert rollups.cohort_diagnostics(df, 3).first()["warning"] == "Low treated cohort size"
    assert rollups.cohort_diagnostics(df.unionByName(df.limit(1)), 3).first()["warning"] == ""
