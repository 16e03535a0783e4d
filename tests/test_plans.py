"""Properties of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from paneleffect.operators import adstock, clean, features, profile, quantiles, scenario
from paneleffect.plans import lift
from paneleffect.registry import BOOK, learning
from paneleffect.registry import panels as P

SF = "/root/testdata/sf0.001"


def plan(df, mode: str = "simple") -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(mode)


def shuffles(df) -> int:
    return len(re.findall(r"\bExchange hashpartitioning", plan(df)))


@pytest.fixture(scope="module")
def stored(spark):
    return P.dense(spark, SF)


def test_history_takes_one_shuffle(stored):
    out = features.add_history(features.add_totals_and_flags(stored, P.DENSE_ROLES), P.DENSE_ROLES)
    assert shuffles(out) == 1


def test_adstock_on_a_unique_grain_takes_one_shuffle(stored):
    from paneleffect.config import AdstockSpec

    specs = {"action_call": AdstockSpec(0.69, 4), "suggestion_call": AdstockSpec(0.3, 4)}
    assert shuffles(adstock.add_adstock(stored, ["hcp_id", "rep_id"], specs, unique_grain=True)) == 1


def test_filters_and_columns_reach_the_scan(spark):
    out = clean.filter_period(clean.filter_triangle(P.long(spark, SF), "call", "call", "trx"), "week_end_date", "1995-01-01")
    text = plan(out.select("outcome_count"), "formatted")
    assert "EqualTo(suggestion_type,call)" in text and "GreaterThanOrEqual(week_end_date,1995-01-01)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "confound" not in schema


def test_study_period_is_pushed_below_the_join(spark):
    fact = scenario.factual_actions(P.actions_factual(spark, SF), "propensity_a")
    counter = scenario.counterfactual_actions(P.actions_counterfactual(spark, SF))
    text = plan(scenario.incremental_actions(fact, counter, "1995-01-01", "1996-01-07"), "formatted")
    assert text.count("GreaterThanOrEqual(week_end_date,1995-01-01)") == 2


def test_trend_cap_needs_no_full_sort(stored):
    prepared = profile.prepare(stored, P.DENSE_ROLES)
    assert "TakeOrderedAndProject" in plan(profile.monthly_totals(prepared, ["trx"], points=12).select("month", "trx"))


def test_quantiles_count_before_they_shuffle(stored):
    ranges, totals = quantiles.ranked_values(profile.prepare(stored, P.DENSE_ROLES), ["trx", "nbrx"])
    assert "Window" not in plan(ranges) and "percentile" not in plan(totals)
    assert quantiles.exact_quantiles(stored, ["trx"], (0.5,))["trx"][0] is not None


def test_filters_and_columns_reach_both_sides_of_a_substitution(spark):
    predicted = scenario.factual_actions(P.actions_factual(spark, SF), "propensity_a")
    panel = scenario.substitute_actions(P.long(spark, SF), predicted, "predicted_action_count")
    out = clean.filter_period(clean.filter_triangle(panel, "call", "call", "trx"), "week_end_date", "1995-01-01")
    text = plan(out.select("customer_id", "action_count"), "formatted")
    assert "confound" not in "".join(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    scans = [b for b in text.split("\n\n") if "PushedFilters" in b]
    triple = [b for b in scans if "EqualTo(suggestion_type,call)" in b and "GreaterThanOrEqual(week_end_date,1995-01-01)" in b]
    assert triple


def test_channel_rollup_aggregates_before_it_unpivots(stored):
    from paneleffect.operators import rollups

    df = features.add_totals_and_flags(stored, P.DENSE_ROLES).withColumn("incremental_actions", F.lit(1.0))
    text = plan(rollups.channel_monthly_rollup(df, "week_end_date", "incremental_actions", P.DENSE_ROLES.actions))
    assert text.index("Expand") < text.index("HashAggregate")


@pytest.mark.parametrize("name", ["f7_checklist", "w4_percent_other", "w8_adstock", "c5_incremental_action", "a22_dedupe_non_personal", "p5_z_scores"])
def test_no_python_in_the_plan(spark, name):
    text = plan(BOOK.queries[name](spark, SF))
    assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|CartesianProduct", text)


def test_the_long_panel_reads_its_lines_once(spark):
    text = plan(P.build_long(spark, SF), "formatted")
    assert len(re.findall(r"Location: [^\n]*lineitem", text)) == 1


def test_queries_compute_no_step_they_do_not_need(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("not needed")

    fresh = f"{SF}/"  # another name of the folder, so that nothing is there yet
    monkeypatch.setattr(learning, "_path_b", refused)
    monkeypatch.setattr(learning, "_path_a", refused)
    monkeypatch.setattr(lift, "run_path_a", refused)
    assert learning.x5_flat_stages(spark, fresh).count() == 3
    monkeypatch.setattr(lift, "fit_path_a", refused)
    assert learning.m4_ensemble_nodes(spark, fresh).count() == 21
    monkeypatch.undo()
    monkeypatch.setattr(learning, "_path_b", refused)
    assert learning.c7_store_and_reload(spark, fresh).count() == 3
