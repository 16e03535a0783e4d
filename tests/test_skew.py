"""The spread forms give the same rows as the plain ones, with hot keys, null keys and ties."""

from datetime import timedelta

import pytest
from fixtures import week
from pyspark.sql import Window
from pyspark.sql import functions as F

from paneleffect.config import AdstockSpec, Roles
from paneleffect.functions import scalars as S
from paneleffect.functions import skew
from paneleffect.operators import adstock, features, grain, scenario, spillover

ROLES = Roles(("suggestion_total",), ("action_total",), ("trx",), "week_end_date", "hcp_id", "rep_id")


@pytest.fixture(scope="module")
def hot(spark):
    """One pair holds a third of the rows, null keys another part; many rows share a time."""
    rows = []
    for i in range(900):
        hcp = "H0" if i % 3 == 0 else (None if i % 3 == 1 and i % 2 else f"H{i % 40}")
        rep = "R0" if i % 3 == 0 else f"R{i % 4}"
        rows.append((i, hcp, rep, week(i // 60), float(i * 37 % 11), float(i * 53 % 7), float(i * 29 % 101)))
    schema = "id int, hcp_id string, rep_id string, week_end_date date, suggestion_total double, action_total double, trx double"
    return spark.createDataFrame(rows, schema).repartition(6)


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select("id", *columns).collect())


HISTORY = ("lag_suggestion_total_1", "lag_action_total_1", "rolling4_suggestion_total", "rolling4_action_total", "baseline_trx_8w")


@pytest.mark.parametrize("limit", [7, 40, 299])
def test_history_in_blocks_equals_one_window(hot, limit):
    plain = features.add_history(hot, ROLES, ["id"], rows_per_task=None)
    blocks = features.add_history(hot, ROLES, ["id"], rows_per_task=limit)
    assert blocks.columns == plain.columns
    assert _rows(blocks, *HISTORY) == _rows(plain, *HISTORY)


@pytest.mark.parametrize("limit", [11, 60])
def test_copies_of_one_row_are_spread_too(spark, limit):
    """A third of the rows are the same row; no column tells them apart."""
    rows = [("H", "R", week(3), 1.0, 2.0, 3.0)] * 100 + [
        ("H" if i % 2 else f"H{i}", "R", week(i % 7), float(i % 5), float(i % 3), float(i % 11)) for i in range(200)
    ]
    schema = "hcp_id string, rep_id string, week_end_date date, suggestion_total double, action_total double, trx double"
    df = spark.createDataFrame(rows, schema).repartition(5)
    every = ["hcp_id", "week_end_date", "suggestion_total", "action_total", "trx", *HISTORY]
    plain = features.add_history(df, ROLES, rows_per_task=None).select(*every).collect()
    blocks = features.add_history(df, ROLES, rows_per_task=limit).select(*every).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, plain))


def test_hot_pair_is_cut_into_several_blocks(hot):
    blocks = skew.lookback_blocks(hot, ["hcp_id", "rep_id"], ["week_end_date", "id"], 8, 40)
    sizes = blocks.where("hcp_id = 'H0' and not _context").groupBy("_block").count()
    assert sizes.count() >= 5
    assert blocks.where("not _context").count() == hot.count()


@pytest.mark.parametrize("limit", [5, 10_000])
def test_totals_brought_back_equal_a_window(hot, limit):
    out = spillover.percent_other_suggested(hot, count="suggestion_total", rows_per_task=limit)
    w = Window.partitionBy("rep_id", "week_end_date")
    got = (F.col("suggestion_total") > 0).cast("double")
    others = F.count(F.lit(1)).over(w) - 1
    want = hot.withColumn(
        "percent_other_hcps_suggested", F.coalesce((F.sum(got).over(w) - got) / F.when(others != 0, others), F.lit(0.0))
    )
    assert _rows(out, "percent_other_hcps_suggested") == _rows(want, "percent_other_hcps_suggested")


def test_one_customer_has_no_others(spark):
    df = spark.createDataFrame([("R", "C", week(0), 3.0), ("R", "C", week(1), None)], "rep_id string, customer_id string, week_end_date date, suggestion_count double")
    assert {r[0] for r in spillover.percent_other_suggested(df).select("percent_other_hcps_suggested").collect()} == {0.0}


@pytest.mark.parametrize("keys", [["week_end_date"], ["rep_id", "week_end_date"], ["hcp_id", "week_end_date"]])
def test_activity_indexes_equal_a_window(hot, keys):
    out = spillover.weekly_activity_index(hot, "action_total", keys, "idx", rows_per_task=5)
    want = hot.withColumn("idx", F.sum("action_total").over(Window.partitionBy(*keys)).cast("bigint"))
    assert _rows(out, "idx") == _rows(want, "idx")


def test_adstock_is_by_calendar_and_sums_days(hot, spark):
    spec = {"action_total": AdstockSpec(0.5, 2)}
    out = {r["id"]: r["action_total_adstock"] for r in adstock.add_adstock(hot, ["hcp_id", "rep_id"], spec, rows_per_task=5).collect()}
    rows = hot.collect()
    for r in rows[:150]:
        want = 0.0
        for k in range(3):
            day = r["week_end_date"] - timedelta(weeks=k)
            want += 0.5**k * sum(
                o["action_total"] for o in rows if (o["hcp_id"], o["rep_id"], o["week_end_date"]) == (r["hcp_id"], r["rep_id"], day)
            )
        assert out[r["id"]] == pytest.approx(want)


def test_adstock_finds_out_whether_days_repeat(hot):
    spec = {"action_total": AdstockSpec(0.5, 2)}
    told = adstock.add_adstock(hot, ["hcp_id", "rep_id"], spec, unique_grain=False)
    found = adstock.add_adstock(hot, ["hcp_id", "rep_id"], spec)
    assert _rows(found, "action_total_adstock") == _rows(told, "action_total_adstock")


def test_adstock_skips_a_missing_week_and_absent_columns(spark):
    rows = [("R", "C", week(0), 8.0), ("R", "C", week(2), 4.0), ("R", "C", week(9), 1.0)]
    df = spark.createDataFrame(rows, "rep_id string, customer_id string, week_end_date date, action_count double")
    out = adstock.add_adstock(df, ["rep_id", "customer_id"], {"action_count": AdstockSpec(0.5, 4), "absent": AdstockSpec(0.5, 4)}, unique_grain=True)
    assert [r["action_count_adstock"] for r in out.orderBy("week_end_date").collect()] == [8.0, 6.0, 1.0]
    with pytest.raises(ValueError):
        AdstockSpec(0.3, 4, "weibull")


def test_left_join_keeps_rows_with_null_keys(hot):
    scores = hot.where("hcp_id is not null").select("hcp_id", "rep_id", "week_end_date").distinct().withColumn("score", F.lit(1.0))
    out = skew.left_join_unique(hot, scores, ["hcp_id", "rep_id", "week_end_date"])
    assert out.count() == hot.count()
    assert out.where("score is null").count() == hot.where("hcp_id is null").count()


def test_scores_must_be_unique(spark):
    df = spark.createDataFrame([("R", "C", week(0))], "rep_id string, customer_id string, week_end_date date")
    scores = df.withColumn("p", F.lit(0.5))
    with pytest.raises(ValueError, match="More than one row"):
        grain.attach_propensity(df, scores.unionAll(scores), "p")


def test_first_rep_is_kept_for_non_personal_suggestions(spark):
    rows = [("R2", "C", week(0), 1.0), ("R1", "C", week(0), 2.0), ("R3", "D", week(0), 3.0)]
    df = spark.createDataFrame(rows, "rep_id string, customer_id string, week_end_date date, suggestion_count double")
    kept = grain.dedupe_non_personal(df, "npp")
    assert sorted((r["rep_id"], r["suggestion_count"]) for r in kept.collect()) == [("R1", 2.0), ("R3", 3.0)]
    assert grain.dedupe_non_personal(df, "call") is df


def test_spillover_must_be_given(spark):
    df = spark.createDataFrame([("R", "C", week(0), 1.0)], "rep_id string, customer_id string, week_end_date date, percent_other_hcps_suggested double")
    with pytest.raises(ValueError):
        scenario.restore_spillover(df, None)


def test_study_period_is_half_open(spark):
    from paneleffect.operators.clean import filter_period

    df = spark.createDataFrame([(week(i),) for i in range(5)], "week_end_date date")
    out = filter_period(df, "week_end_date", "2024-01-14", "2024-01-28")
    assert [r[0] for r in out.orderBy("week_end_date").collect()] == [week(1), week(2)]


@pytest.mark.parametrize("unit", [1.0, 60.0, 1e6, 1e-9])
def test_equal_sums_of_different_histories_carry_one_value(spark, unit):
    """3 + 0.3 * 2 is 0.3 * 12, 6 + 0.3 * 18 is 3 + 0.3 * 28: a tree must find nothing to cut between them."""
    histories = [("R1", 2.0, 3.0), ("R2", 12.0, 0.0), ("R3", 18.0, 6.0), ("R4", 38.0, 0.0), ("R5", 28.0, 3.0)]
    rows = [(rep, "H", week(i), unit * v) for rep, *values in histories for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "rep_id string, customer_id string, week_end_date date, suggestion_count double")
    out = adstock.add_adstock(df, ["rep_id", "customer_id"], {"suggestion_count": AdstockSpec(0.3, 4)}, unique_grain=True)
    last = {r["rep_id"]: r["suggestion_count_adstock"] for r in out.where(F.col("week_end_date") == week(1)).collect()}
    assert len({last["R1"], last["R2"]}) == 1 and len({last[r] for r in ("R3", "R4", "R5")}) == 1
    assert last["R1"] == pytest.approx(3.6 * unit, rel=1e-13) and last["R3"] == pytest.approx(11.4 * unit, rel=1e-13)


def test_significant_digits_at_any_magnitude(spark):
    inf = float("inf")
    given = [999.9999999999999, 1000.0, -3.5999999999999996, 123456.78912345, 2.0**60, 5e-324, 1.7e308, 0.0, inf, -inf, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v double")
    out = [r["v"] for r in df.select("i", S.significant(F.col("v")).alias("v")).orderBy("i").collect()]
    assert out == [1000.0, 1000.0, -3.6, 123456.78912345, pytest.approx(2.0**60, rel=1e-13), 5e-324, 1.7e308, 0.0, inf, -inf, None]
    assert spark.range(1).select(F.isnan(S.significant(F.lit(float("nan"))))).first()[0]
