"""Cross-fitted means of ids: width, large ids, null and new ids."""

import hashlib

import pytest
from fixtures import wide_sample
from pyspark.sql import functions as F

from paneleffect.operators import idmeans
from paneleffect.plans import wide


def test_equal_to_a_loop_with_large_null_and_new_ids(spark):
    rows = [(k, [None, "a", "a", "a", "b"][k % 5] if k < 190 else f"n{k}", float(k % 7)) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, id string, y double")
    m = idmeans.fit_id_means(df, "id", ["y"], ["k"])
    out = {r["k"]: r["mean_y_by_id"] for r in idmeans.add_id_means(df, m, rows_per_task=10).collect()}
    folds = {k: int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % idmeans.FOLDS for k, _, _ in rows}
    for k, who, _ in rows:
        others = [(w, y) for j, w, y in rows if folds[j] != folds[k]]
        prior = sum(y for _, y in others) / len(others)
        own = [y for w, y in others if w == who and who is not None]
        assert out[k] == pytest.approx((sum(own) + idmeans.PRIOR_ROWS * prior) / (len(own) + idmeans.PRIOR_ROWS))
    new = idmeans.add_id_means(spark.createDataFrame([(1, "b"), (2, "unknown"), (3, None)], "k int, id string"), m, own_fold=False)
    got = {r["k"]: r["mean_y_by_id"] for r in new.collect()}
    overall = sum(y for _, _, y in rows) / 200
    b = [y for _, w, y in rows if w == "b"]
    assert got[1] == pytest.approx((sum(b) + idmeans.PRIOR_ROWS * overall) / (len(b) + idmeans.PRIOR_ROWS))
    assert got[2] == got[3] == pytest.approx(overall)


def test_a_million_ids_are_two_numbers(spark):
    df = spark.range(2_000_000, numPartitions=8).select(F.col("id").alias("k"), (F.col("id") % 1_000_000).alias("who"), (F.col("id") % 3).alias("y"), (F.col("id") % 2).alias("z"))
    m = idmeans.fit_id_means(df, "who", ["y", "z"], ["k"])
    out = idmeans.add_id_means(df, m)
    assert out.columns == [*df.columns, "mean_y_by_who", "mean_z_by_who"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Window" not in plan
    assert out.agg(F.count("mean_y_by_who"), F.min("mean_z_by_who")).first()[0] == 2_000_000


def test_the_wide_chain_takes_means_for_ids(spark):
    run = wide.run(wide_sample(spark), encode_ids="means", model_params={"maxIter": 2})
    assert [c for c in run.feature_columns if c.startswith(("hcp_id", "rep_id"))] == []
    assert {"mean_action_total_by_hcp_id", "mean_treated_action_by_rep_id"} <= set(run.feature_columns)
    assert run.scored.count() == 20
    with pytest.raises(ValueError):
        wide.run(wide_sample(spark), encode_ids="other")


def test_no_rows(spark):
    df = spark.createDataFrame([], "k int, id string, y double")
    assert idmeans.add_id_means(df, idmeans.fit_id_means(df, "id", ["y"], ["k"])).collect() == []
