"""Stored long runs: what is loaded equals what was stored; unfinished parts are refused."""

import pytest
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.plans import lift, store
from paneleffect.registry import panels as P
from paneleffect.registry.learning import OVERRIDES
from paneleffect.sources import sinks, tables

SF = "/root/testdata/sf0.001"
FEW = {"maxIter": 2, "maxDepth": 2}


@pytest.fixture(scope="module")
def panel(spark):
    return P.long(spark, SF).where("customer_id < 'H06'")


@pytest.fixture(scope="module")
def run(panel):
    return lift.run(panel, "call", "call", "1994-01-02", "1997-06-01", theme_run=True, params=FEW, overrides=OVERRIDES)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    return a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()


def test_a_run_is_loaded_as_it_was_stored(spark, run, tmp_path):
    folder = str(tmp_path / "run")
    for part in run:
        store.save(part, folder, scored=False)
    loaded = store.load(spark, folder)
    for old, new, part in zip(run, (loaded.a, loaded.b), "AB"):
        for name in store.FRAMES[part]:
            assert same(getattr(old, name), getattr(new, name)), name
    assert loaded.a.effect.config == run[0].effect.config and loaded.a.effect.scored is None
    assert set(loaded.b.effect) == set(config.OUTCOME_TYPES)
    assert loaded.b.effect["trx"].model.stages[-1].toDebugString.split("\n")[1:] == run[1].effect["trx"].model.stages[-1].toDebugString.split("\n")[1:]
    assert loaded.b.propensity["nbrx"].config.outcome_type == "nbrx"


def test_path_b_from_stored_tables_equals_the_direct_one(spark, panel, run, tmp_path):
    folder = str(tmp_path / "run")
    store.save(run[0], folder)
    assert store.finished(spark, folder) == ["A"]
    with pytest.raises(store.IncompleteRun):
        store.load(spark, folder)
    stored = store.run_path_b(panel, folder, params=FEW, overrides=OVERRIDES)
    assert store.finished(spark, folder) == ["A", "B"]
    total = lambda df: sorted((r["theme"], r["outcome_type"], round(r["t"], 6)) for r in df.groupBy("theme", "outcome_type").agg(F.sum("incremental_outcome").alias("t")).collect())
    assert total(stored.b.incremental) == total(run[1].incremental)
    assert stored.a.effect.scored.count() == run[0].effect.scored.count()


def test_a_part_without_manifest_is_refused_and_removed(spark, run, tmp_path):
    root = tmp_path / "runs"
    for name in ("good", "broken", "short"):
        store.save(run[0], str(root / name), scored=False)
    store.discard(spark, str(root / "broken"), "A")
    sinks.write_run_table(run[0].scores, str(root / "broken/path_a/scores"))  # as a job that was lost leaves it
    with pytest.raises(store.IncompleteRun):
        store.load(spark, str(root / "broken"), ["A"])
    sinks.write_run_table(run[0].scores.limit(3), str(root / "short/path_a/scores"))
    with pytest.raises(store.IncompleteRun, match="no longer holds"):
        store.load(spark, str(root / "short"), ["A"])
    removed = store.discard_unfinished(spark, str(root))
    assert [r.rsplit("/", 2)[1] for r in removed] == ["broken"] and not (root / "broken/path_a").exists()
    assert store.finished(spark, str(root / "good")) == ["A"]


def test_a_broken_rewrite_does_not_pass_for_the_old_part(spark, run, tmp_path, monkeypatch):
    folder = str(tmp_path / "run")
    store.save(run[0], folder, scored=False)

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_write", lost)
    with pytest.raises(RuntimeError):
        store.save(run[0], folder, scored=False)
    assert store.finished(spark, folder) == []


def test_observed_spillover_stays_in_the_counterfactual(panel):
    kept = lift.path_a(panel, "call", "call", params=FEW, keep_actual_spillover=True)
    assert kept.counterfactual.where("percent_other_hcps_suggested_counterfactual > 0").count() > 0
    assert kept.counterfactual.where("suggestion_count_counterfactual <> 0").count() == 0


def test_types_of_a_csv_are_found_in_one_pass(spark, tmp_path):
    lines = [
        "id,whole,mixed,share,day,at,flag,none,long,word,blank id",
        "007,1,1,0.5,2024-01-01,2024-01-01 10:00:00,true,,12345678901234567890, x,5",
        "8,-20,2.5,1e3,2024-02-29,2024-01-02,FALSE,,1,2,",
        "9,0,,0.0,,2024-01-02T03:04:05,,,2,3,6",
    ]
    path = tmp_path / "panel.csv"
    path.write_text("\n".join(lines) + "\n")
    df = tables.load_panel(spark, str(path))
    kinds = dict(df.dtypes)
    assert kinds == {"id": "string", "whole": "bigint", "mixed": "double", "share": "double", "day": "date", "at": "timestamp", "flag": "boolean", "none": "string", "long": "string", "word": "string", "blank id": "bigint"}
    rows = df.collect()
    assert [r["id"] for r in rows] == ["007", "8", "9"] and rows[1]["whole"] == -20 and rows[2]["mixed"] is None and rows[2]["day"] is None
    assert tables.load_panel(spark, str(path), schema=df.schema).where("whole = -20").count() == 1
    assert tables.with_types(spark.createDataFrame([], "a string")).dtypes == [("a", "string")]
