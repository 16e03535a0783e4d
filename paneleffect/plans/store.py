"""Long runs on disk: each path's models, settings and tables, and a manifest written last.

A run is a folder with one part per path. A part is committed by its manifest: it names the part's
tables with their row counts, so a part without one, or one that a lost job left half written, is refused and can
be told from a finished one. A loaded run is made of the stored tables and models alone; path B can be
run from it later, elsewhere, or again with other settings.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from paneleffect import config
from paneleffect.config import AdstockSpec, ModelConfig
from paneleffect.plans import lift
from paneleffect.plans.lift import Fitted, PathA, PathB
from paneleffect.sources import sinks, tables

FORMAT = 1
FRAMES = {"A": ("scores", "factual", "counterfactual", "theme_factual", "incremental"), "B": ("factual", "counterfactual", "theme_factual", "incremental")}


class IncompleteRun(ValueError):
    """No finished part of that name is stored there."""


@dataclass(frozen=True)
class StoredRun:
    """What of a run is stored: either path, or both."""

    a: PathA | None
    b: PathB | None


def _part(folder: str, part: str) -> str:
    return f"{folder.rstrip('/')}/path_{part.lower()}"


def _models(run: PathA | PathB) -> dict[str, Fitted]:
    if isinstance(run, PathA):
        return {"propensity": run.propensity, "effect": run.effect}
    return {f"{kind}__{outcome}": f for kind in ("propensity", "effect") for outcome, f in getattr(run, kind).items()}


def _config(values: Mapping) -> ModelConfig:
    adstock = values.get("adstock_params")
    return ModelConfig(**{**values, "adstock_params": {c: AdstockSpec(**p) for c, p in adstock.items()} if adstock else None})


def _write(df: DataFrame, path: str) -> int:
    sinks.write_run_table(df, path)
    return df.sparkSession.read.parquet(path).count()  # from the files' footers


def save(run: PathA | PathB, folder: str, scored: bool = True) -> None:
    """Store one path's part. ``scored=False`` leaves out the models' scored training rows, the largest tables.

    A part stored before at that place loses its manifest first, so a broken rewrite cannot pass for it.
    """
    part = "A" if isinstance(run, PathA) else "B"
    place, spark = _part(folder, part), run.factual.sparkSession
    if not _is_absent(spark, f"{place}/manifest"):
        sinks.write_text(spark, json.dumps({"format": FORMAT, "complete": False}), f"{place}/manifest")
    manifest = {"format": FORMAT, "complete": True, "part": part, "tables": {}, "models": {}}
    for name in FRAMES[part]:
        frame = getattr(run, name)
        if frame is not None:
            manifest["tables"][name] = _write(frame, f"{place}/{name}")
    for name, fitted in _models(run).items():
        sinks.write_model(fitted.encoder, f"{place}/models/{name}/encoder")
        sinks.write_model(fitted.model, f"{place}/models/{name}/model")
        rows = _write(fitted.scored, f"{place}/models/{name}/scored") if scored and fitted.scored is not None else None
        manifest["models"][name] = {"config": fitted.config.to_dict(), "scored": rows}
    sinks.write_text(spark, json.dumps(manifest), f"{place}/manifest")


def _is_absent(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return True
        raise
    return False


def manifest(spark: SparkSession, folder: str, part: str) -> dict:
    """The manifest of a finished part."""
    path = f"{_part(folder, part)}/manifest"
    found = {} if _is_absent(spark, path) else json.loads("\n".join(r[0] for r in spark.read.text(path).collect()) or "{}")
    if not found.get("complete"):
        raise IncompleteRun(f"Path {part} of the run in {folder} is not complete.")
    if found["format"] != FORMAT:
        raise IncompleteRun(f"Path {part} of the run in {folder} has format {found['format']}.")
    return found


def _table(spark: SparkSession, path: str, rows: int) -> DataFrame:
    df = tables.read_run_table(spark, path)
    if df.count() != rows:
        raise IncompleteRun(f"{path} no longer holds {rows} rows.")
    return df


def _load_part(spark: SparkSession, folder: str, part: str) -> PathA | PathB:
    found, place = manifest(spark, folder, part), _part(folder, part)
    frames = {name: _table(spark, f"{place}/{name}", found["tables"][name]) if name in found["tables"] else None for name in FRAMES[part]}
    fitted = {}
    for name, entry in found["models"].items():
        at = f"{place}/models/{name}"
        rows = None if entry["scored"] is None else _table(spark, f"{at}/scored", entry["scored"])
        fitted[name] = Fitted(_config(entry["config"]), sinks.read_model(f"{at}/encoder"), sinks.read_model(f"{at}/model"), rows)
    if part == "A":
        return PathA(**fitted, **frames)
    by_kind = {kind: {n.partition("__")[2]: f for n, f in fitted.items() if n.startswith(f"{kind}__")} for kind in ("propensity", "effect")}
    return PathB(**by_kind, **frames)


def load(spark: SparkSession, folder: str, parts: Sequence[str] = ("A", "B")) -> StoredRun:
    """The parts asked for; each must be complete, with the rows its manifest counts."""
    loaded = {part: _load_part(spark, folder, part) for part in parts}
    return StoredRun(loaded.get("A"), loaded.get("B"))


def finished(spark: SparkSession, folder: str) -> list[str]:
    """Which parts of a run are complete."""
    out = []
    for part in FRAMES:
        try:
            manifest(spark, folder, part)
        except IncompleteRun:
            continue
        out.append(part)
    return out


def run_path_a(df: DataFrame, folder: str, suggestion_type: str, action_type: str, start: str | None = None, end: str | None = None, scored: bool = True, **how) -> StoredRun:
    """Run path A, store it, and hand back what was stored."""
    save(lift.path_a(df, suggestion_type, action_type, start, end, **how), folder, scored)
    return load(df.sparkSession, folder, ["A"])


def run_path_b(df: DataFrame, folder: str, start: str | None = None, end: str | None = None, outcome_types: Sequence[str] = config.OUTCOME_TYPES, scored: bool = True, **how) -> StoredRun:
    """Run path B from the stored tables of path A, store it, and hand back both. Types, study period and carry-over
    are those path A was run with, unless a period is given."""
    a = load(df.sparkSession, folder, ["A"]).a
    used = a.effect.config
    effect = lift.model_config(
        "PathB_TreatmentEffectModel", used.suggestion_type, used.action_type, used.outcome_type, start or used.start_date, end or used.end_date, used.adstock_params
    )
    save(lift.run_path_b(df, a, effect, outcome_types, **how), folder, scored)
    return load(df.sparkSession, folder)


def discard(spark: SparkSession, folder: str, part: str) -> None:
    """Remove a stored part, its manifest first."""
    place = _part(folder, part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path(f"{place}/manifest"), True)
    files.delete(path(place), True)


def discard_unfinished(spark: SparkSession, root: str) -> list[str]:
    """Remove parts without a finished manifest from the runs under ``root``; returns what was removed. Not to be called
    while a run is being stored there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    removed = []
    for run in files.listStatus(path(root)):
        folder = run.getPath().toString()
        complete = finished(spark, folder)
        for part in FRAMES:
            if part not in complete and files.exists(path(_part(folder, part))):
                discard(spark, folder, part)
                removed.append(_part(folder, part))
    return removed
