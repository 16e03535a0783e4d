"""Features of the wide panel: totals, flags, lags, rolling means, baseline, calendar, z-scores, one-hot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneleffect.config import Roles
from paneleffect.functions import scalars as S
from paneleffect.functions import skew
from paneleffect.operators.clean import parse_time, safe_numeric
from paneleffect.operators.roles import outcome_columns

FLAGS = ("treated_suggestion", "treated_action")
BASELINE_ROWS = 8
_TIE = "_tie"


@dataclass(frozen=True)
class FeatureFrame:
    """A frame with its numeric feature columns and the columns that are to be one-hot encoded."""

    data: DataFrame
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]


def add_totals_and_flags(df: DataFrame, roles: Roles) -> DataFrame:
    totals = df.withColumns(
        {
            "suggestion_total": S.total(S.name(c) for c in roles.suggestions),
            "action_total": S.total(S.name(c) for c in roles.actions),
        }
    )
    return totals.withColumns(
        {"treated_suggestion": S.flag(F.col("suggestion_total")), "treated_action": S.flag(F.col("action_total"))}
    )


def add_history(
    df: DataFrame,
    roles: Roles,
    tie_break: Sequence[str] = (),
    rows_per_task: int | None = skew.ROWS_PER_TASK,
) -> DataFrame:
    """Lag-1, rolling-4 mean and the mean of the 8 rows before, per (hcp, rep) in time order.

    All windows share one partitioning and order, hence one shuffle. Rows of one pair at the same
    time are ordered by ``tie_break``, else by a hash of the row, so a rerun gives the same answer.
    Pairs beyond ``rows_per_task`` rows are cut into blocks; None promises there are none.
    """
    keys = [roles.hcp, roles.rep]
    ties = list(tie_break)
    if not ties:
        df = df.withColumn(_TIE, F.xxhash64(*[S.name(c) for c in df.columns]))
        ties = [_TIE]
    order = [roles.time, *ties]
    if rows_per_task is None:
        blocks = df.withColumns({skew.BLOCK: F.lit(0), skew.CONTEXT: F.lit(False), skew.SEQUENCE: F.lit(0)})
    else:
        blocks = skew.lookback_blocks(df, keys, order, BASELINE_ROWS, rows_per_task)
    w = Window.partitionBy(*keys, skew.BLOCK).orderBy(*order, skew.SEQUENCE)
    added: dict[str, Column] = {}
    for column in ("suggestion_total", "action_total"):
        added[f"lag_{column}_1"] = F.coalesce(F.lag(column, 1).over(w), F.lit(0.0))
    for column in ("suggestion_total", "action_total"):
        added[f"rolling4_{column}"] = F.avg(column).over(w.rowsBetween(-3, 0))
    if any("trx" in c.lower() for c in roles.outcomes):
        before = S.name(outcome_columns(roles)[0])
        added["baseline_trx_8w"] = F.coalesce(F.avg(before).over(w.rowsBetween(-BASELINE_ROWS, -1)), F.lit(0.0))
    else:
        added["baseline_trx_8w"] = F.lit(0.0)
    return blocks.withColumns(added).where(~F.col(skew.CONTEXT)).drop(skew.BLOCK, skew.CONTEXT, skew.SEQUENCE, _TIE)


def add_calendar(df: DataFrame, time: str) -> DataFrame:
    return df.withColumns({"month": F.month(S.name(time)), "quarter": F.quarter(S.name(time))})


def numeric_columns(df: DataFrame, leave_out: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in leave_out]


def add_z_scores(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``z_<column>`` = (x − mean) / sample deviation, 0.0 where that is 0 or undefined.

    Means and deviations of all columns come from one aggregate; its single row enters the
    projection as literals, so later readers of the frame do not compute it again.
    """
    names = list(columns if columns is not None else numeric_columns(df, FLAGS))
    if not names:
        return df
    stats = df.agg(
        *[F.avg(S.name(c)).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_samp(S.name(c)).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    scores = {}
    for i, c in enumerate(names):
        mean, deviation = stats[f"m{i}"], stats[f"s{i}"]
        z = F.coalesce((S.name(c) - F.lit(mean)) / F.lit(deviation), F.lit(0.0)) if deviation else F.lit(0.0)
        scores[f"z_{c}"] = z
    return df.withColumns(scores)


def one_hot_columns(df: DataFrame, columns: Sequence[str], values: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Explicit 0/1 columns ``<column>_<value>``, first category dropped, null all zeros.

    ``values`` gives the categories of a column; those of others are read from the data. As every
    category becomes a column, this form suits few; the sparse encoder takes any number.
    """
    added: dict[str, Column] = {}
    for c in columns:
        known = (values or {}).get(c)
        if known is None:
            known = [r["v"] for r in df.select(S.name(c).alias("v")).dropna().distinct().collect()]
        for value in sorted(known)[1:]:
            added[f"{c}_{value}"] = F.coalesce((S.name(c) == F.lit(value)).cast("int"), F.lit(0))
    return df.select(*[S.name(c) for c in df.columns if c not in columns], *[v.alias(k) for k, v in added.items()])


def _reveals_the_present(column: str, roles: Roles) -> bool:
    """Whether a feature is computed from this row's action or outcome."""
    base = column.removeprefix("z_")
    present = {*roles.actions, *roles.outcomes, "action_total", "treated_action", "rolling4_action_total"}
    return base in present


def build_features(
    df: DataFrame,
    roles: Roles,
    leak_safe: bool = False,
    tie_break: Sequence[str] = (),
    rows_per_task: int | None = skew.ROWS_PER_TASK,
    store: bool = False,
) -> FeatureFrame:
    """The wide feature chain. ``store`` keeps the windowed columns in a durable frame, for fits
    that read the result many times.

    By default the features include current-period totals and z-scores of the outcomes;
    ``leak_safe`` leaves out everything computed from this row's action or outcome.
    """
    clean = safe_numeric(parse_time(df, roles.time, drop_unparseable=False), dict.fromkeys(roles.metrics))
    history = add_history(add_totals_and_flags(clean, roles), roles, tie_break, rows_per_task)
    scored = add_z_scores(skew.durable_for_fitting(add_calendar(history, roles.time)) if store else add_calendar(history, roles.time))
    categorical = (roles.hcp, roles.rep, "month", "quarter")
    skip = {*roles.metrics, roles.time, *categorical}
    numeric = [c for c in numeric_columns(scored) if c not in skip]
    if leak_safe:
        numeric = [c for c in numeric if not _reveals_the_present(c, roles)]
    return FeatureFrame(scored.fillna(0, subset=numeric_columns(scored)), tuple(numeric), categorical)


def channel_shares(df: DataFrame, channels: Sequence[str], whole: Column | None = None) -> dict[str, Column]:
    """Share of each channel in the row's channel total, 0 where nothing happened."""
    x = {c: S.number(df, c) for c in channels}
    denominator = whole if whole is not None else S.total(x.values())
    return {c: S.share(x[c], denominator) for c in channels}


def add_channel_shares(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    return df.withColumns({f"share_{c}": s for c, s in channel_shares(df, channels).items()})
