"""Changes of grain on the long panel, and joins on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.functions import scalars as S
from paneleffect.functions import skew


def collapse_reps(
    df: DataFrame,
    overrides: Mapping[str, str] | None = None,
    also_by: Sequence[str] = (),
) -> DataFrame:
    """One row per customer × week × type triple: counts are summed, other columns take the maximum.

    Own definition. ``overrides`` names another aggregate (sum, max, min, avg) per column.
    """
    overrides = overrides or {}
    keys = [c for c in (*config.PATH_B_KEYS, *config.TYPE_TRIPLE, *also_by) if c in df.columns]
    aggregates = []
    for c in df.columns:
        if c in keys or c == config.REP:
            continue
        how = overrides.get(c, "sum" if c.endswith("_count") else "max")
        aggregates.append(getattr(F, how)(S.name(c)).alias(c))
    return df.groupBy(*keys).agg(*aggregates)


def dedupe_non_personal(df: DataFrame, suggestion_type: str, also_by: Sequence[str] = ()) -> DataFrame:
    """For non-personal suggestions keep the row of the first rep per customer × week × triple.

    Own definition. A minimum over the row, rep first, combines on the map side, so copies of one
    suggestion over many reps never meet in one task.
    """
    if suggestion_type != "npp":
        return df
    keys = [c for c in (*config.PATH_B_KEYS, *config.TYPE_TRIPLE, *also_by) if c in df.columns]
    rest = [c for c in df.columns if c not in keys and c != config.REP]
    first = F.min(F.struct(F.col(config.REP), *[S.name(c) for c in rest])).alias("_first")
    return df.groupBy(*keys).agg(first).select(
        *[F.col(c) if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns]
    )


def _repeated(df: DataFrame, keys: Sequence[str]) -> list:
    return df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()


def is_unique(df: DataFrame, keys: Sequence[str]) -> bool:
    return not _repeated(df, keys)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    twice = _repeated(df, keys)
    if twice:
        raise ValueError(f"More than one row for {dict(zip(keys, twice[0]))}.")


def attach_propensity(
    df: DataFrame,
    scores: DataFrame,
    propensity_column: str,
    keys: Sequence[str] = config.PATH_A_KEYS,
    check_unique: bool = True,
) -> DataFrame:
    """Add the propensity score by those panel keys the score table has; unmatched rows get null."""
    on = [k for k in keys if k in scores.columns]
    slim = scores.select(*on, propensity_column)
    if check_unique:
        assert_unique(slim, on)
    return skew.left_join_unique(df, slim, on)
