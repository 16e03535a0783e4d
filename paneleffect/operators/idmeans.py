"""Ids as a few numbers: cross-fitted means, whose width does not grow with the number of ids.

A row's number for an id is the mean of a label over the id's rows in the other folds, drawn towards the mean
of all rows there. A row's fold is a hash of its grain, so its own label never enters its number, and a
rerun deals the same folds. The exact one-hot form stays in ``encode``; which one is used is the caller's choice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneleffect.functions import scalars as S
from paneleffect.functions import skew

FOLDS, PRIOR_ROWS = 5, 20.0
_FOLD, _ROWS = "_fold", "_rows"


def fold(grain: Sequence[str], folds: int = FOLDS) -> Column:
    """0 to folds - 1, from the MD5 of the grain's values as text; a null value counts as empty."""
    text = F.concat_ws("|", *[F.coalesce(S.name(c).cast("string"), F.lit("")) for c in grain])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def column(label: str, id_column: str) -> str:
    return f"mean_{label}_by_{id_column}"


@dataclass(frozen=True)
class IdMeans:
    """Rows and label sums per (id, fold), stored, and those of all rows per fold."""

    id_column: str
    labels: tuple[str, ...]
    grain: tuple[str, ...]
    folds: int
    prior_rows: float
    totals: DataFrame
    overall: tuple[tuple, ...]

    @property
    def columns(self) -> list[str]:
        return [column(label, self.id_column) for label in self.labels]


def _label(name: str) -> Column:
    return F.coalesce(S.name(name).cast("double"), F.lit(0.0))


def fit_id_means(df: DataFrame, id_column: str, labels: Sequence[str], grain: Sequence[str], folds: int = FOLDS, prior_rows: float = PRIOR_ROWS) -> IdMeans:
    """Totals per id and fold, combined before the shuffle. Missing labels count as 0; null ids are no id."""
    rows = df.select(S.name(id_column).alias(id_column), fold(grain, folds).alias(_FOLD), *[_label(c).alias(f"_s{i}") for i, c in enumerate(labels)])
    sums = [F.count(F.lit(1)).alias(_ROWS), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(labels))]]
    overall = {r[_FOLD]: tuple(r)[1:] for r in rows.groupBy(_FOLD).agg(*sums).collect()}  # one row per fold
    by_id = skew.durable(rows.where(S.name(id_column).isNotNull()).groupBy(id_column, _FOLD).agg(*sums))
    whole = tuple(overall.get(f, (0, *[0.0] * len(labels))) for f in range(folds))
    return IdMeans(id_column, tuple(labels), tuple(grain), folds, prior_rows, by_id, whole)


def _outside(m: IdMeans, own_fold: bool) -> DataFrame:
    """Per id (and fold, if rows leave out their own): rows and label sums of the folds that count, and the size of the group."""
    names = [_ROWS, *[f"_s{i}" for i in range(len(m.labels))]]
    whole = m.totals.groupBy(m.id_column).agg(*[F.sum(c).alias(f"{c}_all") for c in names])
    if not own_fold:
        return whole.select(m.id_column, F.col(f"{_ROWS}_all").alias("_size"), *[F.col(f"{c}_all").alias(f"{c}_out") for c in names])
    both = m.totals.join(whole, m.id_column)
    return both.select(m.id_column, _FOLD, F.col(_ROWS).alias("_size"), *[(F.col(f"{c}_all") - F.col(c)).alias(f"{c}_out") for c in names])


def _prior(m: IdMeans, position: int, own_fold: bool) -> Column:
    """The mean of all rows outside the row's fold, as a literal per fold."""

    def mean(leave_out: int | None) -> float:
        kept = [t for f, t in enumerate(m.overall) if f != leave_out]
        n = sum(t[0] for t in kept)
        return sum(t[1 + position] for t in kept) / n if n else 0.0

    if not own_fold:
        return F.lit(mean(None))
    return F.element_at(F.array(*[F.lit(mean(f)) for f in range(m.folds)]), F.col(_FOLD) + 1)


def add_id_means(df: DataFrame, m: IdMeans, own_fold: bool = True, rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """Add one column per label. ``own_fold`` leaves out the row's fold, for the rows the means were fitted
    on; new rows take all folds. Null and unknown ids get the prior.

    The totals join the rows by id and fold; those of a large id are repeated and its rows spread, and rows
    without an id go round the join.
    """
    keys = [m.id_column, _FOLD] if own_fold else [m.id_column]
    dealt = df.withColumn(_FOLD, fold(m.grain, m.folds))
    known = S.name(m.id_column).isNotNull()
    joined = skew.attach_totals(dealt.where(known), _outside(m, own_fold), keys, "_size", rows_per_task, m.grain)
    sums = [f"{c}_out" for c in (_ROWS, *[f"_s{i}" for i in range(len(m.labels))])]
    rest = dealt.where(~known).withColumns({c: F.lit(None).cast(joined.schema[c].dataType) for c in sums})
    order = [*[S.name(c) for c in dealt.columns], *sums]
    rows = joined.select(*order).unionByName(rest.select(*order))
    n = F.coalesce(F.col(f"{_ROWS}_out"), F.lit(0))
    means = [
        ((F.coalesce(F.col(f"_s{i}_out"), F.lit(0.0)) + F.lit(m.prior_rows) * _prior(m, i, own_fold)) / (n + F.lit(m.prior_rows))).alias(name)
        for i, name in enumerate(m.columns)
    ]
    return rows.select(*[S.name(c) for c in df.columns], *means)
