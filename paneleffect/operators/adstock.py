"""Carry-over of a measure into the following weeks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.config import AdstockSpec
from paneleffect.functions import scalars as S
from paneleffect.functions import skew
from paneleffect.operators.grain import is_unique

_DAY = "_day"


def _carried(column: str, spec: AdstockSpec, by_day: Window) -> Column:
    """Sum over k of decay^k times the value exactly k weeks earlier; a missing week adds 0. Equal sums of
    different histories are one value, without the last bits that depend on the terms."""
    parts = [
        F.coalesce(F.sum(column).over(by_day.rangeBetween(-7 * k, -7 * k)), F.lit(0.0)) * F.lit(spec.decay_rate**k)
        for k in range(spec.adstock_steps + 1)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return S.significant(out)


def add_adstock(
    df: DataFrame,
    keys: Sequence[str],
    specs: Mapping[str, AdstockSpec] = config.DEFAULT_ADSTOCK,
    time: str = config.WEEK,
    unique_grain: bool | None = None,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """Add ``<column>_adstock`` for every configured column that is present.

    Own definition: the lookback is by calendar, so gaps in a series do not shift it, and rows of
    one key and day count together. Where (keys, day) is unique a key has at most one row per
    calendar day and one window over the rows does it. Otherwise days are summed first and the
    result is brought back to the rows, so that a key with many rows per day stays small under
    the window. ``unique_grain`` states which; None finds out with one aggregate over the keys.
    """
    present = {c: s for c, s in specs.items() if c in df.columns}
    if not present:
        return df
    by_day = Window.partitionBy(*keys).orderBy(_DAY)
    added = {f"{c}_adstock": _carried(c, s, by_day) for c, s in present.items()}
    dated = df.withColumn(_DAY, F.unix_date(F.to_date(S.name(time))))
    if unique_grain is None:
        unique_grain = is_unique(dated, [*keys, _DAY])
    if unique_grain:
        return dated.withColumns(added).drop(_DAY)
    daily = dated.groupBy(*keys, _DAY).agg(
        *[F.sum(c).alias(c) for c in present], F.count(F.lit(1)).alias("_rows")
    )
    carried = daily.withColumns(added).drop(*present)
    return skew.attach_totals(dated, carried, [*keys, _DAY], "_rows", rows_per_task, (config.REP, config.CUSTOMER, *config.TYPE_TRIPLE)).select(
        *[S.name(c) for c in df.columns], *added
    )
