"""What happened around a row in the same week: spillover share and activity indexes.

Each is a total over a group brought back to its rows. The total is a map-side combined
aggregate, and the join back spreads large groups, so a week or rep that holds a large part of
the panel does not end in one task as it would under a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneleffect import config
from paneleffect.functions import scalars as S
from paneleffect.functions import skew

_GRAIN = (config.REP, config.CUSTOMER, config.WEEK, *config.TYPE_TRIPLE)


def percent_other_suggested(
    df: DataFrame,
    rep: str = config.REP,
    week: str = config.WEEK,
    count: str = "suggestion_count",
    also_by: Sequence[str] = (),
    out: str = "percent_other_hcps_suggested",
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """Share of the rep's other customers of that week who got a suggestion; 0 with no others."""
    keys = [rep, week, *also_by]
    got = (F.coalesce(F.col(count), F.lit(0)) > 0).cast("double")
    totals = df.groupBy(*keys).agg(F.sum(got).alias("_suggested"), F.count(F.lit(1)).alias("_rows"))
    joined = skew.attach_totals(df, totals, keys, "_rows", rows_per_task, _GRAIN)
    share = S.safe_ratio(F.col("_suggested") - got, F.col("_rows") - 1)
    return joined.select(*[S.name(c) for c in df.columns], share.alias(out))


def weekly_activity_index(
    df: DataFrame,
    activity: str,
    keys: Sequence[str],
    out: str,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """Whole-number total of an activity over ``keys``, on every row."""
    totals = df.groupBy(*keys).agg(
        F.sum(activity).try_cast("bigint").alias(out), F.count(F.lit(1)).alias("_rows")
    )
    if all(isinstance(df.schema[k].dataType, T.DateType) for k in keys):
        # Calendar days are few, so the totals fit every executor.
        joined = skew.join_null_safe(df, F.broadcast(totals), keys, "left")
    else:
        joined = skew.attach_totals(df, totals, keys, "_rows", rows_per_task, _GRAIN)
    return joined.select(*[S.name(c) for c in df.columns], F.col(out))


def global_index(df: DataFrame, activity: str, week: str = config.WEEK, also_by: Sequence[str] = ()) -> DataFrame:
    return weekly_activity_index(df, activity, [week, *also_by], f"{activity}_global_index")


def rep_index(df: DataFrame, activity: str, rep: str = config.REP, week: str = config.WEEK) -> DataFrame:
    return weekly_activity_index(df, activity, [rep, week], f"{activity}_rep_global_index")


def customer_index(df: DataFrame, activity: str, customer: str = config.CUSTOMER, week: str = config.WEEK) -> DataFrame:
    return weekly_activity_index(df, activity, [customer, week], f"{activity}_hcp_global_index")
