"""Data checks on a raw wide panel: one aggregate over the rows and one over the grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneleffect import config
from paneleffect.config import Roles
from paneleffect.functions import scalars as S


def _parsed(df: DataFrame, roles: Roles) -> Column:
    return S.time_or_null(df, roles.time)


def _numeric_share(df: DataFrame, roles: Roles) -> Column:
    """Share of filled metric cells that hold a number; 1 without any filled cell."""
    if not roles.metrics:
        return F.lit(1.0)
    good = sum((F.count(S.number_or_null(df, c)) for c in roles.metrics), F.lit(0))
    # A floating NaN cell counts as empty, as does null.
    filled = sum(
        (
            F.count(F.when(~F.isnan(S.name(c)), S.name(c))) if df.schema[c].dataType.typeName() in ("double", "float")
            else F.count(S.name(c))
            for c in roles.metrics
        ),
        F.lit(0),
    )
    return F.coalesce(good / F.when(filled != 0, filled), F.lit(1.0))


def parseable_time_share(df: DataFrame, roles: Roles) -> DataFrame:
    return df.agg(F.avg(_parsed(df, roles).isNotNull().cast("double")).alias("parseable_share"))


def ids_present(df: DataFrame, roles: Roles) -> DataFrame:
    return df.agg(F.bool_and(S.name(roles.hcp).isNotNull() & S.name(roles.rep).isNotNull()).alias("ids_present"))


def numeric_share(df: DataFrame, roles: Roles) -> DataFrame:
    return df.agg(_numeric_share(df, roles).alias("numeric_share"))


def grain(df: DataFrame, roles: Roles) -> DataFrame:
    """One row: the largest number of rows per (hcp, rep, time), null when no row has all three."""
    keyed = df.select(
        S.name(roles.hcp).alias("h"), S.name(roles.rep).alias("r"), _parsed(df, roles).alias("t")
    ).dropna()
    return keyed.groupBy("h", "r", "t").count().agg(F.max("count").alias("largest_group"))


def grain_check(df: DataFrame, roles: Roles) -> DataFrame:
    return grain(df, roles).select(F.coalesce(F.col("largest_group") <= 1, F.lit(False)).alias("grain_consistent"))


def month_depth(df: DataFrame, roles: Roles) -> DataFrame:
    return df.agg(F.count_distinct(F.date_trunc("month", _parsed(df, roles))).alias("months"))


def _percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def checklist(df: DataFrame, roles: Roles) -> DataFrame:
    """The five checks in their fixed order: (position, key, label, status, detail)."""
    rows = df.agg(
        F.coalesce(F.avg(_parsed(df, roles).isNotNull().cast("double")), F.lit(0.0)).alias("time_share"),
        F.coalesce(F.bool_and(S.name(roles.hcp).isNotNull() & S.name(roles.rep).isNotNull()), F.lit(True)).alias("ids"),
        _numeric_share(df, roles).alias("numeric"),
        # Months are a handful; a set of them merges on the map side without expanding the rows.
        F.size(F.collect_set(F.date_trunc("month", _parsed(df, roles)))).alias("months"),
    )
    one = rows.crossJoin(F.broadcast(grain(df, roles)))
    grain_ok = F.coalesce(F.col("largest_group") <= 1, F.lit(False))
    said = config.CHECK_DETAILS
    grain_text = F.when(F.col("largest_group").isNull(), said["no_rows"]).when(grain_ok, said["grain"]).otherwise(said["no_grain"])

    def filled(sentence: str, value: Column) -> Column:
        before, after = said[sentence].split("{}")
        return F.concat(F.lit(before), value, F.lit(after))

    results = [
        (F.col("time_share") >= config.MIN_PARSEABLE_TIME, filled("time", _percent(F.col("time_share")))),
        (F.col("ids"), F.when(F.col("ids"), said["ids"]).otherwise(said["no_ids"])),
        (F.col("numeric") >= config.MIN_NUMERIC_SHARE, filled("numeric", _percent(F.col("numeric")))),
        (grain_ok, grain_text),
        (F.col("months") >= config.MIN_MONTHS, filled("months", F.col("months").cast("string"))),
    ]
    lines = [(key, label, ok, detail) for (key, label), (ok, detail) in zip(config.CHECKS.items(), results, strict=True)]
    items = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(key).alias("key"),
            F.lit(label).alias("label"),
            F.when(ok, "pass").otherwise("warn").alias("status"),
            detail.alias("detail"),
        )
        for i, (key, label, ok, detail) in enumerate(lines, 1)
    ]
    return one.select(F.inline(F.array(*items)))
