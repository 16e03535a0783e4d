"""Exact quantiles with linear interpolation, all columns in one pass and no column in one task.

Equal values of a column are counted first (combined before the shuffle); the (column, value)
pairs are dealt to ranges of that order, counted per range, and each wanted rank is found in its
range from the ranges' totals. There is one way for every size.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneleffect.functions import scalars as S
from paneleffect.functions.skew import durable


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Count, mean, both standard deviations and range per column: one job."""
    aggregates = []
    for i, c in enumerate(columns):
        x = S.name(c).cast("double")
        aggregates += [
            F.count(x).alias(f"count_{i}"),
            F.avg(x).alias(f"mean_{i}"),
            F.stddev_pop(x).alias(f"std_pop_{i}"),
            F.stddev_samp(x).alias(f"std_samp_{i}"),
            F.min(x).alias(f"min_{i}"),
            F.max(x).alias(f"max_{i}"),
        ]
    row = df.agg(*aggregates).first()
    fields = ("count", "mean", "std_pop", "std_samp", "min", "max")
    return {c: {f: row[f"{f}_{i}"] for f in fields} for i, c in enumerate(columns)}


def ranked_values(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """((c, v, n, part): each column's values, counted, in stored ranges; (c, part, rows): their totals).
    ``c`` is the column's position."""
    values = F.array(*[F.struct(F.lit(i).alias("c"), S.name(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    long = df.select(F.inline(values)).where(F.col("v").isNotNull())
    counted = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    # Stored: the bounds of the ranges must not be drawn anew between the two uses.
    ranges = durable(counted.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()))
    return ranges, ranges.groupBy("c", "part").agg(F.sum("n").alias("rows"))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float | None]]:
    """Quantiles of each column, nulls left out."""
    ranges, totals = ranked_values(df, columns)
    # One row per range and column in it.
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = totals.withColumn("before", before)
    counts = {r["c"]: r["n"] for r in totals.groupBy("c").agg(F.sum("rows").alias("n")).collect()}
    wanted = sorted(
        {(c, rank) for c, n in counts.items() for p in probabilities for rank in (floor(p * (n - 1)), ceil(p * (n - 1)))}
    )
    found: dict[tuple[int, int], float] = {}
    if wanted:
        ranks = df.sparkSession.createDataFrame(wanted, "c int, rank long")
        inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("rows"))
        # Only the ranges that hold a wanted rank are ordered; they are as many as the ranks at most.
        chosen = placed.join(F.broadcast(ranks), "c").where(inside).select("c", "part", "before", "rank")
        held = ranges.join(F.broadcast(chosen.select("c", "part", "before").distinct()), ["c", "part"])
        upto = F.sum("n").over(Window.partitionBy("c", "part").orderBy("v")) + F.col("before")
        spans = held.withColumn("upto", upto)
        hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        for r in spans.join(F.broadcast(chosen.drop("before")), ["c", "part"]).where(hit).select("c", "rank", "v").collect():
            found[r["c"], r["rank"]] = r["v"]
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        places = [p * (counts[i] - 1) for p in probabilities] if i in counts else None
        out[c] = [None] * len(probabilities) if places is None else [_between(found, i, x) for x in places]
    return out


def _between(found: dict[tuple[int, int], float], column: int, place: float) -> float:
    low, high = found[column, floor(place)], found[column, ceil(place)]
    return low if low == high else low + (high - low) * (place - floor(place))
