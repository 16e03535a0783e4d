"""Building blocks that keep a result exact when one key holds a large part of all rows.

A plain window or join sends every row of a key to one task. Here a key with more than
``ROWS_PER_TASK`` rows is recognised from a map-side combined count and its rows are spread over
several tasks; every other key takes the ordinary path.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneleffect.functions import scalars as S

ROWS_PER_TASK = 4_000_000
FIT_PARTITIONS = 16
BLOCK, CONTEXT, SEQUENCE = "_block", "_context", "_sequence"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for intermediate tables; a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
            folder = tempfile.mkdtemp(prefix="paneleffect-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def durable_for_fitting(df: DataFrame) -> DataFrame:
    """A durable frame of at least ``FIT_PARTITIONS`` partitions, for an iterative fit.

    Adaptive execution packs a small frame into few partitions; those are spread again. The number
    does not depend on the machine, as fitted trees may depend on how rows are dealt out.
    """
    kept = durable(df)
    return kept if kept.rdd.getNumPartitions() >= FIT_PARTITIONS else kept.repartition(FIT_PARTITIONS)


def numbered(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Add ``_rank``, the row's number from 0 in the order of ``column``; also the number of rows.

    Rows are dealt to ranges, stored, and numbered within their range; the ranges' sizes, one row
    per range, give each range its first number.
    """
    at = F.monotonically_increasing_id()
    ranges = df.repartitionByRange(column).sortWithinPartitions(column)
    kept = durable(ranges.select("*", F.shiftright(at, 33).alias("_range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_range", "_size", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_first"))
    out = kept.join(first, "_range").withColumn("_rank", F.col("_first") + F.col("_at")).drop("_range", "_at", "_size", "_first")
    return out, sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join in which null keys equal each other, as they do in a grouping."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def left_join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """LEFT join on the panel grain, ``right`` holding each key once.

    Rows with a null key match nothing; they go round the join, so that they do not all hash to one
    task. A repeated left key is split at run time by the adaptive skew join. Filters and column
    choices above reach both scans.
    """
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    added = [f for f in right.schema if f.name not in keys]
    joined = left.where(~any_null).join(right, list(keys), "left")
    order = [*[S.name(c) for c in left.columns], *[S.name(f.name) for f in added]]
    rest = left.where(any_null).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    return joined.select(*order).unionByName(rest.select(*order))


def attach_totals(
    df: DataFrame,
    totals: DataFrame,
    keys: Sequence[str],
    size: str,
    rows: int = ROWS_PER_TASK,
    grain: Sequence[str] = (),
) -> DataFrame:
    """Bring per-key totals back to the rows; ``totals[size]`` is the number of rows of the key.

    The totals of a key larger than ``rows`` are repeated once per slice of ``rows`` rows, and the
    rows pick a slice by a hash of the key and the ``grain``, the columns that tell rows of a key
    apart (all columns if none are named). Totals are computed once and stored; the short list of
    large keys is read from there.
    """
    totals = durable(totals)
    slices = F.greatest(F.ceil(F.col(size) / rows), F.lit(1)).cast("int")
    heavy = totals.where(F.col(size) > rows).select(*keys, slices.alias("_slices"))
    sliced = totals.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    spread = F.pmod(F.col("_spread"), F.coalesce(F.col("_slices"), F.lit(1)))
    by = [*keys, *[c for c in grain if c in df.columns and c not in keys]] if grain else df.columns
    hashed = df.withColumn("_spread", F.xxhash64(*[S.name(c) for c in by]))
    marked = join_null_safe(hashed, heavy, keys, "left").withColumn("_slice", spread.cast("int"))
    return join_null_safe(marked, sliced, [*keys, "_slice"], "left").drop("_slice", "_slices", "_spread")


def heavy_groups(df: DataFrame, keys: Sequence[str], rows: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``rows`` rows: at most ``count / rows`` of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)


def lookback_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``_block``, ``_context`` and ``_sequence`` so that windows which look back at most
    ``lookback`` rows stay exact when they partition by ``keys + _block`` and order by
    ``order + _sequence``.

    Ordinary keys are one block. A key with more than ``rows`` rows is range-partitioned on its
    full order, in which ``_sequence`` tells copies of one row apart; each block is preceded by
    copies of the last ``lookback`` rows of its key that lie in earlier blocks, marked
    ``_context`` and to be dropped after the window.
    """
    heavy = durable(heavy_groups(df, keys, rows))
    blocks = heavy.agg(F.sum(F.ceil(F.col("_n") / rows)).alias("b")).first()["b"]
    one_block = {BLOCK: F.lit(0), CONTEXT: F.lit(False), SEQUENCE: F.lit(0).cast("bigint")}
    if not blocks:
        return df.withColumns(one_block)

    heavy_keys = heavy.select(*keys)
    cold = join_null_safe(df, heavy_keys, keys, "left_anti").withColumns(one_block)
    # Both the sequence and the range bounds must never be computed anew: store after each.
    numbered = durable(join_null_safe(df, heavy_keys, keys, "left_semi")).withColumn(
        SEQUENCE, F.monotonically_increasing_id()
    )
    full_order = [*order, SEQUENCE]
    hot = durable(
        numbered.repartitionByRange(int(blocks) + 1, *keys, *full_order).withColumn(BLOCK, F.spark_partition_id() + 1)
    )
    newest_first = Window.partitionBy(*keys, BLOCK).orderBy(*[F.col(c).desc() for c in full_order])
    in_order = Window.partitionBy(*keys).orderBy(*full_order)
    tails = (
        hot.withColumn("_back", F.row_number().over(newest_first))
        .where(F.col("_back") <= lookback)
        .drop("_back")
        .withColumn("_pos", F.row_number().over(in_order))
    )
    starts = tails.groupBy(*keys, BLOCK).agg(F.min("_pos").alias("_start"))
    before = tails.drop(BLOCK).withColumn(
        "_start", F.explode(F.sequence(F.col("_pos") + 1, F.col("_pos") + lookback))
    )
    context = join_null_safe(before, starts, [*keys, "_start"], "inner").drop("_start", "_pos")
    return (
        cold.unionByName(hot.withColumn(CONTEXT, F.lit(False)))
        .unionByName(context.withColumn(CONTEXT, F.lit(True)))
    )
