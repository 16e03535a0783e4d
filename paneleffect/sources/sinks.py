"""Writers. Everything large is written by the executors."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneleffect import config
from paneleffect.config import ModelConfig


def write_run_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_keyed_table(df: DataFrame, path: str) -> None:
    """Store by outcome type and theme, so that a reader of one pair opens only its folder."""
    df.write.mode("overwrite").partitionBy("outcome_type", "theme").parquet(path)


def propensity_columns(df: DataFrame, propensity_column: str) -> DataFrame:
    """The panel keys that are present, and the propensity."""
    wanted = (*config.PATH_A_KEYS, propensity_column)
    return df.select(*[c for c in wanted if c in df.columns])


def write_propensity(df: DataFrame, propensity_column: str, path: str) -> DataFrame:
    slim = propensity_columns(df, propensity_column)
    slim.write.mode("overwrite").parquet(path)
    return slim


def write_rollup_csv(df: DataFrame, path: str) -> None:
    """A rollup, a few rows per month, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def summary_frame(spark: SparkSession, plain: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """One row, one JSON text: plain values and small tables, each table an array of its rows."""
    one = spark.range(1).select(F.lit(json.dumps(plain)).alias("plain"))
    for label, table in tables.items():
        rows = table.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*table.columns)))).alias(label))
        one = one.crossJoin(F.broadcast(rows))
    parts: list = [F.lit('{"plain":'), F.col("plain")]
    for label in tables:
        parts += [F.lit(f',"{label}":'), F.col(label)]
    return one.select(F.concat(*parts, F.lit("}")).alias("value"))


def summary_schema(tables: dict[str, DataFrame], plain: T.StructType | None = None) -> T.StructType:
    """The nested type of a summary: the plain values' own, or text, and an array of rows per table."""
    fields = [T.StructField("plain", plain or T.StringType())]
    return T.StructType([*fields, *[T.StructField(label, T.ArrayType(t.schema)) for label, t in tables.items()]])


def read_summary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored summary as one typed row; a table's rows come back by ``inline`` of its column."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("s")).select("s.*")


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One short text as a file of its own."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_model_config(spark: SparkSession, model_config: ModelConfig, path: str) -> None:
    write_text(spark, json.dumps(model_config.to_dict()), path)
