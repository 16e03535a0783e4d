"""Readers. Paths and table names come from the caller; nothing is located by convention."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneleffect.config import AdstockSpec, ModelConfig
from paneleffect.operators.roles import detect_roles


def read_run_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored run table; ``path`` may hold a glob over several stored parts."""
    return spark.read.parquet(path)


KEYS = ("outcome_type", "theme")


def read_keyed_table(
    spark: SparkSession, path: str, outcome_type: str | None = None, theme: str | None = None
) -> DataFrame:
    """A table stored by outcome type and theme; the filters prune folders before reading. Both keys are
    text, whatever they look like."""
    reader = spark.read.option("basePath", path)
    kinds = [T.StructField(f.name, T.StringType()) if f.name in KEYS else f for f in reader.parquet(path).schema]
    df = spark.read.option("basePath", path).schema(T.StructType(kinds)).parquet(path)
    for key, value in zip(KEYS, (outcome_type, theme)):
        df = df if value is None else df.where(F.col(key) == value)
    return df


def stored_keys(df: DataFrame) -> list[tuple[str, str]]:
    """The (outcome type, theme) pairs of a keyed table, from the names of its folders."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    parts = [dict(p.split("=", 1) for p in folder.split("/") if "=" in p) for folder in folders]
    # A folder's name is escaped by the writer, and its place again as an address.
    return sorted({tuple(unquote(unquote(p[k])) for k in KEYS) for p in parts})


def read_keyed_tables(spark: SparkSession, path: str) -> dict[tuple[str, str], DataFrame]:
    """One lazy frame per stored (outcome type, theme); no file is read for the list."""
    return {pair: read_keyed_table(spark, path, *pair) for pair in stored_keys(read_keyed_table(spark, path))}


# Texts that are whole numbers, and those that begin with a zero they would lose as one.
_WHOLE, _PADDED = "^[+-]?(0|[1-9][0-9]{0,17})$", "^[+-]?0[0-9]"


def with_types(df: DataFrame) -> DataFrame:
    """Text columns as the narrowest type that all their values have: boolean, bigint, double, date,
    timestamp, else text. One aggregate decides for all columns; a column without values stays text.

    A value with a leading zero, such as 007, keeps its column text, as does a whole number of more than 18 digits.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    marks = []
    for i, name in enumerate(names):
        c = F.trim(F.col(f"`{name}`"))
        number = c.try_cast("double").isNotNull() & ~c.rlike(_PADDED) & ~(c.rlike("^[+-]?[0-9]{19,}$"))
        day = c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & c.try_cast("date").isNotNull()
        time = c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}") & c.try_cast("timestamp").isNotNull()
        fits = {"n": c.isNotNull(), "boolean": F.lower(c).isin("true", "false"), "bigint": c.rlike(_WHOLE), "double": number, "date": day, "timestamp": time}
        marks += [F.count_if(fit).alias(f"{kind}{i}") for kind, fit in fits.items()]
    row = df.agg(*marks).first()
    kinds = {}
    for i, name in enumerate(names):
        full = [k for k in ("boolean", "bigint", "double", "date", "timestamp") if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]]
        if full:
            kinds[name] = full[0]
    return df.select(*[F.trim(F.col(f"`{c}`")).cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


def load_panel(spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """A tabular dataset with its types: parquet, or CSV with a header, whose types are found by ``with_types``. A
    ``schema`` saves the reading that finds them."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if (format or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")) == "csv":
        rows = reader.option("header", True).csv(path)
        return with_types(rows) if schema is None else rows
    return reader.parquet(path)


def load_panel_with_roles(spark: SparkSession, path: str, format: str | None = None):
    df = load_panel(spark, path, format)
    return df, detect_roles(df.columns)


def read_master_panel(spark: SparkSession, brand: str, locations: Mapping[str, str]) -> DataFrame:
    """The long panel of one brand: ``locations`` maps brand to a catalog table or a path."""
    if brand not in locations:
        raise ValueError(f"No panel is configured for {brand!r}.")
    place = locations[brand]
    return spark.read.parquet(place) if "/" in place else spark.table(place)


def read_model_config(spark: SparkSession, path: str) -> ModelConfig:
    values = spark.read.option("multiLine", True).json(path).first().asDict(recursive=True)
    adstock = values.get("adstock_params")
    if adstock:
        values["adstock_params"] = {c: AdstockSpec(**p) for c, p in adstock.items() if p}
    return ModelConfig(**values)
