"""Feature selection and the fitted encoder that turns a panel into model vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    OneHotEncoderModel,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneleffect import config
from paneleffect.functions import scalars as S
from paneleffect.functions.skew import left_join_unique, numbered
from paneleffect.operators.clean import numeric_null_to_zero
from paneleffect.operators.roles import matching, prefer_adstock

FEATURES = "features"

def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _filled(df: DataFrame, column: str):
    """The value with null and NaN as 0 for numbers, as the encoder will see it."""
    kind = df.schema[column].dataType
    c = S.name(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c, F.lit(0))
    return c


def feature_report(
    df: DataFrame,
    patterns: Sequence[str],
    protected: Sequence[str] = config.PROTECTED_COLUMNS,
) -> list[tuple[str, bool, str]]:
    """(column, kept, reason) of every column whose name matches, in column order.

    "Has more than one value" is tested as min <> max, so all columns take one aggregate instead
    of one distinct count each.
    """
    found = matching(df.columns, patterns)
    if not found:
        return []
    row = df.agg(
        *[(F.min(_filled(df, c)) != F.max(_filled(df, c))).alias(f"v{i}") for i, c in enumerate(found)],
        *[F.count(_filled(df, c)).alias(f"n{i}") for i, c in enumerate(found)],
    ).first()
    reasons: dict[str, str] = {}
    for i, c in enumerate(found):
        if row[f"v{i}"]:
            reasons[c] = "varies"
        elif not row[f"n{i}"]:
            reasons[c] = "all_null"
        else:
            reasons[c] = "protected" if c in protected else "constant"
    kept = [c for c, r in reasons.items() if r in ("varies", "protected")]
    final = set(prefer_adstock(kept))
    return [(c, c in final, "adstocked" if c in kept and c not in final else reasons[c]) for c in found]


def feature_table(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        feature_report(df, patterns), "column string, kept boolean, reason string"
    )


def select_features(df: DataFrame, patterns: Sequence[str]) -> list[str]:
    return [c for c, kept, _ in feature_report(df, patterns) if kept]


def prepare_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same fill for fitting and for scoring, so that no row is dropped by the encoder."""
    return numeric_null_to_zero(df, features)


def fit_encoder(df: DataFrame, features: Sequence[str]) -> PipelineModel:
    """Index and one-hot encode text, put it before the numbers, scale by the deviation only.

    Missing or new text gets the all-zero vector; it keeps its row.
    """
    if not features:
        raise ValueError("No feature columns found.")
    text = [c for c in features if _is_text(df, c)]
    numbers = [c for c in features if c not in text]
    stages = []
    if text:
        stages += [
            StringIndexer(inputCol=c, outputCol=f"{c}_numeric", handleInvalid="keep") for c in text
        ]
        stages.append(
            OneHotEncoder(inputCols=[f"{c}_numeric" for c in text], outputCols=[f"{c}_vector" for c in text])
        )
    stages.append(
        VectorAssembler(
            inputCols=[*[f"{c}_vector" for c in text], *numbers], outputCol=f"unscaled_{FEATURES}"
        )
    )
    stages.append(StandardScaler(inputCol=f"unscaled_{FEATURES}", outputCol=FEATURES))
    return Pipeline(stages=stages).fit(prepare_features(df, features))


def encoder_inputs(encoder: PipelineModel) -> list[str]:
    """Names of the frame's columns the encoder reads."""
    text = [s.getInputCol() for s in encoder.stages if isinstance(s, StringIndexerModel)]
    assembled = next(s for s in encoder.stages if isinstance(s, VectorAssembler)).getInputCols()
    return [*text, *[c for c in assembled if not c.endswith("_vector")]]


def encode(df: DataFrame, encoder: PipelineModel) -> DataFrame:
    """Add the feature vector; the helper columns of the encoder are left out."""
    out = encoder.transform(prepare_features(df, encoder_inputs(encoder)))
    return out.select(*[S.name(c) for c in df.columns], F.col(FEATURES))


def feature_labels(encoder: PipelineModel) -> list[str]:
    """One label per position of the feature vector: ``<column>_<value>`` for text, then numbers."""
    labels = []
    hot = next((s for s in encoder.stages if isinstance(s, OneHotEncoderModel)), None)
    for i, s in enumerate(x for x in encoder.stages if isinstance(x, StringIndexerModel)):
        width = hot.categorySizes[i] - (1 if hot.getDropLast() else 0)
        labels += [f"{s.getInputCol()}_{value}" for value in s.labels[:width]]
    assembled = next(s for s in encoder.stages if isinstance(s, VectorAssembler)).getInputCols()
    return labels + [c for c in assembled if not c.endswith("_vector")]


@dataclass(frozen=True)
class WideEncoder:
    """Numbers as they are, then one-hot positions per category without its smallest value.

    ``indexes`` holds each category's values with their position, as a table: it is joined to the
    rows, so its size does not matter. Null and values not seen when fitting are all zeros.
    """

    numeric: tuple[str, ...]
    indexes: dict[str, DataFrame]
    sizes: dict[str, int]
    hot: OneHotEncoderModel | None

    def labels(self, leave_out: Sequence[str] = ()) -> list[str]:
        """One name per position of the vector, in order."""
        names = [c for c in self.numeric if c not in leave_out]
        for c, index in self.indexes.items():
            kept = index.where(F.col("_position") < self.sizes[c] - 1).orderBy("_position")
            names += [f"{c}_{r['_text']}" for r in kept.select(F.col("_value").cast("string").alias("_text")).toLocalIterator()]
        return names


def fit_wide_encoder(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> WideEncoder:
    """Number the values of each category, the largest first; a category with one value has no position.

    Values are compared as what they are, not as text, and numbered by ranges, so any number of
    them is taken and none is gathered.
    """
    indexes, sizes = {}, {}
    for c in categorical:
        ranked, n = numbered(df.select(S.name(c).alias("_value")).where(S.name(c).isNotNull()).distinct(), "_value")
        if n > 1:
            indexes[c] = ranked.select("_value", (F.lit(n - 1) - F.col("_rank")).cast("double").alias("_position"))
            sizes[c] = n
    hot = None
    if sizes:
        inputs = [f"{c}_numeric" for c in sizes]
        largest = df.sparkSession.createDataFrame([[float(n - 1) for n in sizes.values()]], inputs)
        hot = OneHotEncoder(inputCols=inputs, outputCols=[f"{c}_vector" for c in sizes]).fit(largest)
    return WideEncoder(tuple(numeric), indexes, sizes, hot)


def encode_wide(df: DataFrame, encoder: WideEncoder, variants: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Add the feature vector. ``variants`` names more vectors, each without some of the numbers."""
    out = df
    for c, index in encoder.indexes.items():
        # Rows without a value go round the join; a value with very many rows is split by the adaptive join.
        named = index.select(F.col("_value").alias(c), F.col("_position").alias(f"{c}_numeric"))
        out = left_join_unique(out, named, [c])
        out = out.fillna(float(encoder.sizes[c] - 1), subset=[f"{c}_numeric"])
    out = encoder.hot.transform(out) if encoder.hot else out
    wanted = {FEATURES: (), **(variants or {})}
    for name, leave_out in wanted.items():
        inputs = [*[c for c in encoder.numeric if c not in leave_out], *[f"{c}_vector" for c in encoder.sizes]]
        out = VectorAssembler(inputCols=inputs, outputCol=name).transform(out)
    return out.select(*[S.name(c) for c in df.columns], *wanted)


def append_feature(df: DataFrame, column: str, out: str) -> DataFrame:
    """A vector that is ``features`` with one more number at its end."""
    return VectorAssembler(inputCols=[FEATURES, column], outputCol=out).transform(df)
