"""From raw documents to packed training sequences, stage by stage.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's ``docs``; all but the last return the columns
of ``documents``. A stage judges all rows its predecessor kept, and on those alone. Columns beyond
those the stages need, and their names, are free; rows with null ids or texts are kept or dropped
as each stage's operator states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paneleffect.llm import common, decontam, jaccard, langid, linededup, packing

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises; it learns from their own labels."""
    return langid.accepted(docs, langid.fit(docs, langid.learnable()))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier, short ones that are equal included; a document that loses all its words goes."""
    return linededup.reduced(docs, short=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return jaccard.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, common.read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their token ids."""
    return packing.pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard", near_copies),
    ("benchmark_decontamination", benchmark),
    ("packing", packed),
]

#: The language model is fitted by gradient descent, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = common.read(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = common.stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
