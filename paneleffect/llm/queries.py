"""One query per operator of this subpackage, over its whole table, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paneleffect.llm import credentials, decontam, infill, jaccard, langid, licences, linededup, neighbours, packing, periodic, repeats, sharding, toxicity
from paneleffect.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(read(spark, sf_dir, "documents"), with_ids=False)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read(spark, sf_dir, "documents"))


def op7_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.classes(read(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))



def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.planted(read(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(read(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digest(read(spark, sf_dir, "documents"))


_ALL = (op1_licence_scan, op2_line_dedup, op3_language_id, op4_packing, op5_sharding, op6_ngram_jaccard, op7_embedding_neighbours, op8_toxicity, op9_substring_dedup, op10_decontamination, op11_periodic_runs, op12_fill_in_middle, op13_secret_scan)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op1_licence_scan": licences.sql(), "op2_line_dedup": linededup.SQL, "op9_substring_dedup": repeats.SQL, "op11_periodic_runs": periodic.SQL, "op12_fill_in_middle": infill.SQL, "op13_secret_scan": credentials.sql()}
