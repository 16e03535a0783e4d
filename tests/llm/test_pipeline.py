"""The pipeline's stages keep what they should and act on all their predecessor kept."""

import corpus_pipeline
from test_text_operators import brute_jaccard

from paneleffect.llm import common

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = common.read(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    benchmark = [r["text"] for r in common.read(spark, SF, "benchmark").collect()]
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(apply(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "language_id":
            assert counts[-1] >= 0.97 * counts[0]
        if name == "ngram_jaccard":
            assert all(k == c for k, c in brute_jaccard(rows)[1].items())
        if name == "benchmark_decontamination":
            assert not any(item in text for _, text in rows for item in benchmark)
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` < 1024").count() <= 1


def test_pipeline_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string"
    some = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "h") for r in common.read(spark, SF, "documents").limit(60).collect()]
    odd = [(None, "the and of that is with", "en", None, None, None), (900, None, None, None, 0, None), (901, "", "en", "", 0, None), some[0], some[0]]
    for rows in (some + odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, apply in corpus_pipeline.STAGES:
            docs = common.stage(apply(spark, docs, SF), name)
        assert docs.count() >= len(rows) // 2
