"""A corpus without language labels passes the language stage."""

import corpus_pipeline


def test_language_stage_without_labels(spark):
    rows = [(1, "clean text", None, "s", 1), (2, "12 34", None, "s", 1), (3, None, None, "s", 1), (4, "\u6587\u7ae0", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS and sorted((r.doc_id, r.lang) for r in kept.collect()) == [(1, "und"), (4, "und")]
