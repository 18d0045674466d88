"""Budgets in tokens, not in words."""

from lumenframe.llm import mixing, queries, token_output


def test_mixing_counts_tokens(spark):
    texts = ["the house", "Donaudampfschifffahrtsgesellschaft!", "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = token_output.token_count(queries.tokenizer_path())
    got = {r.doc_id: r["__tokens"] for r in mixing.mix(docs, {"all": docs.doc_id * 0}, {}, tokens=count).collect()}
    library = token_output.encoder(queries.tokenizer_path()).tokenizer
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert got[2] > 1


def test_op8_reports_tokens(spark):
    sf = "/root/testdata/sf0.001"
    library = token_output.encoder(queries.tokenizer_path()).tokenizer
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_mixing(spark, sf).collect()
    assert got and all(r.n_tokens == len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in got)
