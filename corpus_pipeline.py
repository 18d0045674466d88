"""A corpus pipeline of five of the operators in lumenframe.llm. Each stage gets what its predecessor kept, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, language_id, mixing, near_copies, token_output
from lumenframe.llm.frames import Scratch, passing, table
from lumenframe.llm.queries import encoded, mix_levels, mix_weights, tokenizer_path

#: Rows to leave out whose keys are sent to every task; of more, texts are shuffled once.
MOST_SENT = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a language (null, or without a letter) go; so do those between two languages without a
    difference. The label of the others becomes the predicted language. Without any label to learn from, all texts with a letter stay.
    A null id, label or source stays as it is, rows that repeat are each judged, long texts are read whole, an empty table gives none;
    only the columns of documents go on."""
    model = language_id.fit(docs.where(language_id.fold() != 1))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).withColumn("lang", F.lit(language_id.UNKNOWN)).select(*COLUMNS)
    found = language_id.predict(docs, model, [F.col("doc_id"), F.col("source"), F.col("n_chars")], with_text=True)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous"))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, most_sent: int = MOST_SENT) -> DataFrame:
    """Near copies, of a Jaccard similarity of 0.8 or more in shingles of 5 words: of each component the document with the smallest
    id stays (a null id counts as larger than any), one of its rows if the id repeats. Texts without words are copies of each other."""
    own = F.xxhash64(*COLUMNS)
    fps, groups = near_copies.groups(docs, [F.col("doc_id").alias("id"), own.alias("row")])
    # The choice is made on narrow rows; only rows that carry their component's id can stay.
    scratch = Scratch(spark, "near_duplicates")
    counted = fps.groupBy("fp", "id", "row").agg(F.count("*").alias("n"))
    placed = counted.join(groups, "fp")
    first = placed.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min(F.struct("row", "id", "n")).alias("r"))
    size = fps.count()
    stays = scratch.save(first.select("r.*"), "stays", size)
    keys = lambda df: df.select(F.col("id").alias("__id"), F.col("row").alias("__row"))
    rows = docs.select(*COLUMNS, own.alias("__own"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__row"))
    twins = keys(stays.where("n > 1"))
    once = rows.join(twins, same, "left_semi").dropDuplicates(["doc_id", "__own"])
    gone = scratch.save(counted.select("id", "row").join(stays.where("n = 1").select(F.col("id").alias("i"), F.col("row").alias("r")), F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left_anti"), "gone", size)
    if gone.limit(most_sent + 1).count() <= most_sent:  # the texts stay where they are
        whole = rows.join(F.broadcast(keys(gone)), same, "left_anti")
    else:
        whole = rows.join(keys(stays.where("n = 1")), same, "left_semi")
    return whole.select(*COLUMNS).union(once.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: a document with a window of ten words of the benchmark goes, and all its copies. A null or empty text
    stays, as does every row without such a window, whatever its nulls and repeats; long texts are searched whole; without a benchmark
    all stay, and an empty table gives none."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: as many tokens as there are, in the target weights, each document up to four times; it stands there once for each time.
    A null language or source is one of its own; a document without tokens follows its place in its leaf's order; rows that agree in
    id and text go together; long texts count whole; an empty table gives none."""
    mixed = mixing.mix(docs.select(*COLUMNS), mix_levels(), mix_weights(), epochs=4, seed=20, tokens=token_output.token_count(tokenizer_path()), share=1.0)
    return mixing.repeat(mixed, COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output: every document that is left, each repeat too, in the store by ascending id (null first); the result is the
    store's digest, read back from its files. A null or empty text has only the end id; an empty table gives an empty store."""
    return encoded(spark, docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("token_output", tokens)]

#: SQL has neither the classifier's weights nor the hashes; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder. A stage's table goes when the next one's is written, as do the operators' own."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with passing(spark):
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
