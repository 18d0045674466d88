"""The pipeline's stages against brute force on a small corpus, and the registered queries on the smallest tables."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lumenframe.llm import queries, token_output
from lumenframe.llm.frames import shared_dir
from tests.llm.test_near_copies import brute_labels
from tests.llm.test_text_windows import brute_hits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(900, None, "en", "src1", 0), (901, "", "en", "src1", 0), (902, "123 456", None, None, None), (None, "the and of the and of it was", None, None, None)]
    rows = docs.collect()
    again = [tuple(rows[3]), (903, *tuple(rows[3])[1:])]
    docs = docs.union(spark.createDataFrame(extra + again, docs.schema))
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = (before.collect(), docs.collect())
        assert name == "token_output" or docs.columns == corpus_pipeline.COLUMNS
    key = lambda r: (r.doc_id, r.text)

    before, after = held["language_id"]
    letters = [r for r in before if r.text and re.search(r"[^\W\d_]", r.text)]
    assert len(before) == 206 and {key(r) for r in after} <= {key(r) for r in letters} and len(after) >= 0.99 * len(letters)

    before, after = held["near_duplicates"]
    comp = brute_labels([r.text for r in before])
    groups = {}
    for c, r in zip(comp, before):
        groups.setdefault(c, []).append(r)
    assert len(after) == len(groups)
    least = {c: min((r.doc_id for r in g if r.doc_id is not None), default=None) for c, g in groups.items()}
    assert Counter(r.doc_id for r in after) == Counter(least.values())

    before, after = held["decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = Counter(i for i, *_, bad in brute_hits([(r.doc_id, r.text) for r in before], bench, 10) if bad)
    assert Counter(r.doc_id for r in before) - Counter(r.doc_id for r in after) == dirty and dirty

    before, after = held["mixing"]
    taken = Counter(key(r) for r in after)
    assert set(taken) <= {key(r) for r in before} and max(taken.values()) <= 4
    library = token_output.encoder(queries.tokenizer_path()).tokenizer
    size = {key(r): len(library.encode(r.text, add_special_tokens=False).ids) for r in before}
    tokens = lambda rs: sum(size[key(r)] for r in rs)
    assert 0.9 * tokens(before) < tokens(after) <= tokens(before)

    before, after = held["token_output"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    starts = sorted((r.start, r.n_tokens) for r in after)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_run_leaves_only_what_is_read(spark):
    """The result of run(), from stages that are written and read, and no table of an earlier stage after it."""
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    frame = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, docs.collect()))
    left = [p for d in set(folder.iterdir()) - before if d.name.startswith("pipeline-") for p in d.iterdir()]
    assert [p.name.split("-", 1)[1] for p in left] == ["mixing"]


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_duplicates_without_ids(spark):
    rows = [(None, "same text here", None, None, None), (None, "same text here", None, None, None), (None, "x y z and more", "en", "s", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert sorted(r.text for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == ["same text here", "x y z and more"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == want


def test_contract_columns(spark):
    want = {
        "op2_token_output": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op3_html_extract": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op5_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op6_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op9_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op10_vector_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    }
    for name, columns in want.items():
        frame = entry.queries()[name](spark, SF)
        assert columns.items() <= dict(frame.dtypes).items(), name
        assert frame.count() == {"op3_html_extract": 50, "op10_vector_search": 50}.get(name, 200), name
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in entry.queries()["op9_decontaminate"](spark, SF).collect()}
