"""Registered queries against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lumenframe import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == want


def test_every_query_without_sql_is_known():
    assert set(own.queries()) - set(own.oracle_sql()) == {"pca_components", "mnf_eigenvalues"}
    assert set(own.oracle_sql()) <= set(own.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 500


def test_a_broken_subpackage_leaves_the_rest(monkeypatch):
    """Whatever is wrong with the training-data subpackage is told, and the other queries are there."""
    import builtins

    real = builtins.__import__

    def broken(name, *args, **more):
        if name == "lumenframe.llm":
            raise RuntimeError("does not work")
        return real(name, *args, **more)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.warns(UserWarning, match="does not work"):
        names = set(entry.queries())
    assert set(own.queries()) <= names and not any(n.startswith("op") and n[2].isdigit() for n in names)

    def missing(name, *args, **more):
        if name in ("lumenframe.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **more)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert set(entry.queries()) == set(own.queries()) and set(entry.oracle_sql()) == set(own.oracle_sql())
