"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans import registry
from graphloom.sources.tables import TABLES

DATA = "/root/testdata/sf0.001"
SLOW = {"clusters", "louvain_communities", "betweenness", "questions_bridges"}  # their operators have tests of their own


def canon(df):
    rows = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry_works_without_the_optional_subpackage(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    whole = set(entry.queries())
    true_import = builtins.__import__

    def missing(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("graphloom.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return true_import(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())
    assert set(entry.queries()) <= whole
