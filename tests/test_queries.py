"""Every registered query of the library against its SQL twin, at the smallest scale."""

import importlib
import sys

import pytest

from weirflow import catalog

catalog.load()


@pytest.fixture(scope="session")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(d, cols):
    return sorted(tuple("NULL" if v is None or v is not v or str(v) in ("<NA>", "NaT", "nan") else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in d[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and rows(got, cols) == rows(want, cols)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_text_corpus(monkeypatch):
    """The subpackage and the pipeline may be gone: the other queries are still there."""
    import __spark_entry__ as e

    for m in [m for m in sys.modules if m.startswith("weirflow.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)

    class Gone(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name.startswith("weirflow.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    monkeypatch.delattr("weirflow.llm", raising=False)
    assert set(e.queries()) == set(catalog.QUERIES)
