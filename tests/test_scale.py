"""What keeps queries in proportion to the program: it passes once, nothing large is shuffled for a few rows; and odd
programs, with orders and parts that are there twice or not at all, against SQL."""

import pytest

from weirflow import catalog
from weirflow.operators import closure, engine
from weirflow.plans import derived

catalog.load()
ONCE = ["return_taint", "taint_interproc", "confidence_assignment", "global_taint", "dangerous_minus_taint", "rule_rows", "baseline_multiset"]


def test_groups_of_functions_stay_where_their_lines_are(spark, sf):
    """Lines are shuffled by part and by order, and not again for the groups."""
    plan = closure.summaries(derived.instructions(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(fn" not in plan


@pytest.mark.parametrize("name", ONCE)
def test_the_program_passes_once(spark, sf, monkeypatch, name):
    made, plain = [], derived.instructions
    monkeypatch.setattr(derived, "instructions", lambda *a: made.append(a[2:]) or plain(*a))
    catalog.QUERIES[name](spark, sf)
    assert len(made) == 1 and made[0] and "method_name" not in made[0]


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    duckdb = pytest.importorskip("duckdb")
    d, c = tmp_path_factory.mktemp("odd"), duckdb.connect()
    twice = {"orders": "o_orderkey % 7 = 0", "part": "p_partkey % 5 = 0"}
    for t, which in twice.items():
        gone = which.replace(" = 0", " = 3")
        c.execute(f"copy (select * from '{sf}/{t}.parquet' where not ({gone}) union all select * from '{sf}/{t}.parquet' where {which}) to '{d}/{t}.parquet'")
    c.execute(f"copy (select * from '{sf}/lineitem.parquet') to '{d}/lineitem.parquet'")
    for t in ("orders", "part", "lineitem"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", [n for n in ONCE if n not in ("rule_rows", "baseline_multiset")])
def test_odd_programs(spark, odd, name):
    d, c = odd
    got, want = catalog.QUERIES[name](spark, d).toPandas(), c.execute(catalog.ORACLES[name]).df()
    cols = sorted(want.columns)
    rows = lambda x: sorted(map(str, x[cols].itertuples(index=False, name=None)))
    assert rows(got) == rows(want) and len(want)


@pytest.mark.parametrize("most", [0, 500_000])
def test_rounds_by_hashes_and_by_shuffles_agree(spark, sf, monkeypatch, most):
    """The same findings whether the functions of a round are selected by a broadcast or joined as a whole."""
    monkeypatch.setattr(engine, "MOST", most)
    duck = pytest.importorskip("duckdb").connect()
    for t in ("orders", "part", "lineitem"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = {(r.fn, r.sink) for r in catalog.QUERIES["engine_taint"](spark, sf).collect()}
    assert got == set(duck.execute(catalog.ORACLES["engine_taint"]).fetchall())


def test_near_rows(spark):
    rows = spark.createDataFrame([(str(n), n) for n in range(100)], "fn string, n long")
    some = spark.createDataFrame([("7",), ("9",), ("x",)], "fn string")
    assert sorted(r.n for r in engine.near(rows, some, "fn", 3).collect()) == [7, 9]
    assert engine.near(rows, some, "fn", engine.MOST + 1) is rows
