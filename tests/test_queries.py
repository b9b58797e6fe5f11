"""Every query of the core against its SQL on the smallest data, and that the contract holds."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES = {k: v for k, v in contract.CORE.items()}


def rows(df):
    df = df[sorted(df.columns)]
    fix = lambda x: None if x is None or x != x else round(float(x), 4) if isinstance(x, float) else str(x)
    return sorted([tuple(fix(x) for x in r) for r in df.itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, db, name):
    got = QUERIES[name](spark, data).toPandas()
    sql = contract.CORE_SQL.get(name)
    if sql:
        want = db.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=2e-4)) for p, q in zip(x, y)), (x, y)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).limit(1).count() == 1


def test_core_does_not_import_llm():
    root = os.path.join(os.path.dirname(contract.__file__), "palimpsest")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "palimpsest.llm" not in open(os.path.join(folder, n), encoding="utf-8").read()
