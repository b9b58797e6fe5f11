import datetime

import numpy as np

from palimpsest.operators.references import and_not, dangling_references, pack, unpack

R = "ref_table string, kind string, row_key string, key string, loaded_at timestamp_ntz"
P = "kind string, key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def t(m, d=1):
    return datetime.datetime(2024, m, d)


def test_containers():
    rng = np.random.default_rng(1)
    for n, k in ((10, 5), (5000, 6000), (60000, 100), (0, 5)):
        a, b = np.unique(rng.integers(0, 65536, n)), np.unique(rng.integers(0, 65536, k))
        assert list(unpack(pack(a))) == list(a)
        assert list(unpack(and_not(pack(a), pack(b)))) == sorted(set(a.tolist()) - set(b.tolist()))


def test_reasons(spark):
    refs = [
        ("x", "m", "1", " A ", t(5)), ("x", "m", "2", "gone", t(5)), ("x", "m", "3", "late", t(5)), ("x", "m", "4", "del", t(5, 20)), ("x", "m", "5", "del", t(5, 2)), ("x", "m", "6", None, t(5)),
        ("x", "m", "7", "  ", t(5)), ("x", "m", "1", "a", t(5)), ("x", "m", "8", "a", None), ("y", "e", "9", "a", t(5)), ("x", "m", "10", "re", t(5)),
    ]
    pars = [("m", "a", t(1), None), ("m", "late", t(6), None), ("m", "del", t(1), t(5, 10)), ("m", "re", t(7), None), ("m", "re", t(2), None), ("m", None, t(1), None)]
    refs_df = spark.createDataFrame(refs, R).selectExpr("*", "'q' as reason", "1 as low")
    for size in (32768, 1):
        got = {(r["ref_table"], r["row_key"]): r["reason"] for r in dangling_references(refs_df, spark.createDataFrame(pars, P), keys_per_bucket=size).collect()}
        assert got == {("x", "2"): "missing", ("x", "3"): "late", ("x", "4"): "deleted", ("y", "9"): "missing"}


def test_empty(spark):
    assert dangling_references(spark.createDataFrame([], R), spark.createDataFrame([], P)).count() == 0
    one = dangling_references(spark.createDataFrame([("x", "m", "1", "a", t(1))], R), spark.createDataFrame([], P)).collect()
    assert [(r["reason"], r["period"]) for r in one] == [("missing", "2024-01")]


def test_hot_key(spark):
    refs = spark.range(20000).selectExpr("'x' as ref_table", "'m' as kind", "cast(id as string) as row_key", "if(id % 3 = 0, 'hot', cast(id as string)) as key", "timestamp_ntz'2024-05-01' as loaded_at")
    assert dangling_references(refs, spark.createDataFrame([("m", "5", t(1), None)], P)).count() == 19999
