"""Queries over near vectors keep a bounded number of rows for each memory between steps, not every pair; files of a step go with it."""

import math
import time

import duckdb
import pytest

import __spark_entry__ as contract
from palimpsest.functions import common
from palimpsest.operators import association, knowledge, topics, vector_join


@pytest.fixture(scope="module")
def alike(tmp_path_factory, data):
    """240 memories with vectors from a cosine of 0.97 on, one minute apart; 200 of them mention one entity. Two more have a cosine of 0.5999997."""
    d = str(tmp_path_factory.mktemp("alike"))
    c = duckdb.connect()
    of = lambda t: f"(select * from '{data}/{t}.parquet' limit 1) t"
    c.execute(f"copy (select t.* replace ('m' || lpad(i::varchar, 3, '0') as id, null::timestamp as deleted_at, timestamp '2025-05-01' + to_minutes(i::int) as loaded_at, null::timestamp as occurred_at, 'n' || (i // 240) as namespace, 0.5 as importance) from {of('memories')}, range(242) r(i)) to '{d}/memories.parquet'")
    c.execute(f"copy (select t.* replace ('x' || i as mention_id, 'm' || lpad((i % 200)::varchar, 3, '0') as memory_id, case when i < 200 then 'hub' else 'e' || (i % 7) end as entity_id) from {of('memory_entities')}, range(400) r(i)) to '{d}/memory_entities.parquet'")
    c.execute(f"copy (select * from '{data}/hebbian_links.parquet' limit 0) to '{d}/hebbian_links.parquet'")
    far = f"[case when i = 240 then (j = 0)::int::double when j = 0 then 0.5999997 when j = 1 then {math.sqrt(1 - 0.5999997**2)} else 0.0 end::float for j in range(64)]"
    c.execute(f"copy (select t.* replace ('m' || lpad(i::varchar, 3, '0') as memory_id, 'nimbus-embed-64' as model, case when i < 240 then [(1 + 0.1 * cos((i * 7 + j * j)::double))::float for j in range(64)] else {far} end as embedding) from {of('memory_embeddings')}, range(242) r(i)) to '{d}/memory_embeddings.parquet'")
    return d


@pytest.mark.parametrize("name", ["nearest_duplicates", "discover_associations", "mutual_neighbours"])
def test_equal_to_sql_without_a_row_for_each_pair(spark, alike, monkeypatch, name):
    written = []

    def counted(df, **kw):
        out = common.checkpoint(df, **kw)
        written.append(out.count())
        return out

    for m in (association, knowledge, topics, vector_join):
        monkeypatch.setattr(m, "checkpoint", counted)
    monkeypatch.setattr(vector_join, "BLOCK", 50)
    got = {tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in contract.queries()[name](spark, alike).collect()}
    c = duckdb.connect()
    for t in ("memories", "memory_entities", "memory_embeddings", "hebbian_links"):
        c.execute(f"create view {t} as select * from '{alike}/{t}.parquet'")
    for t in ("access_log", "entities", "entity_relations"):
        c.execute(f"create view {t} as select * from '{common_data(t)}'")
    columns = ", ".join(contract.queries()[name](spark, alike).columns)
    want = {tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in c.sql(f"select {columns} from ({contract.oracle_sql()[name]})").fetchall()}
    assert got == want
    assert max(written) < 240 * 239 / 2 / 4
    if name == "mutual_neighbours":
        assert ("m240", "m241", 0.6) in got


def common_data(name):
    return f"/root/testdata/sf0.001/{name}.parquet"


def test_shuffle_files_go_with_their_step(spark):
    files = lambda: {b.toString() for b in _all(spark) if b.isShuffle()}
    before = files()
    out = common.checkpoint(spark.range(1000).repartition(7, "id"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 1000


def _all(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return [blocks.apply(i) for i in range(blocks.size())]
