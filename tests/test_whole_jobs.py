"""Queries on small tables made so that a shortened job would show, against brute force in Python."""

import datetime
import itertools
import math
import os

import duckdb
import pytest

from palimpsest.operators import graph, knowledge


@pytest.fixture(scope="module")
def hub(tmp_path_factory, data):
    """300 memories on one day, all mentioning one entity and each one of ten others, with no link and vectors for two in three."""
    d = str(tmp_path_factory.mktemp("hub"))
    c = duckdb.connect()
    c.execute(f"create view src as select * from '{data}/memories.parquet'")
    at = "timestamp '2025-05-01 00:00:00'"
    c.execute(f"copy (select t.* replace ('m' || lpad(i::varchar, 3, '0') as id, 0.5 as importance, null::timestamp as deleted_at, {at} + to_minutes(i::int) as loaded_at, null::timestamp as occurred_at, null::varchar as namespace) from (select * from src limit 1) t, range(300) r(i)) to '{d}/memories.parquet'")
    c.execute(f"create view me as select * from '{data}/memory_entities.parquet'")
    c.execute(f"copy (select t.* replace ('x' || i as mention_id, 'm' || lpad((i // 2)::varchar, 3, '0') as memory_id, case when i % 2 = 0 then 'hub' else 'e' || ((i // 2) % 10) end as entity_id) from (select * from me limit 1) t, range(600) r(i)) to '{d}/memory_entities.parquet'")
    c.execute(f"copy (select * from '{data}/hebbian_links.parquet' limit 0) to '{d}/hebbian_links.parquet'")
    c.execute(f"create view ve as select * from '{data}/memory_embeddings.parquet'")
    c.execute(f"copy (select t.* replace ('m' || lpad(i::varchar, 3, '0') as memory_id, 'nimbus-embed-64' as model, [cos((i * 7 % 11 + j * j)::double)::float for j in range(64)] as embedding) from (select * from ve limit 1) t, range(300) r(i) where i % 3 > 0) to '{d}/memory_embeddings.parquet'")
    return d


def cosine(v, w):
    return sum(x * y for x, y in zip(v, w)) / math.sqrt(sum(x * x for x in v) * sum(y * y for y in w))


def test_pairs_of_an_entity_in_many_memories(spark, hub):
    v = {k: [float(x) for x in e] for k, e in duckdb.sql(f"select memory_id, embedding from '{hub}/memory_embeddings.parquet'").fetchall()}
    ids = [f"m{i:03}" for i in range(300)]
    want = {}
    for i, j in itertools.combinations(range(300), 2):
        shared = 2 if i % 10 == j % 10 else 1
        a, b = ids[i], ids[j]
        cos = max(0.0, cosine(v[a], v[b])) if a in v and b in v else 0.0
        s = 0.3 * shared / (4 - shared) + 0.2 * cos + 0.1 * math.exp(-0.00413 * (j - i) / 60)
        if round(s, 6) >= 0.2:
            want[a, b] = s
    got = {(r.a, r.b): r.score for r in knowledge.cluster_pairs(spark, hub).collect()}
    assert len(want) > 10_000 and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_every_pair_to_merge_or_defer_and_every_co_mention(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "NAME_BLOCK", 8)
    names = ["wim visolmatek", "wim vusolmatek", "lars thanilelen", "lars thanlelen", "ann lee", "anne lee", "jo", "joe", "élise dufour", "elise dufour"]
    c = duckdb.connect()
    rows = [(f"e{i:02}", n if i < 10 else f"{n[::-1]} {i}", "person" if i % 3 else "project", datetime.datetime(2025, 1 + i % 6, 1)) for i, n in enumerate(names * 3)]
    c.execute("create table r (id varchar, name varchar, entity_type varchar, seen timestamp)")
    c.executemany("insert into r values (?, ?, ?, ?)", rows)
    c.execute(f"copy (select t.* replace (r.id as id, r.name as name, r.entity_type as entity_type, r.seen as first_seen, r.seen as last_seen, null::varchar as namespace) from (select * from '{data}/entities.parquet' limit 1) t, r) to '{tmp_path}/entities.parquet'")
    mentioned = {f"m{k}": {f"e{(5 * k) % 30:02}", f"e{(7 * k + 3) % 30:02}"} for k in range(12)}
    c.execute("create table s (memory_id varchar, entity_id varchar)")
    c.executemany("insert into s values (?, ?)", [(m, e) for m, es in mentioned.items() for e in es])
    c.execute(f"copy (select t.* replace (s.memory_id || s.entity_id as mention_id, s.memory_id as memory_id, s.entity_id as entity_id) from (select * from '{data}/memory_entities.parquet' limit 1) t, s) to '{tmp_path}/memory_entities.parquet'")
    of = {r[0]: {m for m, es in mentioned.items() if r[0] in es} for r in rows}
    want = {}
    for x, y in itertools.combinations(rows, 2):
        parts = [(0.6, graph.jaro_winkler(x[1], y[1])), (0.2, float(x[2] == y[2])), (0.2, 2 ** (-abs((x[3] - y[3]).days) / 30))]
        both = of[x[0]] & of[y[0]]
        if both:
            parts.append((0.2, len(both) / min(len(of[x[0]]), len(of[y[0]]))))
        score = round(sum(w * v for w, v in parts) / sum(w for w, _ in parts), 6)
        if both or score >= 0.6:
            want[x[0], y[0]] = score
    got = {(r.id, r.id2): r for r in graph.resolution_decisions(spark, str(tmp_path)).collect()}
    assert set(want) <= set(got) and all(abs(got[k].fused - v) < 2e-6 for k, v in want.items())
    assert all(r.decision == "new" for k, r in got.items() if k not in want)
    assert {got[k].decision for k in (("e00", "e01"), ("e02", "e03"))} <= {"merge", "defer"}
