"""Clusters: pairs are scored where they meet, so no step holds a row for each near or shared pair; rounds move labels only."""

import itertools
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import common
from palimpsest.operators import knowledge, vector_join


def _vector(i):
    return [] if i >= 240 else [float(np.float32(1 + 0.1 * math.cos(i * 7 + j * j))) for j in range(64)]


@pytest.fixture(scope="module")
def apart(tmp_path_factory, data):
    """240 memories with vectors from a cosine of 0.97 on, four written at a time, 100 days between; 200 more without vectors share an entity."""
    d = str(tmp_path_factory.mktemp("apart"))
    c = duckdb.connect()
    of = lambda t: f"(select * from '{data}/{t}.parquet' limit 1) t"
    c.execute(f"copy (select t.* replace ('m' || lpad(i::varchar, 3, '0') as id, case when i = 7 then timestamp '2025-01-01' end as deleted_at, timestamp '1980-01-01' + to_days((i // 4 * 100)::int) + to_minutes((i % 4)::int) as loaded_at, null::timestamp as occurred_at, case when i = 9 then 0.2 else 0.5 end as importance) from {of('memories')}, range(440) r(i)) to '{d}/memories.parquet'")
    c.execute(f"copy (select t.* replace (i as mention_id, 'm' || lpad((240 + i % 200)::varchar, 3, '0') as memory_id, case when i < 200 then 'hub' when i % 200 < 6 then 'few' || (i // 200) else 'own' || i end as entity_id) from {of('memory_entities')}, range(1000) r(i)) to '{d}/memory_entities.parquet'")
    # a weak pair that a link makes an edge, and a close pair that a link unmakes
    c.execute(f"copy (select t.* replace (a as source_id, b as target_id, s as strength) from {of('hebbian_links')}, (values ('m300', 'M020', 3.0), ('m020', 'm300', 2.5), ('m013', 'm012', -5.0), ('m007', 'm100', 9.0)) v(a, b, s)) to '{d}/hebbian_links.parquet'")
    x = "[(1 + 0.1 * cos((i * 7 + j * j)::double))::float for j in range(64)]"
    c.execute(f"copy (select t.* replace ('m' || lpad(i::varchar, 3, '0') as memory_id, 'nimbus-embed-64' as model, {x} as embedding) from {of('memory_embeddings')}, range(240) r(i)) to '{d}/memory_embeddings.parquet'")
    return d


def test_pairs_are_scored_where_they_meet(spark, apart, monkeypatch):
    written = []

    def counted(df, **kw):
        out = common.checkpoint(df, **kw)
        written.append(out.count())
        return out

    for m in (knowledge, vector_join):
        monkeypatch.setattr(m, "checkpoint", counted)
    monkeypatch.setattr(vector_join, "BLOCK", 50)
    got = {(r["a"], r["b"]): r["score"] for r in knowledge.pair_scores(spark, apart, near=True).filter("score >= 0.2").collect()}

    ents, links = defaultdict(set), {("m020", "m300"): 5.5, ("m012", "m013"): -5.0}
    for i in range(1000):
        ents[240 + i % 200].add("hub" if i < 200 else f"few{i // 200}" if i % 200 < 6 else f"own{i}")
    x = np.array([_vector(i) for i in range(240)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    want = {}
    for i, j in itertools.combinations([i for i in range(440) if i not in (7, 9)], 2):
        pair = (f"m{i:03d}", f"m{j:03d}")
        cos = max(0.0, sim[i, j]) if j < 240 else 0.0
        both = ents[i] & ents[j]
        if pair in links or both or cos >= 0.85:
            hours = abs((i // 4 * 100 * 1440 + i % 4) - (j // 4 * 100 * 1440 + j % 4)) / 60
            score = round(0.4 * min(links.get(pair, 0.0) / 10, 1.0) + 0.3 * (len(both) / max(1, len(ents[i] | ents[j]))) + 0.2 * cos + 0.1 * math.exp(-0.00413 * hours), 6)
            if score >= 0.2:
                want[pair] = score
    assert set(got) == set(want) and all(abs(got[p] - s) < 2e-6 for p, s in want.items())
    assert ("m020", "m300") in got and ("m012", "m013") not in got and ("m240", "m241") in got
    assert max(written) < 2_000  # 28,203 near pairs, 19,900 with a common entity


@pytest.mark.parametrize("block", [2, 1_000])
def test_each_pair_of_an_entity_meets_once(spark, block):
    sizes = {"a": 9, "b": 1, "c": 4, "d": 2}
    mentions = [(f"{e}{i}", e) for e, n in sizes.items() for i in range(n)] + [("a0", "c"), ("a1", "c")]
    rows = spark.createDataFrame([(i, None) for i in sorted({m[0] for m in mentions})], "id string, v array<float>")

    def score(left, right, i, j):
        import pyarrow as pa

        x, y = left.id.take(pa.array(i)), right.id.take(pa.array(j))
        return pa.RecordBatch.from_arrays([x, y, pa.array(np.ones(len(i))), pa.array(np.ones(len(i), np.int32))], ["a", "b", "score", "known"])

    got = knowledge.met_in_parts(spark.createDataFrame(mentions, "id string, entity_id string"), rows, score, "a string, b string, score double, known int", block=block).collect()
    want = [tuple(sorted(p)) for e in sizes for p in itertools.combinations([i for i, x in mentions if x == e], 2)]
    assert sorted(tuple(sorted((r["a"], r["b"]))) for r in got) == sorted(want)


def test_rounds_move_labels_only(spark, monkeypatch):
    from palimpsest.operators import propagation

    draw = random.Random(3)
    ids = [f"n{i:03d}" for i in range(120)]
    edges = {tuple(sorted(draw.sample(ids, 2))): round(draw.random(), 2) for _ in range(500)}
    written = []

    def counted(df, **kw):
        out = common.checkpoint(df, **kw)
        written.append((tuple(out.columns), out.count()))
        return out

    monkeypatch.setattr(propagation, "checkpoint", counted)
    monkeypatch.setattr(propagation, "NODES", 20)
    graph = propagation.Graph(spark.createDataFrame([(*p, s) for p, s in edges.items()], "a string, b string, score double"))
    names = {r["k"]: r["id"] for r in graph.numbers.collect()}
    got = {names[r["k"]]: (names[r["label"]], round(r["s"], 6), r["c"]) for r in graph.members().collect()}
    rounds = [n for c, n in written if c == ("j", "labels")]
    assert len(rounds) == 13 and max(rounds) <= 6 and max(k >> 33 for k in names) > 1

    used = sorted({i for p in edges for i in p})
    node = spark.createDataFrame([(i,) for i in used], "id string")
    moves = {r["id"]: r["m"] for r in node.select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0 for r in range(12)]).alias("m")).collect()}
    beside = defaultdict(list)
    for (a, b), s in edges.items():
        beside[a].append((b, s))
        beside[b].append((a, s))
    label = {i: i for i in used}
    for r in range(12):
        new = dict(label)
        for i in used:
            if moves[i][r]:
                votes = defaultdict(float, {label[i]: 1e-9})
                for o, s in beside[i]:
                    votes[label[o]] += s
                new[i] = min(votes, key=lambda x: (-round(votes[x], 9), x))
        label = new
    same = {i: [s for o, s in beside[i] if label[o] == label[i]] for i in used}
    assert got == {i: (label[i], round(sum(same[i]), 6), len(same[i])) for i in used}
    assert len(set(label.values())) > 1


def test_no_edges_give_no_clusters(spark, monkeypatch):
    none = spark.createDataFrame([], "a string, b string, score double")
    assert knowledge.label_propagation(none).collect() == []
    monkeypatch.setattr(knowledge, "pair_scores", lambda *a, **k: none)
    assert knowledge.memory_clusters(spark, "").collect() == []


def test_a_label_without_inner_edges_is_no_cluster(spark, monkeypatch):
    class Given:
        def __init__(self, edges):
            self.numbers = spark.createDataFrame([(f"n{k}", k) for k in range(6)], "id string, k bigint")

        def members(self):
            return spark.createDataFrame([(0, 0, 1.0, 2), (1, 0, 0.5, 1), (2, 0, 0.5, 1), (3, 3, 0.0, 0), (4, 3, 0.0, 0), (5, 3, 0.0, 0)], "k bigint, label bigint, s double, c bigint")

    monkeypatch.setattr(knowledge, "pair_scores", lambda *a, **k: spark.createDataFrame([("n0", "n1", 0.5)], "a string, b string, score double"))
    monkeypatch.setattr(knowledge, "Graph", Given)
    assert [tuple(r) for r in knowledge.memory_clusters(spark, "").collect()] == [("n0", 3, 0.5, "n0", ["n0", "n1", "n2"])]
