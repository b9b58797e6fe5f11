import datetime

import numpy as np

from palimpsest.operators.upkeep import rerank, reranker_faults
from palimpsest.plans import plugins
from palimpsest.plans.compile import compile_knowledge
from palimpsest.plans.graph_store import GraphStore


def test_batches(spark):
    df = spark.createDataFrame([("a", "Bolt uses Relay. The Relay depends on Core Bus"), ("b", None), (None, "x")], "id string, t string")
    v = {r["id"]: r["embedding"] for r in plugins.embed(df, "id", "t", lambda ts: [[len(t), 1] if t else None for t in ts]).collect()}
    assert v == {"a": [46.0, 1.0], "b": None, None: [1.0, 1.0]}
    facts = [(r["id"], r["place"], r["fact"]) for r in plugins.extract_facts(df, "id", "t", lambda ts: [t.split(". ") if ". " in t else [] for t in ts]).collect()]
    assert ("a", 1, "The Relay depends on Core Bus") in facts and ("b", 0, "") in facts
    assert {tuple(r) for r in plugins.extract_triples(df, "id", "t").collect()} == {("a", "Bolt", "uses", "Relay"), ("a", "Relay", "depends_on", "Core Bus")}
    assert plugins.embed(df.limit(0), "id", "t", lambda ts: []).count() == 0


def test_classifier_is_asked_only_where_patterns_are_silent():
    assert plugins.classify("what happened yesterday", set(), lambda q: "affective").intent == "episodic"
    assert plugins.classify("blue green", set(), lambda q: "abstract").intent == "abstract"
    assert plugins.classify("blue green", set(), lambda q: "nonsense").intent == "factual" and plugins.classify("blue green", set()).intent == "factual"


def test_reranker_contract(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", None)], "id string, content string")
    out = rerank(df, "x", lambda q, t: float(q in t))
    assert reranker_faults(df, out, rerank(df, "x", lambda q, t: float(q in t))) == []
    assert reranker_faults(df, out.filter("id <> 'b'"), out) == ["rows"] and max(r["rerank_score"] for r in out.collect()) > 0.7


def test_compile(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "store"), datetime.datetime(2025, 1, 1))
    ids = [s.add(f"note {i} about the archive", importance=0.5)[0] for i in range(5)]
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    s.store_embeddings(spark.createDataFrame([(k, "m", (base + rng.normal(size=8) * 0.01 if i < 4 else -base).astype(np.float32).tolist()) for i, k in enumerate(ids)], "memory_id string, model string, embedding array<float>"))
    assert compile_knowledge(s, "default", dry_run=True) == {"candidates": 5, "pages": 1, "new": 1, "replaced": 0} and s.topics("default").count() == 0
    assert compile_knowledge(s, "default")["new"] == 1 and s.topics("default").first()["sources"] == sorted(ids[:4])
    assert compile_knowledge(s, "default")["new"] == 0
    s.now = datetime.datetime(2025, 1, 2)
    extra = s.add("note 9 about the archive", importance=0.5)[0]
    s.store_embeddings(spark.createDataFrame([(extra, "m", base.astype(np.float32).tolist())], "memory_id string, model string, embedding array<float>"))
    report = compile_knowledge(s, "default")
    assert report["new"] == 1 and report["replaced"] == 1 and s.topics("default").count() == 1 and s.topics("default", superseded=True).count() == 2
