import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.plans.graph_store import GraphStore

NOW = datetime.datetime(2025, 1, 1)


@pytest.fixture
def s(spark, tmp_path):
    return GraphStore(spark, str(tmp_path / "store"), NOW)


def test_entities_and_edges(spark, s):
    s.upsert_entities(spark.createDataFrame([("e1", "Ann", "person", "d"), ("e2", "Anne", "person", "d"), ("e3", "Bolt", "project", "d")], "id string, name string, kind string, namespace string"))
    s.upsert_aliases(spark.createDataFrame([(" Annie ", "d", "e2")], "alias string, namespace string, entity_id string"))
    s.link_memory_entities(spark.createDataFrame([("m1", "e1", None), ("m1", "e2", "x"), ("m2", "e2", None)], "memory_id string, entity_id string, role string"))
    edge = "id string, subject string, predicate string, object string, confidence double, memory_id string, episode string"
    rows = spark.createDataFrame([("x1", "e2", "uses", "e3", 0.9, "m1", "ep"), ("x2", "e3", "uses", "e2", 0.9, "m2", "ep")], edge)
    assert s.apply_delta("m1", rows) and not s.apply_delta("m1", rows) and s.table("edges").count() == 2
    assert s.merge_entities(spark.createDataFrame([("e2", "e1"), ("e1", "e1")], "loser string, winner string")) == 1
    assert {(r["subject"], r["object"]) for r in s.table("edges").collect()} == {("e1", "e3"), ("e3", "e1")}
    assert {(r["memory_id"], r["entity_id"]) for r in s.table("mentions").collect()} == {("m1", "e1"), ("m2", "e1")}
    assert [r["entity_id"] for r in s.table("aliases").collect()] == ["e1"] and s.table("entities").filter("merged_into = 'e1'").count() == 1
    assert s.edges_of_memory("m1").count() == 1 and {r["id"] for r in s.in_episode("ep")[0].collect()} == {"e1", "e3"}
    assert s.invalidate_edge("x1") == 1 and s.invalidate_edge("x1") == 0
    assert s.supersede_edge("x2", spark.createDataFrame([("x3", "e3", "uses", "e1", 0.5, None, None)], edge)) == 1
    assert s.table("edges").filter("invalidated_at is null").count() == 1 and s.touch_entity("e3") == 1
    assert s.delete_entity("e1") == 1 and s.table("mentions").count() == 0 and s.table("edges").filter("invalidated_at is null").count() == 0


def test_derived_tables(spark, s):
    ids = s.add("first text"), s.add("second text")
    a, b = ids[0][0], ids[1][0]
    s.store_embeddings(spark.createDataFrame([(a, "m", [1.0, 2.0])], "memory_id string, model string, embedding array<float>"))
    s.store_triples(spark.createDataFrame([(a, "x", "is", "y")] * 2, "memory_id string, subject string, predicate string, object string"))
    assert s.triples(a).count() == 1 and [r["id"] for r in s.unenriched().collect()] == [b]
    for _ in range(3):
        s.tried(spark.createDataFrame([(b,)], "id string"))
    assert s.unenriched().count() == 0
    keys = spark.createDataFrame([(a,), (b,), (a,)], "id string")
    assert s.enqueue_backfill(keys) == 2 and s.enqueue_backfill(keys) == 0
    s.finish_backfill(spark.createDataFrame([(a,)], "id string"))
    assert [r["memory_id"] for r in s.backfill_batch().collect()] == [b]
    s.replace_clusters(spark.createDataFrame([(a, "c1"), ("gone", "c2")], "memory_id string, cluster string"))
    s.assign(spark.createDataFrame([(b, "c1"), ("p", None)], "memory_id string, cluster string"))
    assert [r["cluster"] for r in s.dirty_clusters().collect()] == ["c1"] and s.cluster_members("c1").count() == 2 and s.pending().count() == 1 and s.stale_clusters() == 1
    s.replace_clusters(spark.createDataFrame([(a, "c9")], "memory_id string, cluster string"))
    assert s.dirty_clusters().count() == 0 and s.pending().count() == 0
    assert s.promote("p1", [b, a]) and not s.promote("p2", [a, b]) and s.resolve_promotion("p1", "done") == 1 and s.pending_promotions().count() == 0
    insight = s.record_insight("both", [a])
    assert s.covered(keys) == 0.5 and [r[0] for r in s.insights_of(a).collect()] == [insight]
    s.upsert_topics(spark.createDataFrame([("t1", "T", "d", [b, a]), ("t2", "U", "d", [a])], "id string, title string, namespace string, sources array<string>"))
    assert s.supersede_topic("t1", "t2") == 1 and s.topics("d").count() == 1 and s.topics("d", superseded=True).count() == 2
    s.begin_run("r1", a)
    assert s.run_state(a) == "running" and s.finish_run("r1", False) == 1 and s.run_state(a) == "failed" and s.run_state("?") == "none"
    s.record_failure("f1", "ep1", "bad")
    assert s.failed_episodes().count() == 1 and s.resolve_failure("f1") == 1 and s.failed_episodes().count() == 0
    assert s.forget(a, soft=False) == 1
    assert s.table("embeddings").count() == 0 and s.triples(a).count() == 0 and s.versions("memories").filter(F.col("id") == a).count() == 0 and s.table("provenance").count() == 0


def test_store_survives_a_stopped_fold(spark, s, tmp_path):
    s.add("one"), s.add("two")
    (tmp_path / "store/memories").rename(tmp_path / "store/memories.old")
    assert s.table("memories").count() == 2
    s.compact("memories")
    assert s.versions("memories").count() == 2 and s.namespaces() == ["default"]


def test_reconcile(spark, s):
    s.add("a", importance=0.9), s.add("b", importance=0.2), s.add("c", importance=0.1)
    ids = {r["content"]: r["id"] for r in s.live().collect()}
    pairs = spark.createDataFrame([(ids["a"], ids["b"]), (ids["b"], ids["c"])], "a string, b string")
    assert s.reconcile(pairs) == {"found": 2, "merged": 0, "would_merge": 1}
    assert s.reconcile(pairs, dry_run=False)["merged"] == 1
    assert {r["content"] for r in s.live().collect()} == {"a", "c"}
    assert s.count_quarantine() == 0 and s.purge_quarantine() == 0
