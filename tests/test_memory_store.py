import datetime

import pytest

from palimpsest.plans.memory_store import MemoryStore

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    return MemoryStore(spark, str(tmp_path / "store"), T0)


def later(store, **kw):
    store.now += datetime.timedelta(**(kw or {"minutes": 1}))


def test_write_and_recall(store):
    (a,) = store.add("the queue retries at night", "procedural", source="x")
    later(store)
    (b,) = store.add("the archive is cold", namespace="n")
    later(store)
    assert store.store_raw(" ") == "skipped" and store.store_raw("the archive is cold", namespace="n") == "skipped" and store.store_raw("x" * 1_000_001) == "quarantined" and store.store_raw("fresh fact") == "stored"
    assert [r["id"] for r in store.recall("queue at night").collect()] == [a]
    assert store.recall("", limit=3).count() == 0 and store.recall_text("archive", "other").count() == 0
    assert store.retry_quarantined(lambda t: False) == {"stored": 0, "left": 1}
    assert [r["id"] for r in store.recent("n", 5).collect()] == [b]
    assert {(r["namespace"], r["n"]) for r in store.stats().groupBy("namespace").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {("default", 2), ("n", 1)}


def test_change_and_forget(store):
    (a,) = store.add("old fact", importance=0.4)
    later(store)
    b = store.correct(a, "new fact")
    assert [r["id"] for r in store.live().collect()] == [b] and store.table("memories").filter(f"id = '{a}'").first()["superseded_by"] == b
    store.unsupersede(a)
    assert store.live().count() == 2
    assert store.pin(a) == 1 and store.downscale() == 1
    assert store.forget(a) == 1 and store.live().count() == 1
    later(store, days=31)
    assert store.purge() == 1 and store.table("memories").count() == 1
    with pytest.raises(KeyError):
        store.correct("nope", "x")
    store.compact("memories")
    assert store.versions("memories").count() == 1 and store.live().first()["content"] == "new fact"


def test_links_reward_and_consolidation(store):
    a, b = store.add("one")[0], store.add("two")[0]
    for _ in range(4):
        later(store)
        store.access([a, b])
    row = store.table("links").first()
    assert row["coactivation_count"] == 4 and row["strength"] == 1.0
    assert store.consolidate() == 2
    w = store.table("memories").filter(f"id = '{a}'").first()
    assert w["working_strength"] < 1 and w["core_strength"] > 0
    assert store.reward("that was wrong") == 2
    assert store.table("memories").filter(f"id = '{a}'").first()["working_strength"] == pytest.approx(w["working_strength"] - 0.15)
    i = store.record_insight("both", [a, b])
    assert store.undo_insight(i) == 2
    assert store.forget(a, soft=False) == 1 and store.table("links").count() == 0


def test_rights_and_notifications(store):
    store.grant("g", "n", "write")
    store.grant("h", "*", "read")
    assert store.may("g", "n", "read") and not store.may("g", "n", "admin") and not store.may("g", "m", "read") and store.may("h", "m", "read") and not store.may("h", "m", "write")
    store.subscribe("g", "*", 0.5)
    store.add("big", importance=0.9)
    store.add("small", importance=0.1)
    assert [r["content"] for r in store.notifications("g").collect()] == ["big"]
    assert store.notifications("g").count() == 0
    later(store)
    store.add("bigger", importance=0.9)
    assert store.notifications("g", advance=False).count() == 1
    store.unsubscribe("g")
    assert store.notifications("g").count() == 0
    for _ in range(10):
        store.feel("work", -3.0)
    r = store.trends().first()
    assert r["valence"] == -1.0 and r["needs_update"]


def test_bulk_and_export(spark, store, tmp_path):
    df = spark.createDataFrame([("a", None, None, None), (" ", None, None, None), (None, None, None, None), ("b", "causal", "n", T0), ("b", "causal", "n", T0)], "content string, memory_type string, namespace string, event_time timestamp_ntz")
    store.add_all(df)
    assert {(r["content"], r["importance"]) for r in store.live().collect()} == {("a", 0.3), ("b", 0.7)}
    store.export(str(tmp_path / "out"), "n")
    assert spark.read.json(str(tmp_path / "out")).count() == 1
