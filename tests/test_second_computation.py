"""Queries that SQL cannot express against a second computation in Python."""

import datetime
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph, knowledge, lifecycle, retrieval, text
from palimpsest.operators.feedback import nearest_ranks
from palimpsest.operators.vector_join import cosine_join
from palimpsest.plans import dispatch


@pytest.mark.parametrize("one_way", [[(8, 9)], []])
def test_pagerank_to_its_limit(spark, one_way):
    edges = [(a, b) for a, b in [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7)] for a, b in ((a, b), (b, a))] + one_way
    got = {r["id"]: r["score"] for r in graph.personalized_pagerank(spark.createDataFrame(edges, "x int, y int"), spark.createDataFrame([(1,), (9,), (10,)], "id int")).collect()}
    nodes = sorted({n for e in edges for n in e} | {9, 10})
    seed = {n: (1 / 3 if n in (1, 9, 10) else 0.0) for n in nodes}
    rank = dict(seed)
    for _ in range(400):
        new = {n: 0.15 * seed[n] for n in nodes}
        for n in nodes:
            out = [b for a, b in edges if a == n]
            for b in out:
                new[b] += 0.85 * rank[n] / len(out)
            if not out:
                for k in nodes:
                    new[k] += 0.85 * rank[n] * seed[k]
        rank = new
    assert all(abs(got.get(n, 0.0) - rank[n]) < 1e-4 for n in nodes) and abs(sum(got.values()) - 1) < 1e-6


def test_cosine_join(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 8))[rng.integers(0, 6, 400)] * 2 + rng.normal(size=(400, 8)) * 0.7
    x[:150] = x[0] + rng.normal(size=(150, 8)) * 1e-3
    x = x.astype(np.float32)
    rows = [(f"k{i:03d}", v.tolist(), "a" if i % 3 else "b") for i, v in enumerate(x)] + [("nul", None, "a"), ("zero", [0.0] * 8, "a"), ("nan", [float("nan")] * 8, "a"), (None, x[0].tolist(), "a")]
    df = spark.createDataFrame(rows, "id string, v array<float>, ns string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sim = u @ u.T
    want = {(f"k{i:03d}", f"k{j:03d}") for i in range(400) for j in range(i + 1, 400) if sim[i, j] >= 0.9}
    got = [(r["a"], r["b"]) for r in cosine_join(df, 0.9, pivots=16, block=40).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = {(r["a"], r["b"]) for r in cosine_join(df, 0.9, within=("ns",)).collect()}
    assert got == {(a, b) for a, b in want if (int(a[1:]) % 3 > 0) == (int(b[1:]) % 3 > 0)}
    assert cosine_join(df.limit(0), 0.9).count() == 0 and cosine_join(df.filter("id = 'k001'"), 0.9).count() == 0


def ground(content, day):
    def one(m):
        p = re.sub(r"\s+", " ", m[0].lower())
        step = {"last": -1, "next": 1}.get(p.split()[0], 0)
        monday, n = day - datetime.timedelta(day.weekday()), int(p.split()[0]) if p[0].isdigit() else 0
        month = day.year * 12 + day.month - 1 + step
        at = (
            day + datetime.timedelta({"yesterday": -1, "today": 0, "tomorrow": 1}[p]) if p in ("yesterday", "today", "tomorrow")
            else monday + datetime.timedelta(7 * step) if p.endswith("week") and not n and "ago" not in p
            else datetime.date(month // 12, month % 12 + 1, 1) if p.endswith("month")
            else datetime.date(day.year + step, 1, 1) if p.endswith("year")
            else day - datetime.timedelta(n * (7 if "week" in p else 1))
        )
        return f"{m[0]} ({at})"

    return re.sub("(?i)" + text.GROUNDED + r"(?! \(\d{4}-\d{2}-\d{2}\))", one, content)


def test_grounded_phrases(spark, data):
    day = datetime.date(2024, 3, 15)
    texts = [
        "seen yesterday and Today, not tomorrow", "last week, this  week and next week", "Last month or next year; this year", "3 days ago and 13 days ago, 2 weeks ago", "yesterday (2024-03-14) stays, yesterday does not",
        "owned for 3 years ago", "nothing", "", "1 day ago, 11 days ago", "todays, yesterdays",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.grounded(F.col("t"), F.lit(day)).alias("g"))
    assert {r["t"]: r["g"] for r in df.collect()} == {t: ground(t, day) for t in texts}
    import hashlib

    m = {r["id"]: r for r in text.store.memories(spark, data, "content").filter("content is not null").collect()}
    got = {r["id"]: r["grounded"] for r in text.ground_dates(spark, data).collect()}
    assert got == {k: hashlib.sha256(ground(r["content"], r["event_time"].date()).encode()).hexdigest() for k, r in m.items()}


def test_replay_takes_exactly_its_share(spark):
    rows = [(f"m{i:04d}", "archive" if i % 4 else "core", 0.05, 0.06, 0.5, False, 0) for i in range(1000)]
    m = spark.createDataFrame(rows, "id string, layer string, working_strength double, core_strength double, importance double, pinned boolean, consolidation_count int")
    out = lifecycle.consolidate(m).toPandas()
    assert len(out) == 1000 and int(out["consolidation_count"].sum()) == math.ceil(0.3 * 750)
    assert lifecycle.consolidate(m.limit(0)).count() == 0


def test_nearest_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.exponential(size=999)] + [("b", 2.0)] * 7 + [("c", None), ("c", 5.0)]
    got = {(r["k"], r["p"]): r["v"] for r in nearest_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", (0.0, 0.5, 0.95, 1.0), cells=16).collect()}
    for k in "abc":
        v = sorted(x for n, x in rows if n == k and x is not None)
        for p in (0.0, 0.5, 0.95, 1.0):
            assert got[k, p] == v[math.floor(p * (len(v) - 1) + 0.5)]


def test_greedy_dedup_and_mmr(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(5, 6))
    rows = [(f"r{i}", i + 1, 1 - i / 20, None if i == 3 else (base[i % 5] + rng.normal(size=6) * 0.05).astype(np.float32).tolist()) for i in range(15)]
    df = spark.createDataFrame(rows, "id string, rank int, score double, v array<float>")
    unit = {r[0]: None if r[3] is None else np.array(r[3]) / np.linalg.norm(r[3]) for r in rows}
    kept = []
    for i, _, _, v in rows:
        if len(kept) < 6 and (v is None or all(unit[k] is None or float(unit[i] @ unit[k]) <= 0.85 for k in kept)):
            kept.append(i)
    assert {r["id"] for r in retrieval.greedy_dedup(df, 0.85, 6).collect()} == set(kept)
    chosen, left = [], [r[0] for r in rows]
    score = {r[0]: r[2] for r in rows}
    while len(chosen) < 6:
        worth = {i: 0.7 * score[i] - 0.3 * max([0.0] + [float(unit[i] @ unit[j]) for j in chosen if unit[i] is not None and unit[j] is not None]) for i in left}
        best = max(left, key=lambda i: worth[i])
        chosen.append(best)
        left.remove(best)
    assert [r["id"] for r in sorted(retrieval.mmr(df, 0.7, 6).collect(), key=lambda r: r["place"])] == chosen


def test_jaro_winkler():
    for a, b, want in (("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.8133), ("", "a", 0.0), ("same", "same", 1.0), ("abc", "xyz", 0.0)):
        assert abs(graph.jaro_winkler(a, b) - want) < 1e-4


def test_label_propagation(spark):
    e = [(f"a{i}", f"a{j}", 1.0) for i in range(4) for j in range(i)] + [(f"b{i}", f"b{j}", 1.0) for i in range(4) for j in range(i)] + [("a0", "b0", 0.1)]
    lab = {r["id"]: r["label"] for r in knowledge.label_propagation(spark.createDataFrame(e, "a string, b string, score double")).collect()}
    assert len({lab[f"a{i}"] for i in range(4)}) == 1 and len({lab[f"b{i}"] for i in range(4)}) == 1 and lab["a0"] != lab["b0"]


def test_large_communities_keep_their_closest_members(spark, monkeypatch):
    e = spark.createDataFrame([(f"m{i:02d}", f"m{j:02d}", 1.0) for j in range(20) for i in range(j)], "a string, b string, score double")
    monkeypatch.setattr(knowledge, "pair_scores", lambda *a, **k: e)
    r = knowledge.memory_clusters(spark, "").collect()
    assert len(r) == 1 and r[0]["n"] == 20 and len(r[0]["kept"]) == 15


def test_fallbacks():
    assert dispatch.route("how do I feel", set()).fallback == "associative" and dispatch.route("what happened yesterday", set()).fallback == "associative"
    assert dispatch.route("what did Bob feel yesterday", {"Bob"}).fallback == "factual"


@pytest.fixture(scope="module")
def recall_inputs(spark, data):
    scores = retrieval.recall_scores(spark, data).select("id", "score").toPandas()
    vectors = {r[0]: np.array(r[1], float) for r in retrieval.usable(spark, data).collect()}
    return scores.sort_values(["score", "id"], ascending=[False, True]).head(30), vectors


def test_recall_top10(spark, data, recall_inputs):
    rows, vectors = recall_inputs
    kept = []
    for i in rows["id"]:
        v = vectors.get(i)
        far = all(vectors.get(k) is None or float(v @ vectors[k]) / (np.linalg.norm(v) * np.linalg.norm(vectors[k])) <= 0.85 for k in kept) if v is not None else True
        if far and len(kept) < 10:
            kept.append(i)
    assert {r["id"] for r in retrieval.recall_top10(spark, data).collect()} == set(kept)


def test_duplicate_topics(spark, data):
    top = knowledge.topic_overlap(spark, data).filter("overlap >= 0.2").toPandas()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in zip(top["topic"], top["other"]):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {(r["topic"], r["keep"]) for r in knowledge.duplicate_topics(spark, data).collect()} == {(t, find(t)) for t in list(parent)}


def test_recall_answers(spark, data):
    """The best 30 candidates of the question, thinned in order."""
    from palimpsest.operators import recall

    rows = recall.recall_question(spark, data).toPandas().sort_values(["score", "id"], ascending=[False, True])
    vectors = {r[0]: np.array(r[1], float) for r in retrieval.usable(spark, data).collect()}
    kept = []
    for i in rows["id"]:
        v = vectors.get(i)
        if len(kept) < 10 and (v is None or all(vectors.get(k) is None or float(v @ vectors[k]) / (np.linalg.norm(v) * np.linalg.norm(vectors[k])) <= 0.85 for k in kept)):
            kept.append(i)
    assert {r["id"] for r in recall.recall_answers(spark, data).collect()} == set(kept)
    # silent channels, an empty question and a namespace
    assert recall.recall(spark, data, "").count() == 0
    some = recall.recall_scored(spark, data, "retry queue", namespace="atlas").toPandas()
    assert set(some["emb"]) <= {0.0} and set(some["somatic"]) <= {0.0}
    m = recall.update_marker(recall.Marker(-0.5, 1), spark.createDataFrame([("emotional", 0.5), ("factual", 0.9)], "memory_type string, importance double"))
    assert m == recall.Marker(0.0, 2)


def test_windows_in_chunks(spark):
    """Chunks of few rows give what one window over a key's whole history gives."""
    from pyspark.sql import Window as W

    from palimpsest.operators.feedback import in_chunks

    rng = np.random.default_rng(9)
    at = datetime.datetime(2025, 1, 1)
    rows = [("ab"[int(rng.integers(0, 2))] if i % 50 else None, at + datetime.timedelta(hours=float(rng.exponential(40)) if i % 3 else 5), i, float(rng.normal())) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, v double")
    w = W.partitionBy("k").orderBy("ts", "id").rowsBetween(-7, -1)
    want = {r["id"]: r["x"] for r in df.select("id", F.collect_list("id").over(w).alias("x")).collect()}
    w = W.partitionBy("k", "_chunk").orderBy("ts", "id").rowsBetween(-7, -1)
    x = in_chunks(df, "k", ("ts", "id"), 7, rows=20)
    got = {r["id"]: r["x"] for r in x.select("id", "_own", F.collect_list("id").over(w).alias("x")).filter("_own").collect()}
    assert got == want and x.filter("_own").count() == 700
