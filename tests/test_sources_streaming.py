import datetime
import json
import os
import time

from palimpsest.plans import dispatch
from palimpsest.sources import files
from palimpsest.streaming import state

T0 = datetime.datetime(2024, 1, 1)


def test_markdown(spark, tmp_path):
    (tmp_path / "n.md").write_text("# Work\n- I **prefer** tea!\n\nplain because of it\n## Home\n1. call\n", encoding="utf-8")
    rows = {r["content"]: r for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert rows["I **prefer** tea!"]["section"] == "Work" and rows["I **prefer** tea!"]["memory_type"] == "opinion" and rows["I **prefer** tea!"]["importance"] == 0.8
    assert rows["plain because of it"]["memory_type"] == "causal" and rows["call"]["section"] == "Home"


def test_html(spark):
    df = spark.createDataFrame([("<p>A &amp; B</p><script>x</script><div>c<br>d</div>",), (None,)], "h string")
    assert [r[0] for r in df.select(files.html_text(df["h"])).collect()] == ["A & B\nc\nd", None]


def test_transcript(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\n".join(f"u{i}: line {i}" for i in range(6)))
    rows = files.read_transcript(spark, str(tmp_path)).orderBy("turn").collect()
    assert rows[5]["context"] == ["line 1", "line 2", "line 3", "line 4"] and rows[0]["speaker"] == "u0"


def test_json_round_trip_and_pages(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", None), ("2", "b", "n")], "id string, content string, namespace string")
    files.export_json(df, str(tmp_path / "out"))
    back = files.import_json(spark, str(tmp_path / "out"), "id string, content string, namespace string")
    assert {(r["id"], r["namespace"]) for r in back.collect()} == {("1", "default"), ("2", "n")}
    pages = files.topic_pages(spark.createDataFrame([("t", "x", T0), ("t", "y", T0)], "topic string, content string, created timestamp_ntz")).collect()
    assert pages[0]["page"] == "# t\n\n- x\n- y\n" and pages[0]["n_memories"] == 2


def test_upsert(spark):
    s = "id string, v int, loaded_at timestamp_ntz"
    old = spark.createDataFrame([("a", 1, T0), ("b", 1, T0)], s)
    new = spark.createDataFrame([("b", 2, T0), ("b", 3, T0 + datetime.timedelta(1)), ("c", 4, T0)], s)
    assert {(r["id"], r["v"]) for r in files.upsert(old, new, "id").collect()} == {("a", 1), ("b", 3), ("c", 4)}


def run_stream(spark, tmp_path, schema, batches, build, mode):
    src, name = tmp_path / "in", f"q{time.time_ns()}"
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_domain_state(spark, tmp_path):
    rows = run_stream(spark, tmp_path, "domain string, valence double, arousal double, ts timestamp", [[{"domain": "a", "valence": 1.0, "arousal": 0.5, "ts": "2024-01-01T00:00:00Z"}], [{"domain": "a", "valence": 5.0, "arousal": None, "ts": "2024-01-01T00:01:00Z"}, {"domain": "a", "valence": None, "ts": "2024-01-01T00:02:00Z"}]], state.domain_state, "update")
    best = max(rows, key=lambda r: r["n"])
    assert best["n"] == 2 and abs(best["valence"] - 0.51) < 1e-9


def test_working_memory(spark, tmp_path):
    one = [{"session": "s", "memory_id": f"m{i}", "ts": f"2024-01-01T00:00:{i:02d}Z"} for i in range(9)]
    rows = run_stream(spark, tmp_path, "session string, memory_id string, ts timestamp", [one, [{"session": "s", "memory_id": "z", "ts": "2024-01-01T01:00:00Z"}]], state.working_memory, "update")
    assert sorted(map(tuple, (r["memory_ids"] for r in rows)), key=len) == [("z",), ("m8", "m7", "m6", "m5", "m4", "m3", "m2")]


def test_stream_joins(spark, tmp_path):
    subs = spark.createDataFrame([("g", "*", 0.5)], "agent_id string, namespace string, min_importance double")
    rows = run_stream(spark, tmp_path, "id string, namespace string, importance double", [[{"id": "1", "importance": 0.9}, {"id": "2", "importance": 0.1}]], lambda s: state.notify(s, subs), "append")
    assert [(r["agent_id"], r["id"]) for r in rows] == [("g", "1")]
    (tmp_path / "b").mkdir()
    acc = [{"memory_id": "x", "ts": "2024-01-01T00:00:00Z"}, {"memory_id": "y", "ts": "2024-01-01T00:00:20Z"}, {"memory_id": "z", "ts": "2024-01-01T00:05:00Z"}]
    rows = run_stream(spark, tmp_path / "b", "memory_id string, ts timestamp", [acc], state.co_recall, "append")
    assert [(r["a"], r["b"]) for r in rows] == [("x", "y")]


def test_dispatch(spark):
    assert dispatch.route("what did Ann do", {"Ann"}).intent == "factual"
    assert dispatch.route("what happened yesterday", set()).intent == "episodic"
    p = dispatch.route("why was Ann sad yesterday", {"Ann"})
    assert p.intent == "hybrid" and len(p.parts) == 2 and len(p.dropped) == 1
    df = spark.createDataFrame([("1", 0.5)], "id string, score double")
    out, how = dispatch.execute(dispatch.Plan("episodic", ["episodic"], [], "factual"), {"episodic": lambda: df.limit(0), "factual": lambda: df})
    assert how == "downgraded_from_episodic" and out.count() == 1
