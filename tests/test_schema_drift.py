import datetime
import json

from palimpsest.operators.schema_drift import consistent_table, schema_changes

S = "producer string, file_no int, file_name string, line_no int, delivered_at timestamp_ntz, record string"
AT = datetime.datetime(2024, 1, 1)


def frame(spark, files):
    rows = [("p", f, f"f{f}", i, AT, r if isinstance(r, str) else json.dumps(r)) for f, lines in files.items() for i, r in enumerate(lines)]
    return spark.createDataFrame(rows + rows[:1], S)


def changes(df):
    return {(r["file_no"], r["field_before"], r["field_after"], r["change_kind"]) for r in schema_changes(df).collect()}


def test_changes(spark):
    files = {
        1: [{"id": "a", "src": "x", "n": 1, "z": None}, {"id": "b", "src": "y", "n": 2}, "{broken"],
        2: [{"id": "a", "source": "x", "n": "1"}, {"id": "b", "source": "y", "n": "2", "new": True}, "[1]"],
        3: [{"id": "a", "other": "q", "n": "1", "new": False}],
        5: [{"id": "a"}],
    }
    assert changes(frame(spark, files)) == {
        (2, "src", "source", "renamed"), (2, "n", "n", "type_changed"), (2, "z", "", "removed"), (2, "", "new", "added"), (3, "source", "", "removed"), (3, "", "other", "added"),
    }


def test_all_null_is_no_rename_and_null_types_do_not_change(spark):
    files = {1: [{"id": "a", "x": None, "t": 1}], 2: [{"id": "a", "y": None, "t": None}], 3: [{"id": "a", "y": 1, "t": 2}]}
    assert changes(frame(spark, files)) == {(2, "x", "", "removed"), (2, "", "y", "added")}


def test_empty_and_unreadable(spark):
    assert schema_changes(spark.createDataFrame([], S)).count() == 0
    assert schema_changes(spark.createDataFrame([("p", 1, "f", 1, AT, None), ("p", 2, "f", 1, AT, "nope")], S)).count() == 0


def test_consistent_table(spark):
    files = {1: [{"id": "a", "sourceFile": {"path": "/x"}, "pinned": 1, "created_at": 1709374272.5, "meta": {"k": 1}, "odd": 3}, {"id": "b", "src_path": ["/y"], "pinned": False, "created_at": "2024-03-02T10:11:12Z", "importance": "0.5"}]}
    got = {r["id"]: r for r in consistent_table(frame(spark, files)).collect()}
    assert got["a"]["source_file"] == "/x" and got["a"]["pinned"] is True and got["a"]["created_us"] == 1709374272500000 and json.loads(got["a"]["other"]) == {"odd": 3}
    assert got["b"]["source_file"] == "/y" and got["b"]["pinned"] is False and got["b"]["created_us"] == 1709374272000000 and got["b"]["importance"] == 0.5


def test_a_rename_that_no_table_knows_lands_in_its_column(spark):
    files = {
        1: [{"id": "a", "source": "x", "meta": "k", "odd": 1}, {"id": "b", "source": "y", "meta": "l", "odd": 2}],
        2: [{"id": "a", "whence": "x", "meta": "k", "odder": 1}, {"id": "b", "whence": "y", "meta": "l", "odder": 2}],
        3: [{"memory_id": "b", "where_from": "y", "meta": "l", "odder": 2}, {"memory_id": "c", "where_from": "z", "meta": "m", "odder": 3}],
    }
    df = frame(spark, files)
    assert (3, "whence", "where_from", "renamed") in changes(df) and (3, "id", "memory_id", "renamed") in changes(df)
    got = {(r["file_no"], r["id"]): r for r in consistent_table(df).collect()}
    assert {k: r["source"] for k, r in got.items()} == {(1, "a"): "x", (1, "b"): "y", (2, "a"): "x", (2, "b"): "y", (3, "b"): "y", (3, "c"): "z"}
    assert json.loads(got[3, "c"]["other"]) == {"odder": 3} and json.loads(got[1, "a"]["other"]) == {"odd": 1}
    # of another producer the same names mean nothing
    alone = spark.createDataFrame([("q", 1, "f", 1, AT, json.dumps({"id": "d", "whence": "w"}))], S)
    rows = {r["id"]: r for r in consistent_table(df.unionByName(alone)).collect()}
    assert rows["d"]["source"] is None and json.loads(rows["d"]["other"]) == {"whence": "w"}
