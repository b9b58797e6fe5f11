import datetime

import pytest

from palimpsest.operators.timestamps import normalise_timestamps

UTC = datetime.timezone.utc
SCHEMA = "source_table string, record_id string, text string, namespace string, loaded_at timestamp_ntz"
NS = [("berlin", "Europe/Berlin", "dmy"), ("ny", "America/New_York", "mdy"), ("default", "UTC", "mdy"), ("open", "UTC", None), ("odd", "Not/AZone", "dmy"), ("sp", "America/Sao_Paulo", "dmy"), ("ktm", "Asia/Kathmandu", "dmy")]


def us(*a):
    return int(datetime.datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000


CASES = [
    ("2024-03-01T12:00:00.123456Z", "berlin", us(2024, 3, 1, 12) + 123456),
    ("  2024-03-01t12:00:00.5z ", "berlin", us(2024, 3, 1, 12) + 500000),
    ("2024-03-01 12:00:00", "berlin", us(2024, 3, 1, 11)),
    ("2024-07-01 12:00", "berlin", us(2024, 7, 1, 10)),
    ("2024-07-01 12:00", "odd", us(2024, 7, 1, 12)),
    ("2024-07-01 12:00", "nowhere", us(2024, 7, 1, 12)),
    ("2024-07-01", "ny", us(2024, 7, 1, 4)),
    ("2024-07-01 12:00", "sp", us(2024, 7, 1, 15)),  # zones whose abbreviations are no letters
    ("01/07/2018 12:00", "sp", us(2018, 7, 1, 15)),
    ("2018-12-01 12:00", "sp", us(2018, 12, 1, 14)),
    ("2024-07-01 12:00:00", "ktm", us(2024, 7, 1, 6, 15)),
    ("2024-07-01T12:00:00[Asia/Kathmandu]", "ny", us(2024, 7, 1, 6, 15)),
    ("2024-07-01 12:00:00 [America/Sao_Paulo]", "ktm", us(2024, 7, 1, 15)),
    ("2024-10-27 02:30:00", "berlin", us(2024, 10, 27, 0, 30)),  # twice: the first
    ("2024-03-31 02:30:00", "berlin", us(2024, 3, 31, 1, 30)),  # skipped: moves on
    ("2024-11-03 01:30:00 EST", "ny", us(2024, 11, 3, 6, 30)),
    ("2024-11-03 01:30:00 EDT", "ny", us(2024, 11, 3, 5, 30)),
    ("02/03/2024 10:00:00", "berlin", us(2024, 3, 2, 9)),
    ("02/03/2024 10:00:00", "ny", us(2024, 2, 3, 15)),
    ("13/02/2024 10:00:00", "ny", None),  # against the declared order
    ("02.03.2024 10:00", "ny", us(2024, 3, 2, 15)),
    ("20240302T101112Z", "ny", us(2024, 3, 2, 10, 11, 12)),
    ("1709374272", "ny", us(2024, 3, 2, 10, 11, 12)),
    ("1709374272.25", "ny", us(2024, 3, 2, 10, 11, 12) + 250000),
    ("1709374272123", "ny", us(2024, 3, 2, 10, 11, 12) + 123000),
    ("1709374272123456", "ny", us(2024, 3, 2, 10, 11, 12) + 123456),
    ("1709374272123456789", "ny", us(2024, 3, 2, 10, 11, 12) + 123456),
    ("2024-03-02T10:11:12.123456789Z", "ny", us(2024, 3, 2, 10, 11, 12) + 123456),
    ("2024/03/02 10:11:12 UTC+08:00", "ny", us(2024, 3, 2, 2, 11, 12)),
    ("2024-03-02 10:11:12 -0530", "ny", us(2024, 3, 2, 15, 41, 12)),
    ("2024-03-02T10:11:12+01:00[Europe/Berlin]", "ny", us(2024, 3, 2, 9, 11, 12)),
    ("Sat, 02 Mar 2024 10:11:12 +0000", "ny", us(2024, 3, 2, 10, 11, 12)),
    ("Mar 2, 2024 12:11:12 AM", "default", us(2024, 3, 2, 0, 11, 12)),
    ("Mar 2, 2024 12:11:12 PM", None, us(2024, 3, 2, 12, 11, 12)),
    ("2024年3月2日 10:11:12", "default", us(2024, 3, 2, 10, 11, 12)),
    ("2024-02-30 10:15:00", "default", None),
    ("2024-06-11 25:61:00", "default", None),
    ("2024-06-11 10:00:60", "default", None),
    ("0000-00-00 00:00:00", "default", None),
    ("yesterday", "default", None),
    ("", "default", None),
    (" ", "default", None),
    (None, "default", None),
    ("x" * 200_000, "default", None),
]


def test_forms(spark):
    at = datetime.datetime(2024, 5, 1)
    rows = [("t", str(i), t, n, at) for i, (t, n, _) in enumerate(CASES)]
    out = normalise_timestamps(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(NS, "namespace string, home_zone string, date_order string"))
    got = {r["record_id"]: r["utc_us"] for r in out.collect()}
    for i, (t, n, want) in enumerate(CASES):
        assert got[str(i)] == want, (t and t[:40], n, got[str(i)], want)


def test_mixture_decides_and_marks_ambiguity(spark):
    at = datetime.datetime(2024, 5, 1)
    sure = [("a", str(i), f"{i % 12 + 13}/0{i % 9 + 1}/2024 00:00:00", "open", at) for i in range(40)]
    rows = sure + [("a", "x", "03/04/2024 00:00:00", "open", at), ("b", "y", "03/04/2024 00:00:00", "open", at), ("b", "z", "03/03/2024 00:00:00", "open", at)]
    out = normalise_timestamps(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(NS, "namespace string, home_zone string, date_order string"))
    got = {r["record_id"]: (r["status"], r["utc_us"]) for r in out.collect()}
    assert got["x"] == ("resolved", us(2024, 4, 3))
    assert got["y"] == ("ambiguous", None)
    assert got["z"] == ("resolved", us(2024, 3, 3))  # both readings are the same instant


def test_repeats_extra_columns_and_empty(spark):
    rows = [("t", "1", "2024-01-01", "default", datetime.datetime(2024, 1, 2)), ("t", "1", "2024-02-02", "default", datetime.datetime(2024, 1, 1))]
    names = spark.createDataFrame(NS, "namespace string, home_zone string, date_order string")
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as fmt", "2 as _t", "3 as utc_us")
    out = normalise_timestamps(df, names).collect()
    assert [r["utc_us"] for r in out] == [us(2024, 2, 2)]
    assert normalise_timestamps(spark.createDataFrame([], SCHEMA), names).count() == 0


@pytest.mark.parametrize("name", ["p1_found"])
def test_runs(spark, data, name):
    from palimpsest.operators import timestamps

    df = timestamps.p1_found(spark, data)
    assert df.columns == ["source_table", "record_id", "utc_us"] and df.count() > 100
