"""Mixed timestamp formats and zones, normalised to one UTC instant.

Every text gets all its *valid parses* (format, instant) by JVM-side regular
expressions. A source (table and namespace) is a mixture over formats whose
weights are fitted by expectation-maximisation on the counts of parse
signatures, so the data that reach Python are one row for each source and
signature, whatever the number of values. The posterior chooses between the
parses; where it stays below ``min_posterior`` the value is ``ambiguous``.

A declared date order of the namespace is the prior of its mixture: it carries
``declared_weight`` pseudo-counts, and a parse against it is a contradiction,
never a result.

Defined results (column ``status``): ``resolved`` with ``utc_us``;
``ambiguous`` with ``utc_us`` null; ``unreadable`` for null, blank, words and
impossible dates or times. Repeated keys keep the row with the earliest
``loaded_at`` (ties: the smallest text). Extra columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

import datetime
import zoneinfo
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.common import checkpoint, ns

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Epoch units with the range of numbers read as that unit: instants from 1971 to 2199, seconds from 0.
EPOCH_UNITS = {"epoch_s": (1, 0.0), "epoch_ms": (10**3, 3.15e7), "epoch_us": (10**6, 3.15e7), "epoch_ns": (10**9, 3.15e7)}
EPOCH_END = 7.23e9
ZONE = r"(Z|z|(?:(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)|[A-Za-z]{2,5})?\s*(?:\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
TIME = r"^[Tt,\s]*(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?\s*([AaPp][Mm])?\s*" + ZONE + "$"
#: Date forms: name, expression, groups of year, month, day.
DATE_FORMS = [
    ("ymd", r"^(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)", 1, 2, 3),
    ("ymd_slash", r"^(\d{4})/(\d{1,2})/(\d{1,2})(?!\d)", 1, 2, 3),
    ("cjk", r"^(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日", 1, 2, 3),
    ("slash_dmy", r"^(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)", 3, 2, 1),
    ("slash_mdy", r"^(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)", 3, 1, 2),
    ("dots", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?!\d)", 3, 2, 1),
    ("month_first", r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})(?!\d)", 3, 1, 2),
    ("rfc", r"^(?:[A-Za-z]{3,9},? )?(\d{1,2}) ([A-Za-z]{3})[a-z]*\.? (\d{4})(?!\d)", 3, 2, 1),
]


@lru_cache(maxsize=1)
def _zones() -> list[str]:
    """All names of the public zone database, whether or not their abbreviations are letters."""
    return sorted(zoneinfo.available_timezones() | {"UTC", "GMT"})


@lru_cache(maxsize=1)
def _abbreviations() -> list[tuple[str, str, int]]:
    """(zone, abbreviation, offset in seconds), from the public zone database: a few thousand rows at most."""
    out = set()
    for name in zoneinfo.available_timezones():
        z = zoneinfo.ZoneInfo(name)
        for year in range(1972, 2038, 3):
            for month in (1, 7):
                at = datetime.datetime(year, month, 1, tzinfo=z)
                if (at.tzname() or "").isalpha():
                    out.add((name, at.tzname().upper(), int(at.utcoffset().total_seconds()), -year))
    # a name that changed its meaning keeps the newest one
    best: dict[tuple[str, str], tuple[int, int]] = {}
    for name, abbr, off, age in out:
        best[name, abbr] = min(best.get((name, abbr), (1, 0)), (age, off))
    return sorted((n, a, off) for (n, a), (_, off) in best.items())


def _wall_us(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Microseconds of a wall time as if it were UTC; null for impossible ones."""
    date = F.try_make_timestamp_ntz(y, mo, d, F.lit(0), F.lit(0), F.lit(0))
    days = F.datediff(date.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    ok = (h <= 23) & (mi <= 59) & (s <= 59) & (y >= 1)
    return F.when(ok, (days * 86400 + h * 3600 + mi * 60 + s) * F.lit(1_000_000).cast("bigint"))


def _utc(wall: Column, zone: Column) -> Column:
    """UTC of a wall time: the first of two, and past a gap by its length."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


def candidates(df: DataFrame, text: str, zone: str, abbr: DataFrame) -> DataFrame:
    """Add ``_cands``: the valid parses of each text as (format, utc_us).

    Each text meets one regular expression for its date and one for the rest;
    their groups come out as one delimited string, so nothing is matched twice.
    """
    t = F.regexp_replace(F.col(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    compact = r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(\d{2})?"
    t = F.when(t.rlike(compact), F.regexp_replace(F.regexp_replace(t, compact, "$1-$2-$3T$4:$5:$6"), r"^([^:]+:\d{2}):(?!\d)", "$1")).otherwise(t)
    base = df.columns
    df = df.select("*", t.alias("_t"))
    form, parts = None, None
    for name, rx, gy, gm, gd in DATE_FORMS:
        if name == "slash_mdy":
            continue  # the same texts as slash_dmy
        hit = F.col("_t").rlike(rx)
        form = F.when(hit, name) if form is None else form.when(hit, name)
    df = df.select("*", form.alias("_form"))
    for name, rx, gy, gm, gd in DATE_FORMS:
        if name == "slash_mdy":
            continue
        is_form = F.col("_form") == name
        cut = F.regexp_replace("_t", rx + "(.*)$", f"${gy}|${gm}|${gd}|$4")
        parts = F.when(is_form, cut) if parts is None else parts.when(is_form, cut)
    df = df.select("*", F.split(parts, r"\|", 4).alias("_p"))
    rest = F.try_element_at("_p", F.lit(4))
    df = df.select("*", F.when(rest.rlike(TIME), F.split(F.regexp_replace(rest, TIME, "$1|$2|$3|$4|$5|$6|$7"), r"\|")).alias("_q"))
    part = lambda i: F.try_element_at("_p", F.lit(i))
    g = lambda i: F.try_element_at("_q", F.lit(i))
    num = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    hour, ampm = num(g(1)), F.upper(g(5))
    hour = (
        F.when(ampm == "", hour)
        .when((g(1) == "") | (hour < 1) | (hour > 12), F.lit(99))
        .when(ampm == "AM", hour % 12)
        .otherwise(hour % 12 + 12)
    )
    month = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    named = F.col("_form").isin("month_first", "rfc")
    df = df.select(
        *base, "_t", "_form",
        part(1).try_cast("int").alias("_y"),
        F.when(named, month[F.lower(F.substring(part(2), 1, 3))]).otherwise(part(2).try_cast("int")).alias("_mo"),
        part(3).try_cast("int").alias("_d"),
        hour.alias("_h"), num(g(2)).alias("_mi"), num(g(3)).alias("_s"),
        F.substring(F.rpad(g(4), 6, "0"), 1, 6).cast("bigint").alias("_us"),
        F.upper(g(6)).alias("_z"), g(7).alias("_region"),
    )
    a = abbr.select(F.col("zone").alias("_az"), F.col("abbr").alias("_ab"), F.col("offset").alias("_aoff"))
    df = df.join(F.broadcast(a), (F.col(zone) == F.col("_az")) & (F.col("_z") == F.col("_ab")), "left")
    digits = F.regexp_replace("_z", "[^0-9]", "")
    oh = F.when(F.length(digits) > 2, F.substring(digits, 1, F.length(digits) - 2)).otherwise(digits).try_cast("int")
    om = F.when(F.length(digits) > 2, F.substring(digits, -2, 2)).otherwise("0").try_cast("int")
    sign = F.when(F.contains("_z", F.lit("-")), -1).otherwise(1)
    offset = (
        F.when(F.col("_z").isin("Z", "UTC", "GMT"), F.lit(0))
        .when((digits != "") & (oh <= 18) & (om <= 59), sign * (oh * 3600 + om * 60))
        .otherwise(F.col("_aoff"))
    )
    region = F.when(F.col("_region") == "", F.col(zone)).when(F.col("_region").isin(_zones()), F.col("_region"))
    df = df.select("*", offset.cast("bigint").alias("_off"), F.when(F.col("_z") == "", region).alias("_in"))

    def instant(mo: str, d: str) -> Column:
        wall = _wall_us(F.col("_y"), F.col(mo), F.col(d), F.col("_h"), F.col("_mi"), F.col("_s"))
        return F.when(F.col("_off").isNotNull(), wall - F.col("_off") * 1_000_000).otherwise(_utc(wall, F.col("_in"))) + F.col("_us")

    slash = F.col("_form") == "slash_dmy"
    number = F.when(F.col("_form").isNull() & F.col("_t").rlike(r"^\d{1,20}(\.\d+)?$"), F.col("_t").try_cast("decimal(38,12)"))
    df = df.select("*", instant("_mo", "_d").alias("_i1"), F.when(slash, instant("_d", "_mo")).alias("_i2"), number.alias("_n"))
    cand = lambda name, us: F.when(us.isNotNull(), F.struct(name.alias("fmt"), us.cast("bigint").alias("us")))
    dated = F.array(cand(F.col("_form"), F.col("_i1")), cand(F.lit("slash_mdy"), F.col("_i2")))
    epochs = []
    for name, (scale, least) in EPOCH_UNITS.items():
        inside = (F.col("_n") >= F.lit(least * scale)) & (F.col("_n") < F.lit(EPOCH_END * scale))
        us = F.floor(F.col("_n") * (10**6 // scale)) if scale <= 10**6 else F.floor(F.col("_n") / (scale // 10**6))
        epochs.append(F.when(inside, cand(F.lit(name), us)))
    none = F.array().cast("array<struct<fmt:string,us:bigint>>")
    return df.select(*base, F.when(F.col("_form").isNotNull(), F.array_compact(dated)).when(F.col("_n").isNotNull(), F.array_compact(F.array(*epochs))).otherwise(none).alias("_cands"))


_POSTERIOR = T.StructType(
    [
        T.StructField("source_table", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("fmt", T.StringType()),
        T.StructField("posterior", T.DoubleType()),
        T.StructField("contradicts", T.BooleanType()),
    ]
)


def _fit(declared_weight: float, rounds: int):
    """EM over the format mixture of each source; one row in for each source and parse signature."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        order = batch["date_order"].iloc[0]
        sigs = [s.split(",") for s in batch["signature"]]
        n = batch["n"].to_numpy(float)
        fmts = sorted({f for s in sigs for f in s})
        against = {"dmy": "slash_mdy", "mdy": "slash_dmy"}.get(order)
        prior = {f: 1.0 for f in fmts}
        if against in prior:
            prior[against] = 1e-9
            for f in ("slash_dmy", "slash_mdy"):
                if f in prior and f != against:
                    prior[f] += declared_weight
        w = dict(prior)
        for _ in range(rounds):
            total = sum(w.values())
            new = dict(prior)
            for s, k in zip(sigs, n):
                den = sum(w[f] / total for f in s)
                for f in s:
                    new[f] += k * (w[f] / total) / den
            moved = max(abs(new[f] - w[f]) / new[f] for f in fmts)
            w = new
            if moved < 1e-9:
                break
        rows = [
            (batch["source_table"].iloc[0], batch["namespace"].iloc[0], sig, f, w[f] / sum(w[x] for x in s), f == against)
            for sig, s in zip(batch["signature"], sigs)
            for f in s
        ]
        return pd.DataFrame(rows, columns=_POSTERIOR.fieldNames())

    return run


def normalise_timestamps(
    records: DataFrame,
    namespaces: DataFrame,
    *,
    min_posterior: float = 0.95,
    declared_weight: float = 1e6,
    rounds: int = 50,
) -> DataFrame:
    """One row for each record: source_table, record_id, text, utc_us, status, fmt, posterior.

    ``records`` has source_table, record_id, text, namespace and loaded_at.
    ``namespaces`` has namespace, home_zone and date_order; a namespace that it
    lacks has the zone UTC and no declared order, so the mixture decides; a
    zone that is not in the zone database counts as UTC.
    """
    spark = records.sparkSession
    abbr = spark.createDataFrame(_abbreviations(), "zone string, abbr string, offset int")
    zones = namespaces.groupBy(F.col("namespace").alias("_zn")).agg(F.min("home_zone").alias("_zone"), F.min("date_order").alias("_order"))
    zones = zones.withColumn("_zone", F.when(F.col("_zone").isin(_zones()), F.col("_zone")))
    one = records.select("source_table", "record_id", "text", ns().alias("namespace"), "loaded_at")
    one = one.groupBy("source_table", "record_id").agg(F.min(F.struct(F.col("loaded_at").isNull().alias("late"), "loaded_at", F.col("text").isNull().alias("none"), "text", "namespace")).alias("r"))
    one = one.select("source_table", "record_id", "r.text", "r.namespace")
    one = one.join(zones, F.col("namespace") == F.col("_zn"), "left").drop("_zn").withColumn("_zone", F.coalesce("_zone", F.lit("UTC")))
    parsed = candidates(one, "text", "_zone", abbr)
    # read twice, by the counts and by the choice: written once instead of parsed twice
    parsed = checkpoint(parsed.withColumn("_sig", F.array_join(F.transform("_cands", lambda c: c["fmt"]), ",")))
    counts = (
        parsed.filter("_sig != ''")
        .groupBy("source_table", "namespace", F.col("_sig").alias("signature"))
        .agg(F.count("*").alias("n"), F.max("_order").alias("date_order"))
    )
    posterior = counts.groupBy("source_table", "namespace").applyInPandas(_fit(declared_weight, rounds), _POSTERIOR)
    best = posterior.groupBy("source_table", "namespace", "signature").agg(F.max_by(F.struct("fmt", "posterior", "contradicts"), F.struct("posterior", "fmt")).alias("b"))
    best = best.select(F.col("source_table").alias("_st"), F.col("namespace").alias("_ns"), F.col("signature").alias("_sg"), "b.*")
    out = parsed.join(best, (F.col("source_table") == F.col("_st")) & (F.col("namespace") == F.col("_ns")) & (F.col("_sig") == F.col("_sg")), "left")
    same = F.size(F.array_distinct(F.transform("_cands", lambda c: c["us"]))) == 1
    sure = (F.col("posterior") >= min_posterior) | same
    status = (
        F.when(F.size("_cands") == 0, "unreadable")
        .when(F.col("contradicts"), "unreadable")
        .when(sure, "resolved")
        .otherwise("ambiguous")
    )
    out = out.withColumn("status", status)
    return out.select(
        "source_table", "record_id", "namespace", "text",
        F.when(F.col("status") == "resolved", F.try_element_at(F.filter("_cands", lambda c: c["fmt"] == F.col("fmt")), F.lit(1))["us"]).alias("utc_us"),
        "status", "fmt", "posterior",
    )


def time_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three time texts of the data as one table."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    pick = lambda df, name, key, text: df.select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"), "namespace", "loaded_at")
    return (
        pick(read("behavior_log"), "behavior_log", "id", "timestamp")
        .unionByName(pick(read("emotional_trends"), "emotional_trends", "domain", "last_updated"))
        .unionByName(pick(read("memories"), "memories", "id", "created_at"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalise_timestamps(time_records(spark, sf_dir), spark.read.parquet(f"{sf_dir}/namespaces.parquet"))
    return out.filter((F.col("status") == "resolved") & ~F.col("text").rlike(CANONICAL)).select("source_table", "record_id", "utc_us").distinct()


def p1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source, format and status."""
    out = normalise_timestamps(time_records(spark, sf_dir), spark.read.parquet(f"{sf_dir}/namespaces.parquet"))
    return out.groupBy("source_table", "namespace", "fmt", "status").agg(F.count("*").alias("n_values"))
