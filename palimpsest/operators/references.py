"""References to records that are missing, deleted or arrive later.

Method: keys are dictionary-encoded as integers, so that a *range* holds at most
65,536 codes. For each table, period and range, the referenced codes and the
codes whose parent is sound during the whole period are compressed bitmaps
(sorted 16-bit arrays while sparse, 8 KB bit fields when dense); reference
AND-NOT parent leaves the codes that need a look, which are decoded and joined
back to their rows, where the exact reason follows from the row's own time.

References are reduced to distinct (table, period, key) before any shuffle by
key, so a key that holds a third of all rows costs one row for each map task.
The join back to the rows is salted.

Defined results: null and blank keys are no references; a parent id counts with
its earliest ``loaded_at`` (ties: the earliest ``deleted_at``); a null
``loaded_at`` of a reference gives the period ``unknown`` and can only be
``missing``. Repeated rows give one result; empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.common import norm_key

RANGE_BITS = 16
ARRAY_MAX = 4096  # codes beyond which a bit field is smaller than an array


def pack(low: np.ndarray) -> bytes:
    """A container of distinct 16-bit codes: a sorted array or a bit field."""
    low = np.unique(low.astype(np.uint16))
    if len(low) <= ARRAY_MAX:
        return b"A" + low.tobytes()
    bits = np.zeros(1 << RANGE_BITS, bool)
    bits[low] = True
    return b"B" + np.packbits(bits).tobytes()


def unpack(container: bytes) -> np.ndarray:
    """The sorted codes of a container."""
    if container[:1] == b"A":
        return np.frombuffer(container, np.uint16, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8, offset=1))).astype(np.uint16)


def and_not(a: bytes, b: bytes) -> bytes:
    """The codes of a that b lacks."""
    if a[:1] == b"B" and b[:1] == b"B":
        rest = np.frombuffer(a, np.uint8, offset=1) & ~np.frombuffer(b, np.uint8, offset=1)
        return pack(np.flatnonzero(np.unpackbits(rest)))
    return pack(np.setdiff1d(unpack(a), unpack(b), assume_unique=True))


def _survivors(key, refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """One range of codes: reference AND-NOT parent for each table and period."""
    low, first, gone = (parents[c].to_numpy() for c in ("low", "first_period", "gone_period"))
    out = []
    sound: dict[str, bytes] = {}
    for (table, period), part in refs.groupby(["ref_table", "period"], sort=True):
        if period not in sound:
            # loaded in an earlier period and not deleted up to the end of this one
            sound[period] = pack(low[(first < period) & (gone > period)])
        rest = unpack(and_not(pack(part["low"].to_numpy()), sound[period]))
        if len(rest):
            out.append(pd.DataFrame({"kind": key[0], "range": key[1], "ref_table": table, "period": period, "low": rest.astype(np.int32)}))
    return pd.concat(out) if out else pd.DataFrame(columns=["kind", "range", "ref_table", "period", "low"])


def dangling_references(refs: DataFrame, parents: DataFrame, *, keys_per_bucket: int = 32_768, salts: int = 16) -> DataFrame:
    """Rows whose key dangles: ref_table, period, row_key, reason.

    ``refs``: ref_table, kind, row_key, key, loaded_at. ``parents``: kind, key,
    loaded_at, deleted_at. ``kind`` says which parents a reference may name.
    """
    month = F.coalesce(F.date_format("loaded_at", "yyyy-MM"), F.lit("unknown"))
    rows = refs.select("ref_table", "kind", "row_key", norm_key("key").alias("key"), "loaded_at", month.alias("period")).filter("key is not null")
    par = (
        parents.select("kind", norm_key("key").alias("key"), "loaded_at", "deleted_at")
        .filter("key is not null")
        .groupBy("kind", "key")
        .agg(F.min(F.struct(F.col("loaded_at").isNull().alias("no"), "loaded_at", F.col("deleted_at").isNull().alias("alive"), "deleted_at")).alias("p"))
        .select("kind", "key", F.col("p.loaded_at").alias("p_loaded"), F.col("p.deleted_at").alias("p_deleted"), F.lit(True).alias("known"))
    )
    distinct = rows.groupBy("ref_table", "kind", "period", "key").agg(F.lit(1).alias("one")).drop("one")
    n = max(1, parents.count())
    buckets = max(1, n // keys_per_bucket)
    # the dictionary: dense positions within a bucket of keys; ranges of 2^16 codes stay exact however full a bucket is
    words = distinct.select("kind", "key").unionByName(par.select("kind", "key")).distinct()
    words = words.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    pos = F.row_number().over(W.partitionBy("kind", "bucket").orderBy("key")) - 1
    code = words.withColumn("pos", pos).select(
        "kind", "key",
        (F.col("bucket").cast("bigint") * (1 << 20) + F.shiftright("pos", RANGE_BITS)).alias("range"),
        F.col("pos").bitwiseAND((1 << RANGE_BITS) - 1).alias("low"),
    )
    known = code.join(par, ["kind", "key"], "left")
    coded = distinct.join(code, ["kind", "key"])
    parent_codes = known.filter("known").select(
        *[F.col(c).alias(c) for c in ("kind", "range", "low")],
        F.coalesce(F.date_format("p_loaded", "yyyy-MM"), F.lit("~")).alias("first_period"),
        F.coalesce(F.date_format("p_deleted", "yyyy-MM"), F.lit("~~")).alias("gone_period"),
    )
    left = (
        coded.select(*[F.col(c).alias(c) for c in ("kind", "range", "low", "ref_table", "period")]).groupBy("kind", "range")
        .cogroup(parent_codes.groupBy("kind", "range"))
        .applyInPandas(_survivors, "kind string, range bigint, ref_table string, period string, low int")
    )
    decoded = left.join(known, ["kind", "range", "low"]).select("kind", "ref_table", "period", "key", "p_loaded", "p_deleted", "known")
    decoded = decoded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(salts)).cast("int"))
    hits = salted.join(decoded, ["kind", "ref_table", "period", "key", "salt"])
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("p_loaded") > F.col("loaded_at"), "late")
        .when(F.col("p_deleted") <= F.col("loaded_at"), "deleted")
    )
    return hits.select("ref_table", "period", "row_key", reason.alias("reason")).filter("reason is not null").distinct()


def reference_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ref = lambda table, kind, row, key: read(table).select(F.lit(table).alias("ref_table"), F.lit(kind).alias("kind"), F.col(row).cast("string").alias("row_key"), F.col(key).alias("key"), "loaded_at")
    refs = (
        ref("hebbian_links", "memory", "link_id", "target_id")
        .unionByName(ref("memory_entities", "entity", "mention_id", "entity_id"))
        .unionByName(ref("entity_relations", "entity", "id", "source_id"))
        .unionByName(ref("access_log", "memory", "access_id", "memory_id"))
    )
    par = lambda table, kind: read(table).select(F.lit(kind).alias("kind"), F.col("id").alias("key"), "loaded_at", "deleted_at")
    return refs, par("memories", "memory").unionByName(par("entities", "entity"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dangling_references(*reference_tables(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references by table, month and reason."""
    return p6_found(spark, sf_dir).groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_rows"))


_NORM = "lower(regexp_replace({}, '^[\\s]+|[\\s]+$', '', 'g'))"
_FOUND_SQL = """
with par as (
  select 'memory' as kind, {pid} as k, min(struct_pack(l := loaded_at, d := coalesce(deleted_at, timestamp '9999-01-01'))) as p from memories group by 1, 2
  union all
  select 'entity', {pid}, min(struct_pack(l := loaded_at, d := coalesce(deleted_at, timestamp '9999-01-01'))) from entities group by 1, 2),
refs as (
  select 'hebbian_links' as ref_table, 'memory' as kind, cast(link_id as varchar) as row_key, {t} as k, loaded_at from hebbian_links
  union all select 'memory_entities', 'entity', cast(mention_id as varchar), {e}, loaded_at from memory_entities
  union all select 'entity_relations', 'entity', id, {s}, loaded_at from entity_relations
  union all select 'access_log', 'memory', cast(access_id as varchar), {m}, loaded_at from access_log)
select distinct ref_table, strftime(loaded_at, '%Y-%m') as period, row_key,
  case when p is null then 'missing' when p.l > loaded_at then 'late' else 'deleted' end as reason
from refs left join par using (kind, k)
where k <> '' and (p is null or p.l > loaded_at or p.d <= loaded_at)
""".format(pid=_NORM.format("id"), t=_NORM.format("target_id"), e=_NORM.format("entity_id"), s=_NORM.format("source_id"), m=_NORM.format("memory_id"))

SQL = {
    "p6_found": _FOUND_SQL,
    "p6_report": f"select ref_table, period, reason, count(*) as n_rows from ({_FOUND_SQL}) group by 1, 2, 3",
}
