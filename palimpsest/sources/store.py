"""The stored tables as the operators read them: one row a key, keys and namespaces normalised.

A repeated id counts with its earliest row. ``created`` is the moment a row
reached the store; ``event_time`` is when it happened, where that is known.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.common import norm_key, ns, table

#: The moment at which the queries look back; operators take it as a parameter.
NOW = datetime.datetime(2026, 1, 1)
NOW_SQL = "timestamp '2026-01-01 00:00:00'"


def earliest(df: DataFrame, key: str = "id") -> DataFrame:
    """The earliest row of each key (ties: the smallest row)."""
    rest = [c for c in df.columns if c not in (key, "loaded_at")]
    one = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("loaded_at", *rest)).alias("r"))
    return one.select(key, "r.*")


def memories(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Memories, with the given columns only; ``created`` and ``event_time`` are added."""
    df = table(spark, sf_dir, "memories")
    want = [c for c in df.columns if not columns or c in columns or c in ("id", "loaded_at", "occurred_at", "namespace")]
    df = earliest(df.select(*want))
    return df.withColumn("namespace", ns()).withColumn("created", F.col("loaded_at")).withColumn("event_time", F.coalesce("occurred_at", "loaded_at"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "access_log").select("access_id", norm_key("memory_id").alias("memory_id"), "accessed_at").filter("memory_id is not null")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "hebbian_links")
    return df.select("link_id", norm_key("source_id").alias("source_id"), norm_key("target_id").alias("target_id"), "strength", "coactivation_count", "temporal_forward", "temporal_backward", "direction", "created_at", ns().alias("namespace")).filter("source_id is not null and target_id is not null")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earliest(table(spark, sf_dir, "entities")).withColumn("namespace", ns()).withColumn("entity_type", F.lower("entity_type"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memory_entities").select("mention_id", norm_key("memory_id").alias("memory_id"), norm_key("entity_id").alias("entity_id"), F.when(F.trim("role") != "", F.trim("role")).alias("role"), "confidence", "recorded_at").filter("memory_id is not null and entity_id is not null")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "entity_relations").dropDuplicates(["id"])
    return df.select("id", norm_key("source_id").alias("source_id"), norm_key("target_id").alias("target_id"), "relation", "confidence", ns().alias("namespace"), "created_at").filter("source_id is not null and target_id is not null")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds, both times without zone."""
    return (F.unix_micros(later.cast("timestamp")) / 1_000_000).cast("bigint") - F.floor(F.unix_micros(earlier.cast("timestamp")) / 1_000_000)


_KEY = "nullif(lower(trim({0}, ' \t\n')), '')"
#: The same views in SQL, for the oracle.
VIEWS = f"""
m as (select *, coalesce(occurred_at, loaded_at) as event_time, loaded_at as created from (select * exclude (namespace), coalesce(namespace, 'default') as namespace, row_number() over (partition by id order by loaded_at) as rn_ from memories where id is not null) where rn_ = 1),
acc as (select access_id, {_KEY.format('memory_id')} as memory_id, accessed_at from access_log where {_KEY.format('memory_id')} is not null),
hl as (select link_id, {_KEY.format('source_id')} as source_id, {_KEY.format('target_id')} as target_id, strength, coactivation_count, temporal_forward, temporal_backward, direction, created_at, coalesce(namespace, 'default') as namespace from hebbian_links where {_KEY.format('source_id')} is not null and {_KEY.format('target_id')} is not null),
en as (select * replace (lower(entity_type) as entity_type) from (select * exclude (namespace), coalesce(namespace, 'default') as namespace, row_number() over (partition by id order by loaded_at) as rn_ from entities) where rn_ = 1),
me as (select mention_id, {_KEY.format('memory_id')} as memory_id, {_KEY.format('entity_id')} as entity_id, nullif(trim(role), '') as role, confidence, recorded_at from memory_entities where {_KEY.format('memory_id')} is not null and {_KEY.format('entity_id')} is not null),
er as (select id, {_KEY.format('source_id')} as source_id, {_KEY.format('target_id')} as target_id, relation, confidence, namespace, created_at from (select * exclude (namespace), coalesce(namespace, 'default') as namespace, row_number() over (partition by id order by loaded_at) as rn_ from entity_relations) where rn_ = 1 and {_KEY.format('source_id')} is not null and {_KEY.format('target_id')} is not null)
"""


def sql(body: str) -> str:
    """A query over the views."""
    return f"with {VIEWS}, now_ as (select {NOW_SQL} as now) {body}"
