"""The polymorphic store: every table as nodes and edges, with the checks that nothing was lost on the way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources import store
from palimpsest.sources.store import sql


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, node_kind, namespace, label, created, deleted_at) of memories and entities."""
    m = store.memories(spark, d, "summary", "memory_type", "deleted_at").select(F.lower("id").alias("node_id"), F.lit("memory").alias("node_kind"), "namespace", F.col("memory_type").alias("label"), "created", "deleted_at")
    e = store.entities(spark, d).select(F.lower("id").alias("node_id"), F.lit("entity").alias("node_kind"), "namespace", F.col("entity_type").alias("label"), F.col("loaded_at").alias("created"), "deleted_at")
    return m.unionByName(e)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(edge_id, edge_kind, predicate, source_id, target_id, weight): ids are digests, so a second run makes the same ones."""
    one = lambda df, kind, key, pred, s, t, w: df.select(F.sha2(F.concat_ws("|", F.lit(kind), F.col(key).cast("string")), 256).alias("edge_id"), F.lit(kind).alias("edge_kind"), pred.alias("predicate"), F.col(s).alias("source_id"), F.col(t).alias("target_id"), F.col(w).alias("weight"))
    parts = [
        one(store.links(spark, d), "associative", "link_id", F.col("direction"), "source_id", "target_id", "strength"),
        one(store.mentions(spark, d), "containment", "mention_id", F.coalesce("role", F.lit("mentioned")), "memory_id", "entity_id", "confidence"),
        one(store.relations(spark, d), "structural", "id", F.col("relation"), "source_id", "target_id", "confidence"),
    ]
    m = store.memories(spark, d, "superseded_by").filter("trim(superseded_by) <> ''")
    sup = m.select(F.sha2(F.concat_ws("|", F.lit("supersession"), F.lower("id")), 256).alias("edge_id"), F.lit("supersession").alias("edge_kind"), F.lit("superseded_by").alias("predicate"), F.lower("id").alias("source_id"), F.lower(F.trim("superseded_by")).alias("target_id"), F.lit(None).cast("double").alias("weight"))
    return reduce(DataFrame.unionByName, [*parts, sup])


def substrate_counts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).groupBy(F.col("node_kind").alias("kind")).agg(F.count("*").alias("n"), F.count("deleted_at").alias("n_deleted"))
    e = edges(spark, d).groupBy(F.col("edge_kind").alias("kind")).agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("n_deleted"))
    return n.unionByName(e)


def substrate_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


def substrate_parity(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose ends are no nodes, by kind."""
    n = nodes(spark, d).select(F.col("node_id").alias("k"))
    e = edges(spark, d)
    x = e.join(n.select(F.col("k").alias("sk"), F.lit(1).alias("s")), F.col("source_id") == F.col("sk"), "left").join(n.select(F.col("k").alias("tk"), F.lit(1).alias("t")), F.col("target_id") == F.col("tk"), "left")
    return x.groupBy("edge_kind").agg(F.count("*").alias("n"), F.sum(F.col("s").isNull().cast("int")).alias("no_source"), F.sum(F.col("t").isNull().cast("int")).alias("no_target"))


def content_parity(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each namespace's contents, to compare two copies of a store."""
    m = store.memories(spark, d, "content")
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "id", F.coalesce("content", F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return m.groupBy("namespace").agg(F.count("*").alias("n"), F.bit_xor(h).alias("digest"))


def provenance_chain(spark: SparkSession, d: str) -> DataFrame:
    """Memories that contradict or supersede another, with that one's type and age difference in days."""
    m = store.memories(spark, d, "memory_type", "superseded_by", "contradicts")
    refs = m.select(F.lower("id").alias("id"), F.explode(F.array(F.struct(F.lit("superseded_by").alias("how"), F.col("superseded_by").alias("ref")), F.struct(F.lit("contradicts").alias("how"), F.col("contradicts").alias("ref")))).alias("r"), "created")
    refs = refs.select("id", "r.how", F.lower(F.trim("r.ref")).alias("ref"), "created").filter("ref <> ''")
    t = m.select(F.lower("id").alias("tid"), F.col("memory_type").alias("target_type"), F.col("created").alias("target_created"))
    x = refs.join(t, F.col("ref") == F.col("tid"), "left")
    return x.groupBy("how", "target_type").agg(F.count("*").alias("n"), F.round(F.avg(store.seconds_between(F.col("created"), F.col("target_created")) / 86400.0), 6).alias("avg_days"))


QUERIES = {f.__name__: f for f in (substrate_counts, substrate_edges, substrate_parity, content_parity, provenance_chain)}

_N = "nd as (select lower(id) as node_id, 'memory' as node_kind, deleted_at from m union all select lower(id), 'entity', deleted_at from en)"
_E = """ed as (select sha256('associative|' || link_id) as edge_id, 'associative' as edge_kind, direction as predicate, source_id, target_id, strength as weight from hl
 union all select sha256('containment|' || mention_id), 'containment', coalesce(role, 'mentioned'), memory_id, entity_id, confidence from me
 union all select sha256('structural|' || id), 'structural', relation, source_id, target_id, confidence from er
 union all select sha256('supersession|' || lower(id)), 'supersession', 'superseded_by', lower(id), lower(trim(superseded_by)), null from m where trim(superseded_by) <> '')"""
SQL = {
    "substrate_counts": sql("") + f", {_N}, {_E} select node_kind as kind, count(*) as n, count(deleted_at) as n_deleted from nd group by 1 union all select edge_kind, count(*), 0 from ed group by 1",
    "substrate_edges": sql("") + f", {_E} select * from ed",
    "substrate_parity": sql("") + f", {_N}, {_E} select edge_kind, count(*) as n, sum((source_id not in (select node_id from nd))::int)::bigint as no_source, sum((target_id not in (select node_id from nd))::int)::bigint as no_target from ed group by 1",
    "content_parity": sql("select namespace, count(*) as n, bit_xor(('0x' || substring(sha256(id || '|' || coalesce(content, '')), 1, 8))::bigint) as digest from m group by 1"),
    "provenance_chain": sql("") + ", r as (select lower(id) as id, 'superseded_by' as how, lower(trim(superseded_by)) as ref, created from m union all select lower(id), 'contradicts', lower(trim(contradicts)), created from m) select how, t.memory_type as target_type, count(*) as n, round(avg((epoch_us(r.created) // 1000000 - epoch_us(t.created) // 1000000) / 86400.0::double), 6) as avg_days from r left join m t on r.ref = lower(t.id) where ref <> '' group by 1, 2",
}
