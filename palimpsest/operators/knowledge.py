"""Clusters, gates, entity sets and topics: synthesis of memories into knowledge, its conflicts, freshness and health.

Topics here are the namespaces' monthly groups of memories unless a caller
passes its own; all operators take DataFrames of memories, links and topics.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions.common import checkpoint, partitions_for, release, unbroadcast
from palimpsest.operators import vector_join
from palimpsest.operators.components import connected_components, pairs_within
from palimpsest.operators.feedback import nearest_ranks
from palimpsest.operators.propagation import Graph
from palimpsest.operators.retrieval import usable
from palimpsest.operators.vector_join import Block, Rows
from palimpsest.sources import store
from palimpsest.sources.store import NOW, seconds_between, sql

#: Weights of the pair signals (links, entities, vectors, time) and the decay of time in hours.
PAIR_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
PAIR_DECAY = 0.00413
#: Score from which a pair is an edge of the clusters.
PAIR_LEAST = 0.2


#: Rows of an entity that one task joins with so many others; entities with more are cut into blocks.
PAIR_BLOCK = 256


def shared_entities(mentions: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b, shared): all pairs of memories with a common entity, and how many. ``mentions``: memory_id, entity_id, distinct.

    The memories of an entity are cut into blocks and each two blocks meet in
    a key of their own, so an entity in many memories is spread over tasks.
    """
    return pairs_within(mentions, "entity_id", "memory_id", block=block).groupBy("a", "b").agg(F.count("*").alias("shared"))


def linked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, strength): the pairs of memories with a link, a < b."""
    l = store.links(spark, d).filter("source_id <> target_id")
    return l.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.sum("strength").alias("strength"))


def pair_candidates(spark: SparkSession, d: str, kept: DataFrame) -> DataFrame:
    """Pairs (a, b, strength, shared) of ``kept`` memories (id) that a link or a shared entity suggests."""
    linked = linked_pairs(spark, d)
    me = store.mentions(spark, d).select("memory_id", "entity_id").distinct().join(kept, F.col("memory_id") == F.col("id"), "left_semi")
    p = linked.join(shared_entities(me), ["a", "b"], "full")
    return p.select("a", "b", F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce("shared", F.lit(0)).alias("shared"))


def pair_scores(spark: SparkSession, d: str, near: bool = False) -> DataFrame:
    """(a, b, score): weighted sum of link strength, entity Jaccard, cosine and closeness in time.

    With ``near``, close vectors suggest pairs too, and those that score under PAIR_LEAST are left out where they meet.
    """
    if near:
        return met_pairs(spark, d)
    ents = store.mentions(spark, d).select("memory_id", "entity_id").distinct().groupBy("memory_id").agg(F.count("*").alias("n"))
    m = store.memories(spark, d, "importance", "deleted_at").filter("deleted_at is null and importance >= 0.3").select(F.lower("id").alias("id"), "created")
    p = pair_candidates(spark, d, m.select("id"))
    m = m.join(ents, F.col("id") == F.col("memory_id"), "left").join(usable(spark, d).select(F.lower("id").alias("vid"), "v"), F.col("id") == F.col("vid"), "left")
    side = lambda s: m.select(F.col("id").alias(s), F.col("created").alias(f"t{s}"), F.coalesce("n", F.lit(0)).alias(f"n{s}"), F.col("v").alias(f"v{s}"))
    x = p.join(side("a"), "a").join(side("b"), "b")
    union = F.col("na") + F.col("nb") - F.col("shared")
    jac = F.when(union > 0, F.col("shared") / union).otherwise(0.0)
    cos = F.when(F.col("va").isNotNull() & F.col("vb").isNotNull(), F.greatest(F.lit(0.0), S.cosine(F.col("va"), F.col("vb")))).otherwise(0.0)
    hours = F.abs(seconds_between(F.col("ta"), F.col("tb"))) / 3600.0
    w = PAIR_WEIGHTS
    score = w[0] * F.least(F.col("strength") / 10, F.lit(1.0)) + w[1] * jac + w[2] * cos + w[3] * F.exp(-PAIR_DECAY * hours)
    return x.select("a", "b", F.round(score, 6).alias("score"))


def cluster_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pair_scores(spark, d).filter(F.col("score") >= PAIR_LEAST)


def met_pairs(spark: SparkSession, d: str, least: float = 0.85) -> DataFrame:
    """(a, b, score) from PAIR_LEAST on, for pairs that a link, a shared entity or a cosine from ``least`` on suggests.

    Vectors meet in blocks, the memories of an entity in parts, and a pair is
    scored there, so only what scores enough leaves a task. A pair found by
    several sources has the score of the one that knows most: a link's has all
    signals, an entity's all but the link, a vector's those two share no entity.
    """
    w = PAIR_WEIGHTS
    kept = store.memories(spark, d, "importance", "deleted_at").filter("deleted_at is null and importance >= 0.3").groupBy(F.lower("id").alias("id")).agg(F.min("created").alias("created"))
    me = store.mentions(spark, d).select("memory_id", "entity_id").distinct()
    seconds = F.floor(F.unix_micros(F.col("created").cast("timestamp")) / 1_000_000).cast("bigint")
    rows = checkpoint(with_codes(kept.select("id", seconds.alias("seconds")).join(unbroadcast(memory_vectors(spark, d)), "id", "left"), me))
    mine = checkpoint(me.join(unbroadcast(rows.select(F.col("id").alias("memory_id"))), "memory_id", "left_semi"))

    def closeness(left: Rows, right: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.exp(-PAIR_DECAY * np.abs(left.column("seconds")[i] - right.column("seconds")[j]) / 3600.0)

    def listed(left: Rows, right: Rows, i: np.ndarray, j: np.ndarray, score: np.ndarray, known: int) -> pa.RecordBatch | None:
        score = np.round(score, 6)
        some = np.flatnonzero(score >= PAIR_LEAST)
        if not len(some):
            return None
        x, y = left.id.take(pa.array(i[some])), right.id.take(pa.array(j[some]))
        first = pc.less(x, y)
        return pa.RecordBatch.from_arrays([pc.if_else(first, x, y), pc.if_else(first, y, x), pa.array(score[some]), pa.array(np.full(len(some), known, np.int32))], ["a", "b", "score", "known"])

    class Close:
        def __init__(self, left: Block):
            self.left = left

        def add(self, right: Block, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> pa.RecordBatch | None:
            return listed(self.left, right, i, j, w[2] * np.maximum(cos, 0.0) + w[3] * closeness(self.left, right, i, j), 0)

        def result(self) -> None:
            return None

    def of_entity(left: Rows, right: Rows, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
        cos = np.maximum(np.einsum("ij,ij->i", left.x[i], right.x[j]), 0.0)
        return listed(left, right, i, j, w[1] * vector_join.jaccard(left, right, i, j) + w[2] * cos + w[3] * closeness(left, right, i, j), 1)

    kinds = "a string, b string, score double, known int"
    ends = rows.select("id")
    l = linked_pairs(spark, d).join(unbroadcast(ends.withColumnRenamed("id", "a")), "a", "left_semi").join(unbroadcast(ends.withColumnRenamed("id", "b")), "b", "left_semi")
    side = lambda s: unbroadcast(rows.select(F.col("id").alias(s), *[F.col(c).alias(c + s) for c in ("seconds", "v", "codes")]))
    x = l.join(side("a"), "a").join(side("b"), "b")
    cos = F.when(F.col("va").isNotNull() & F.col("vb").isNotNull(), F.greatest(F.lit(0.0), S.cosine(F.col("va"), F.col("vb")))).otherwise(0.0)
    near = F.exp(-PAIR_DECAY * (F.abs(F.col("secondsa") - F.col("secondsb")) / 3600.0))
    score = w[0] * F.least(F.coalesce("strength", F.lit(0.0)) / 10, F.lit(1.0)) + w[1] * S.jaccard(F.col("codesa"), F.col("codesb")) + w[2] * cos + w[3] * near
    found = [checkpoint(x.select("a", "b", F.round(score, 6).alias("score"), F.lit(2).alias("known"))), met_in_parts(mine.withColumnRenamed("memory_id", "id"), rows, of_entity, kinds)]
    packed = vector_join.blocks(rows.drop("codes"), extra=("seconds",))
    if packed is not None:
        found.append(vector_join.fold_pairs(packed, least, Close, kinds, once=True))
        release(packed)
    release(rows)
    release(mine)
    p = functools.reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.max(F.struct("known", "score")).alias("s"))
    return p.select("a", "b", F.col("s.score").alias("score")).filter(F.col("score") >= PAIR_LEAST)


def met_in_parts(mentions: DataFrame, rows: DataFrame, score: Callable[[Rows, Rows, np.ndarray, np.ndarray], pa.RecordBatch | None], schema: str, block: int = 1_000) -> DataFrame:
    """What ``score`` makes of all pairs of ``rows`` (id, ...) that share an entity; it gets the places of some pairs. ``mentions``: id, entity_id, distinct.

    Entities share buckets; one with more than ``block`` memories is cut, and
    each two of its parts meet in a bucket of their own. A pair is given once for each entity that it shares.
    """
    size = mentions.groupBy("entity_id").agg(F.count("*").alias("n")).filter("n > 1").select("entity_id", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    me = mentions.join(unbroadcast(size), "entity_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    buckets = partitions_for(mentions.count(), 4 * block)
    two = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")))
    me = me.withColumn("meet", F.explode(two)).withColumn("key", F.concat_ws("|", "entity_id", "meet.i", "meet.j"))
    me = me.withColumn("bucket", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("string")).otherwise(F.col("key")))

    def meet(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.sort_by([("key", "ascending"), ("part", "ascending"), ("id", "ascending")]).combine_chunks()
        key, own, side = part["key"].combine_chunks().dictionary_encode().indices.to_numpy(), part["part"].to_numpy(), Rows(part)
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        head, tail = np.repeat(edge[:-1], np.diff(edge)), np.repeat(edge[1:], np.diff(edge))
        other = np.repeat(edge[:-1] + np.add.reduceat(own == own[head], edge[:-1]), np.diff(edge))  # where the other part begins
        at = np.arange(len(key))
        # rows of the first part meet the other one, or those after them where a part meets itself
        low, high = np.where(part["alone"].to_numpy(), at + 1, other), np.where(at < other, tail, 0)
        many = np.maximum(high - low, 0)
        done, lo = np.cumsum(many), 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + 50_000)))
            n = many[lo:hi]
            i = np.repeat(at[lo:hi], n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]
            if len(i) and (out := score(side, side, i, j)) is not None:
                yield out
            lo = hi

    def bucket(part: pa.Table) -> pa.Table:
        out = list(meet(part))
        return pa.Table.from_batches(out) if out else none

    none = pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "score": pa.array([], pa.float64()), "known": pa.array([], pa.int32())})
    met = me.select("id", "bucket", "key", "part", (F.col("meet.i") == F.col("meet.j")).alias("alone")).join(unbroadcast(rows), "id")
    return checkpoint(met.groupBy("bucket").applyInArrow(bucket, schema))


def label_propagation(edges: DataFrame, rounds: int = 12) -> DataFrame:
    """(id, label) by weighted label propagation; ties go to the smaller label, so it is deterministic.

    Half of the nodes, by a hash of node and round, move in a round: two that
    prefer each other would swap their labels for ever if both always moved at once.
    """
    e = checkpoint(edges.select("a", "b", "score"))
    graph = Graph(e, rounds)
    release(e)
    k = graph.numbers
    return graph.members().select("k", "label").join(unbroadcast(k), "k").join(unbroadcast(k.select(F.col("k").alias("label"), F.col("id").alias("name"))), "label").select("id", F.col("name").alias("label"))


def memory_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, v): one vector for each memory that has one."""
    return usable(spark, d).groupBy(F.lower("id").alias("id")).agg(F.min("v").alias("v"))


def with_codes(rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with ``codes``, the hashes of the entities that the memory mentions (none: an empty list)."""
    own = mentions.groupBy(F.col("memory_id").alias("id")).agg(F.collect_set(F.xxhash64("entity_id")).alias("codes"))
    return rows.join(unbroadcast(own), "id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<bigint>")))


def memory_clusters(spark: SparkSession, d: str, smallest: int = 3, largest: int = 15) -> DataFrame:
    """Communities of memories with size, quality (mean score inside) and the member nearest to all others.

    Candidates come from links, shared entities and near vectors. A community
    of more than ``largest`` memories keeps those that are closest to the rest
    (``kept``); ``n`` is its whole size.
    """
    e = checkpoint(pair_scores(spark, d, near=True).filter(F.col("score") >= PAIR_LEAST).select("a", "b", "score"))
    graph = Graph(e)
    release(e)
    m = graph.members()
    group = m.groupBy("label").agg(F.count("*").alias("n"), F.try_divide(F.sum("s"), F.sum("c")).alias("quality")).filter((F.col("n") >= smallest) & F.col("quality").isNotNull())
    best = m.filter("c > 0").withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.round(-F.col("s"), 9), "k"))).filter(F.col("r") <= largest)
    best = best.join(unbroadcast(group.select("label")), "label", "left_semi").join(unbroadcast(graph.numbers), "k")
    members = best.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("kept"), F.min_by("id", "r").alias("centre"))
    names = graph.numbers.select(F.col("k").alias("label"), F.col("id").alias("name"))
    return group.join(unbroadcast(members), "label").join(unbroadcast(names), "label").select(F.col("name").alias("label"), "n", F.round("quality", 6).alias("quality"), "centre", "kept")


def gate(quality: Column, size: Column, types: Column, duplicates: Column, covered: Column) -> Column:
    """The ordered rules that decide whether a cluster becomes an insight."""
    return (
        F.when(size < 3, "skip_small").when(duplicates >= 0.95, "auto_update").when(covered >= 0.8, "skip_covered").when(quality < 0.2, "skip_quality")
        .when(types < 2, "defer_uniform").when(quality < 0.3, "defer_quality").otherwise("synthesize")
    )


def namespace_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate over groups of one namespace, month and source kind: size, diversity, and what is already consolidated."""
    m = store.memories(spark, d, "memory_type", "importance", "consolidation_count", "content")
    g = m.groupBy("namespace", F.date_format("created", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.countDistinct("memory_type").alias("n_types"), F.avg("importance").alias("quality"),
        F.avg((F.col("consolidation_count") >= 5).cast("int")).alias("covered"), (1 - F.countDistinct("content") / F.count("content")).alias("dup"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"),
    )
    return g.select("namespace", "month", "n", "n_types", gate(F.col("quality"), F.col("n"), F.col("n_types"), F.coalesce("dup", F.lit(0.0)), F.col("covered")).alias("decision"), F.round(F.col("chars") / 4 * 1e-6, 9).alias("cost"))


def insight_weight(importance: Column, confidence: Column, quality: Column) -> Column:
    """Importance of an insight: mean importance of its sources, scaled by its confidence and the cluster's quality, at most 1."""
    return F.least(F.lit(1.0), importance * (0.5 + 0.5 * confidence) * (0.8 + 0.2 * quality))


def insight_importance(spark: SparkSession, d: str) -> DataFrame:
    """For groups of one namespace and type: confidence is that of their mentions, quality the share that is still live."""
    m = store.memories(spark, d, "memory_type", "importance", "deleted_at").select(F.lower("id").alias("id"), "namespace", "memory_type", "importance", F.col("deleted_at").isNull().cast("int").alias("live"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,6)"))  # noqa: E731  # sums that do not depend on the order of the rows
    sure = store.mentions(spark, d).filter("confidence is not null").groupBy("memory_id").agg(exact("confidence").alias("c"), F.count("*").alias("k"))
    g = m.join(sure, F.col("id") == F.col("memory_id"), "left").groupBy("namespace", "memory_type").agg(F.count("*").alias("n"), (exact("importance").cast("double") / F.count("importance")).alias("i"), (F.sum("c").cast("double") / F.sum("k")).alias("c"), (F.sum("live") / F.count("*")).alias("q"))
    return g.select("namespace", "memory_type", "n", F.round(insight_weight(F.col("i"), F.coalesce("c", F.lit(0.0)), F.col("q")), 9).alias("importance"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """Element-wise mean of the vectors of each label, as its first four places and its norm."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.posexplode("embedding").alias("pos", "x"))
    c = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return c.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 5).alias("norm"), *[F.round(F.max(F.when(F.col("pos") == i, F.col("x"))), 5).alias(f"c{i}") for i in range(4)])


def assign_to_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's nearest centroid by cosine, or ``pending`` below 0.6: counted by true label."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding")
    c = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = c.groupBy(F.col("label").alias("c_label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("c"))
    x = e.join(F.broadcast(c))  # a handful of centroids
    best = x.groupBy("vec_id", "label").agg(F.max(F.struct(F.round(S.cosine(F.col("embedding").cast("array<double>"), F.col("c")), 6).alias("s"), (-F.col("c_label")).alias("c"))).alias("b"))
    return best.groupBy("label", F.when(F.col("b.s") < 0.6, "pending").otherwise((-F.col("b.c")).cast("string")).alias("assigned")).agg(F.count("*").alias("n"))


def topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic pages: the memories that mention one entity, with their times."""
    me = store.mentions(spark, d).select("memory_id", "entity_id").distinct()
    m = store.memories(spark, d, "deleted_at", "importance").select(F.lower("id").alias("id"), "created", "deleted_at", "importance")
    return me.join(m, F.col("memory_id") == F.col("id")).select(F.col("entity_id").alias("topic"), "id", "created", "deleted_at", "importance")


def topic_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Mean importance weighted by (1 + age in days) ^ -1.5, and what to do with the topic."""
    t = topics(spark, d)
    age = seconds_between(F.lit(NOW), F.col("created")) / 86400.0
    w = F.pow(1 + age, F.lit(-1.5))
    g = t.groupBy("topic").agg(F.count("*").alias("n"), (F.sum(F.col("importance") * w) / F.sum(w)).alias("fresh"), F.min(age).alias("youngest"))
    limit = F.pow(1 + F.col("youngest"), F.lit(-0.5))
    return g.select("topic", "n", F.round("fresh", 6).alias("freshness"), F.when(F.col("fresh") >= 0.5 + limit, "keep").when(F.col("fresh") >= limit, "refresh").otherwise("archive").alias("action"))


def topic_health(spark: SparkSession, d: str) -> DataFrame:
    """Share of sources that are still there, mean importance, size and a combined score for each topic of three and more."""
    g = topics(spark, d).groupBy("topic").agg(F.count("*").alias("n"), F.avg(F.col("deleted_at").isNull().cast("int")).alias("valid"), F.avg("importance").alias("imp")).filter("n >= 3")
    score = 0.4 * F.col("imp") + 0.3 * F.col("valid") + 0.2 * F.least(F.lit(1.0), F.col("n") / 10) + 0.1
    return g.select("topic", "n", F.round("valid", 6).alias("valid_share"), F.round(score, 6).alias("score"))


def link_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every link of the store: broken (an end is missing or deleted), stale (weak) or valid."""
    m = store.memories(spark, d, "deleted_at").filter("deleted_at is null").select(F.lower("id").alias("k"), F.lit(True).alias("ok"))
    l = store.links(spark, d)
    x = l.join(m.select(F.col("k").alias("sk"), F.col("ok").alias("s")), F.col("source_id") == F.col("sk"), "left").join(m.select(F.col("k").alias("tk"), F.col("ok").alias("t")), F.col("target_id") == F.col("tk"), "left")
    state = F.when(F.col("s").isNull() | F.col("t").isNull(), "broken").when(F.col("strength") < 0.2, "stale").otherwise("valid")
    return x.groupBy("namespace", state.alias("state")).agg(F.count("*").alias("n"))


def topic_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Topics whose sources overlap (Jaccard over 0.1) with the severity of the conflict. The topics of a memory meet in blocks."""
    t = checkpoint(topics(spark, d).select("topic", "id").distinct())
    n = t.groupBy("topic").agg(F.count("*").alias("n"))
    p = pairs_within(t, "id", "topic", "topic", "other").groupBy("topic", "other").agg(F.count("*").alias("both"))
    p = p.join(n, "topic").join(n.select(F.col("topic").alias("other"), F.col("n").alias("n2")), "other")
    o = F.round(F.col("both") / (F.col("n") + F.col("n2") - F.col("both")), 6)
    p = p.withColumn("overlap", o).filter("overlap > 0.1")
    return p.select("topic", "other", "overlap", S.label(F.col("overlap"), [(0.8, "critical"), (0.6, "high"), (0.3, "medium")], "low").alias("severity"))


def duplicate_topics(spark: SparkSession, d: str) -> DataFrame:
    """Groups of topics joined by overlaps of at least a fifth."""
    p = topic_overlap(spark, d).filter("overlap >= 0.2")
    return connected_components(p, "topic", "other").select(F.col("node").alias("topic"), F.col("component").alias("keep"))


def change_detect(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source since a compile at a fixed time: updated, removed (null text) or the same; and whether to recompile."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("source", "text", "updated_at")
    since = F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")
    g = t.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("updated_at") > since).cast("int")).alias("modified"), F.sum(F.col("text").isNull().cast("int")).alias("removed"))
    ratio = (F.col("modified") + F.col("removed")) / F.col("n")
    return g.select("source", "n", "modified", "removed", F.round(ratio, 6).alias("ratio"), F.when(ratio >= 0.5, "eager").when(ratio >= 0.3, "lazy").otherwise("skip").alias("trigger"))


def nearest_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate memories to reconcile: cosine at least 0.85, by 0.7 cosine + 0.3 entity Jaccard.

    For each memory that has any: how many, and the best one with its cosine and score.
    """
    packed = vector_join.blocks(with_codes(memory_vectors(spark, d), store.mentions(spark, d)), extra=("codes",))
    if packed is None:
        return spark.createDataFrame([], "id string, n bigint, closest double, score double")

    class Nearest:
        def __init__(self, left: Block):
            self.left, self.n = left, np.zeros(len(left.id), np.int64)
            self.closest, self.score = np.full(len(left.id), -np.inf), np.full(len(left.id), -np.inf)

        def add(self, right: Block, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> None:
            self.n += np.bincount(i, minlength=len(self.n))
            np.maximum.at(self.closest, i, cos)
            np.maximum.at(self.score, i, 0.7 * cos + 0.3 * vector_join.jaccard(self.left, right, i, j))

        def result(self) -> pa.RecordBatch:
            some = np.flatnonzero(self.n)
            return pa.RecordBatch.from_arrays([self.left.id.take(pa.array(some)), *[pa.array(z[some]) for z in (self.n, self.closest, self.score)]], ["id", "n", "closest", "score"])

    x = vector_join.fold_pairs(packed, 0.85, Nearest, "id string, n bigint, closest double, score double", back=True)
    return x.groupBy("id").agg(F.sum("n").alias("n"), F.round(F.max("closest"), 5).alias("closest"), F.round(F.max("score"), 5).alias("score"))


def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    """Rank agreement of importance and core strength within each namespace and month: (concordant - discordant) / pairs.

    Discordant pairs are counted as inversions while one order is merged into
    the other, in n log n for a group, instead of meeting all pairs.
    """
    m = store.memories(spark, d, "importance", "core_strength").select("namespace", F.date_format("created", "yyyy-MM").alias("month"), "importance", "core_strength")
    # equal points count once with their number, so a group is as large as its distinct points
    points = m.groupBy("namespace", "month", "importance", "core_strength").agg(F.count("*").alias("n"))
    return points.groupBy("namespace", "month").applyInPandas(_tau, "namespace string, month string, n_pairs bigint, tau double")


def _tau(x: pd.DataFrame) -> pd.DataFrame:
    w = x["n"].to_numpy(np.int64)
    a, b = x["importance"].to_numpy(float), x["core_strength"].to_numpy(float)
    total = int(w.sum())
    pairs = total * (total - 1) // 2
    if not pairs:
        return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("namespace", object), ("month", object), ("n_pairs", "int64"), ("tau", "float64"))})
    usable_ = ~(np.isnan(a) | np.isnan(b))
    a, b, w = a[usable_], b[usable_], w[usable_]
    place = np.unique(b, return_inverse=True)[1]
    tree = np.zeros(len(place) + 2, np.int64)

    def below(i: int) -> int:
        s = 0
        while i > 0:
            s += tree[i]
            i -= i & -i
        return int(s)

    agree = seen = 0
    order = np.argsort(a, kind="stable")
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and a[order[end]] == a[order[at]]:
            end += 1
        same = order[at:end]
        for k in same:  # against all with a smaller importance: smaller strengths agree, greater ones do not
            less, up_to = below(place[k]), below(place[k] + 1)
            agree += int(w[k]) * (less - (seen - up_to))
        for k in same:
            i = place[k] + 1
            while i < len(tree):
                tree[i] += w[k]
                i += i & -i
            seen += int(w[k])
        at = end
    return pd.DataFrame({"namespace": [x["namespace"].iloc[0]], "month": [x["month"].iloc[0]], "n_pairs": [pairs], "tau": [round(agree / pairs, 6)]})


def pipeline_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Outcome rates and latency quantiles (nearest rank) of events by type, as a metrics registry reports them."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("plan"), "value")
    g = e.groupBy("plan").agg(F.count("*").alias("total"), F.round(F.avg((F.col("value") < 5).cast("int")), 6).alias("empty_rate"))
    q = nearest_ranks(e, "plan", "value", (0.5, 0.99)).groupBy("plan").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{int(100 * p)}") for p in (0.5, 0.99)])
    return g.join(q, "plan")


QUERIES = {
    f.__name__: f
    for f in (
        cluster_pairs, memory_clusters, namespace_gate, insight_importance, centroids, assign_to_centroids, topic_freshness, topic_health, link_audit, topic_overlap, duplicate_topics,
        change_detect, nearest_duplicates, kendall_tau, pipeline_metrics,
    )
}

_COS2 = "(case when va is null or vb is null then 0.0::double else greatest(0.0::double, list_sum(list_transform(list_zip(va, vb), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(va, lambda z: z::double * z::double)) * list_sum(list_transform(vb, lambda z: z::double * z::double)))) end)"
VECTORS_SQL = "us as (select lower(memory_id) as vid, min(embedding) as v from memory_embeddings where model = 'nimbus-embed-64' and len(embedding) = 64 and memory_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1)"
_TOP = "tp as (select entity_id as topic, lower(m.id) as id, created, deleted_at, importance from (select distinct memory_id, entity_id from me) x join m on x.memory_id = lower(m.id))"
_AGE = "((epoch_us(now) // 1000000 - epoch_us(created) // 1000000) / 86400.0::double)"


def _q(ctes: str, body: str) -> str:
    return sql("") + ", " + ctes + " " + body


SQL = {
    "cluster_pairs": _q(
        f"""lk as (select least(source_id, target_id) as a, greatest(source_id, target_id) as b, sum(strength) as strength from hl where source_id <> target_id group by 1, 2),
        dm as (select distinct memory_id, entity_id from me),
        sh as (select x.memory_id as a, y.memory_id as b, count(*) as shared from dm x join dm y on x.entity_id = y.entity_id and x.memory_id < y.memory_id group by 1, 2),
        p as (select a, b, coalesce(strength, 0.0::double) as strength, coalesce(shared, 0) as shared from lk full join sh using (a, b)), ne as (select memory_id, count(*) as n from dm group by 1), {VECTORS_SQL},
        mm as (select lower(id) as id, created, coalesce(n, 0) as n, v from m left join ne on memory_id = lower(id) left join us on vid = lower(id) where deleted_at is null and importance >= 0.3),
        x as (select p.a, p.b, strength, shared, ma.n + mb.n - shared as u, ma.v as va, mb.v as vb, abs(epoch_us(ma.created) // 1000000 - epoch_us(mb.created) // 1000000) / 3600.0::double as hours from p join mm ma on p.a = ma.id join mm mb on p.b = mb.id),
        y as (select a, b, round(0.4::double * least(strength / 10, 1.0::double) + 0.3::double * (case when u > 0 then shared / u else 0.0::double end) + 0.2::double * {_COS2} + 0.1::double * exp(-0.00413::double * hours), 6) as score from x)""",
        "select * from y where score >= 0.2",
    ),
    "namespace_gate": sql("""select namespace, month, n, n_types, case when n < 3 then 'skip_small' when coalesce(dup, 0) >= 0.95 then 'auto_update' when covered >= 0.8 then 'skip_covered' when quality < 0.2 then 'skip_quality' when n_types < 2 then 'defer_uniform' when quality < 0.3 then 'defer_quality' else 'synthesize' end as decision, round(chars / 4 * 1e-6::double, 9) as cost
      from (select namespace, strftime(created, '%Y-%m') as month, count(*) as n, count(distinct memory_type) as n_types, avg(importance) as quality, avg((consolidation_count >= 5)::int) as covered, 1 - count(distinct content) / count(content) as dup, sum(length(coalesce(content, ''))) as chars from m group by 1, 2)"""),
    "insight_importance": sql("select namespace, memory_type, count(*) as n, round(least(1.0::double, sum(importance::decimal(18,6))::double / count(importance) * (0.5::double + 0.5::double * coalesce(sum(c)::double / sum(k), 0)) * (0.8::double + 0.2::double * (sum((deleted_at is null)::int) / count(*)))), 9) as importance from m left join (select memory_id, sum(confidence::decimal(18,6)) as c, count(*) as k from me where confidence is not null group by 1) c on c.memory_id = lower(m.id) group by 1, 2"),
    "centroids": "with c as (select label, i - 1 as pos, avg(embedding[i]::double) as x from embeddings, range(1, 65) t(i) where i <= len(embedding) group by 1, 2) select label, round(sqrt(sum(x * x)), 5) as norm, " + ", ".join(f"round(max(x) filter (pos = {i}), 5) as c{i}" for i in range(4)) + " from c group by 1",
    "assign_to_centroids": "with c0 as (select label, i as pos, avg(embedding[i]::double) as x from embeddings, range(1, 65) t(i) where i <= len(embedding) group by 1, 2), c as (select label as c_label, list(x order by pos) as c from c0 group by 1), x as (select vec_id, label, c_label, round(list_sum(list_transform(list_zip(embedding, c), lambda z: z[1]::double * z[2])) / sqrt(list_sum(list_transform(embedding, lambda z: z::double * z::double)) * list_sum(list_transform(c, lambda z: z * z))), 6) as s from embeddings, c), b as (select *, row_number() over (partition by vec_id order by s desc, c_label) as r from x) select label, case when s < 0.6 then 'pending' else c_label::varchar end as assigned, count(*) as n from b where r = 1 group by 1, 2",
    "topic_freshness": _q(_TOP + f", g as (select topic, count(*) as n, sum(importance * pow(1 + {_AGE}, -1.5::double)) / sum(pow(1 + {_AGE}, -1.5::double)) as fresh, min({_AGE}) as youngest from tp, now_ group by 1)", "select topic, n, round(fresh, 6) as freshness, case when fresh >= 0.5::double + pow(1 + youngest, -0.5::double) then 'keep' when fresh >= pow(1 + youngest, -0.5::double) then 'refresh' else 'archive' end as action from g"),
    "topic_health": _q(_TOP, "select topic, count(*) as n, round(avg((deleted_at is null)::int), 6) as valid_share, round(0.4::double * avg(importance) + 0.3::double * avg((deleted_at is null)::int) + 0.2::double * least(1.0::double, count(*) / 10) + 0.1::double, 6) as score from tp group by 1 having count(*) >= 3"),
    "link_audit": sql("select namespace, case when source_id not in (select lower(id) from m where deleted_at is null) or target_id not in (select lower(id) from m where deleted_at is null) then 'broken' when strength < 0.2 then 'stale' else 'valid' end as state, count(*) as n from hl group by 1, 2"),
    "topic_overlap": _q(_TOP + ", t as (select distinct topic, id from tp), n as (select topic, count(*) as n from t group by 1), p as (select a.topic, b.topic as other, count(*) as both_ from t a join t b on a.id = b.id and a.topic < b.topic group by 1, 2), o as (select p.topic, other, round(both_ / (n.n + n2.n - both_), 6) as overlap from p join n on n.topic = p.topic join n n2 on n2.topic = other)", "select topic, other, overlap, case when overlap >= 0.8 then 'critical' when overlap >= 0.6 then 'high' when overlap >= 0.3 then 'medium' else 'low' end as severity from o where overlap > 0.1"),
    "change_detect": "select source, n, modified, removed, round((modified + removed) / n, 6) as ratio, case when (modified + removed) / n >= 0.5 then 'eager' when (modified + removed) / n >= 0.3 then 'lazy' else 'skip' end as trigger from (select source, count(*) as n, sum((updated_at > timestamp '2025-06-01')::int)::bigint as modified, sum((text is null)::int)::bigint as removed from documents group by 1)",
    "nearest_duplicates": _q(VECTORS_SQL + """, x as (select a.vid as a, b.vid as b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(a.v, lambda z: z::double * z::double)) * list_sum(list_transform(b.v, lambda z: z::double * z::double))) as cosine from us a join us b on a.vid < b.vid),
        p as (select * from x where cosine >= 0.85), dm as (select distinct memory_id, entity_id from me), ne as (select memory_id, count(*) as n from dm group by 1),
        sh as (select a, b, count(*) as shared from p join dm x on x.memory_id = a join dm y on y.memory_id = b and x.entity_id = y.entity_id group by 1, 2),
        s as (select a, b, round(cosine, 5) as cosine, round(0.7::double * cosine + 0.3::double * coalesce(coalesce(shared, 0) / nullif(coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(shared, 0), 0), 0), 5) as score from p left join sh using (a, b) left join ne na on na.memory_id = a left join ne nb on nb.memory_id = b)""",
        "select id, count(*) as n, max(cosine) as closest, max(score) as score from (select a as id, cosine, score from s union all select b, cosine, score from s) group by 1"),
    "kendall_tau": sql("") + ", k as (select namespace, strftime(created, '%Y-%m') as month, id, importance, core_strength from m) select a.namespace, a.month, count(*) as n_pairs, round(sum(sign(a.importance - b.importance) * sign(a.core_strength - b.core_strength)) / count(*), 6) as tau from k a join k b on a.namespace = b.namespace and a.month = b.month and a.id < b.id group by 1, 2",
    "pipeline_metrics": "with r as (select event_type as plan, value, row_number() over (partition by event_type order by value, event_id) - 1 as i, count(*) over (partition by event_type) as n from events) select plan, count(*) as total, round(avg((value < 5)::int), 6) as empty_rate, max(value) filter (i = floor(0.5::double * (n - 1) + 0.5::double)) as p50, max(value) filter (i = floor(0.99::double * (n - 1) + 0.5::double)) as p99 from r group by 1",
}
