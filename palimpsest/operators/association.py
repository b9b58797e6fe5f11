"""Associations between memories at writing time, plans over topics and moods, and rules that tune and regulate the store."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.operators.feedback import baselines
from palimpsest.functions.common import checkpoint, partitions_for, unbroadcast
from palimpsest.operators import vector_join
from palimpsest.operators.components import pairs_within
from palimpsest.operators.knowledge import VECTORS_SQL, memory_vectors, with_codes
from palimpsest.operators.retrieval import FULL_TEXT_SQL, TERMS, bm25, live, top
from palimpsest.sources import store
from palimpsest.sources.store import NOW, seconds_between, sql
from palimpsest.operators.vector_join import Best, Rows

#: Weights of entity overlap, vector and closeness in time, the score from which a link is made, links a memory, days of the window.
ASSOCIATION = {"entity": 0.3, "vector": 0.5, "time": 0.2, "least": 0.4, "links": 5, "window": 7}
KINDS = "id string, other string, score double, jac double, cos double, near double"


def just_before(m: DataFrame, days: int, most: int) -> DataFrame:
    """(this, o): for each memory the ``most`` latest ones before it in its namespace, at most ``days`` back, both as rows of ``m``.

    Time is cut into slices of that many days; a memory's partners lie in its
    slice or the one before, so each slice is a window of its own.
    """
    slot = F.floor(F.unix_seconds(F.col("created").cast("timestamp")) / (86400 * days))
    own = m.select("namespace", "id", "created", F.struct(*m.columns).alias("this"), slot.alias("slot"), F.lit(True).alias("own"))
    both = own.unionByName(own.withColumn("slot", F.col("slot") + 1).withColumn("own", F.lit(False)))
    before = F.collect_list("this").over(W.partitionBy("namespace", "slot").orderBy("created", "id").rowsBetween(-most, -1))
    x = both.withColumn("before", before).filter("own").select("this", F.explode("before").alias("o"))
    return x.filter((F.col("o.created") < F.col("this.created")) & (seconds_between(F.col("this.created"), F.col("o.created")) <= 86400 * days))


def _partners(most: int):
    """The fold that keeps the best earlier partners of each memory of a block by the score of ASSOCIATION; blocks have seconds, micros and codes."""
    w = ASSOCIATION

    class Partners(Best):
        also = ("jac", "cos", "near")

        def __init__(self, left: Rows):
            super().__init__(left, most)

        def add(self, right: Rows, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> None:
            keep = self.left.column("micros")[i] > right.column("micros")[j]
            i, j, cos = i[keep], j[keep], np.maximum(cos[keep], 0.0)
            if len(i):
                near = np.exp(-(self.left.column("seconds")[i] - right.column("seconds")[j]) / 86400.0 / 3)
                jac = vector_join.jaccard(self.left, right, i, j)
                super().add(right, i, j, np.round(w["entity"] * jac + w["vector"] * cos + w["time"] * near, 6), jac, cos, near)

    return Partners


def of_one_entity(mentions: DataFrame, rows: DataFrame, block: int = 1_000) -> DataFrame:
    """The best earlier partners of each memory among those of an entity, some for each part of an entity.

    Entities share buckets; one with more than ``block`` memories is cut, and
    each two of its parts meet in a bucket of their own. Pairs are scored where
    they meet and only a memory's best leave the task.
    """
    me = mentions.join(unbroadcast(rows), "id")
    size = mentions.groupBy("entity_id").agg(F.count("*").alias("n")).filter("n > 1").select("entity_id", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    me = me.join(unbroadcast(size), "entity_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    buckets = partitions_for(mentions.count(), 4 * block)
    two = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")))
    me = me.withColumn("meet", F.explode(two)).withColumn("key", F.concat_ws("|", "entity_id", "meet.i", "meet.j"))
    me = me.withColumn("bucket", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("string")).otherwise(F.col("key")))
    fold = _partners(ASSOCIATION["links"])

    def best(part: pa.Table) -> pa.Table:
        part = part.sort_by([("key", "ascending"), ("part", "ascending")]).combine_chunks()
        key, own, side = part["key"].combine_chunks().dictionary_encode().indices.to_numpy(), part["part"].to_numpy(), Rows(part)
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        n = np.diff(edge)
        head, tail = np.repeat(edge[:-1], n), np.repeat(edge[1:], n)
        mid = np.repeat(edge[:-1] + np.add.reduceat(own == own[head], edge[:-1]), n)  # where the other part begins
        at = np.arange(len(key))
        low, high = np.where((at < mid) & (mid < tail), mid, head), np.where(at < mid, tail, mid)
        state, done = fold(side), np.cumsum(high - low)
        lo = 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + 50_000)))
            many = (high - low)[lo:hi]
            i = np.repeat(at[lo:hi], many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + low[i]
            state.add(side, i, j, np.einsum("ij,ij->i", side.x[i], side.x[j]))
            lo = hi
        return pa.Table.from_batches([state.result()])

    return checkpoint(me.select("bucket", "key", "part", "id", "v", "seconds", "micros", "codes").groupBy("bucket").applyInArrow(best, KINDS))


def scored_before(m: DataFrame) -> DataFrame:
    """The pairs of ``just_before`` with their signals and score."""
    w, x = ASSOCIATION, just_before(m, ASSOCIATION["window"], ASSOCIATION["links"])
    jac = S.jaccard(F.col("this.codes"), F.col("o.codes"))
    cos = F.when(F.col("this.v").isNotNull() & F.col("o.v").isNotNull(), F.greatest(F.lit(0.0), S.cosine(F.col("this.v"), F.col("o.v")))).otherwise(0.0)
    near = F.exp(-(F.col("this.seconds") - F.col("o.seconds")) / 86400.0 / 3)
    x = x.select(F.col("this.id").alias("id"), F.col("o.id").alias("other"), jac.alias("jac"), cos.alias("cos"), near.alias("near"))
    return x.select("id", "other", F.round(w["entity"] * F.col("jac") + w["vector"] * F.col("cos") + w["time"] * F.col("near"), 6).alias("score"), "jac", "cos", "near")


def discover_associations(spark: SparkSession, d: str) -> DataFrame:
    """The five best earlier partners of each memory by entity Jaccard, cosine and exp(-days / 3), kept from 0.4; and which signal leads.

    Partners share an entity, have a close vector, or were written just
    before. Pairs are scored where they meet, by blocks of vectors, by entity
    and in windows of time, and no more of a meeting are kept than a memory
    may have links. Of those that are close in time only, the latest score
    highest: so many suffice.
    """
    w = ASSOCIATION
    m = store.memories(spark, d, "deleted_at").filter("deleted_at is null").select(F.lower("id").alias("id"), "namespace", "created")
    me = store.mentions(spark, d).select("memory_id", "entity_id").distinct()
    micros = F.unix_micros(F.col("created").cast("timestamp"))
    rows = m.withColumn("micros", micros).withColumn("seconds", F.floor(micros / 1_000_000).cast("bigint"))
    rows = checkpoint(with_codes(rows.join(unbroadcast(memory_vectors(spark, d)), "id", "left"), me))
    packed = vector_join.blocks(rows, extra=("seconds", "micros", "codes"))
    p = of_one_entity(me.withColumnRenamed("memory_id", "id"), rows).unionByName(scored_before(rows))
    if packed is not None:
        p = p.unionByName(vector_join.fold_pairs(packed, 0.85, _partners(w["links"]), KINDS, back=True))
    p = p.filter(F.col("score") >= w["least"]).groupBy("id", "other").agg(F.max(F.struct("score", "jac", "cos", "near")).alias("s")).select("id", "other", "s.*")
    several = sum(((F.col(c) > 0.2).cast("int") for c in ("jac", "cos", "near")), F.lit(0)) >= 2
    source = F.when(several, "multi").when((F.col("jac") >= F.col("cos")) & (F.col("jac") >= F.col("near")), "entity").when(F.col("cos") >= F.col("near"), "embedding").otherwise("temporal")
    r = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "other"))
    return p.withColumn("source", source).withColumn("rank", r.cast("bigint")).filter(F.col("rank") <= w["links"]).select("id", "other", "score", "source", "rank")


def access_coactivation(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of memories accessed in the same five minutes, at least twice: what an association would form from."""
    a = store.accesses(spark, d).select("memory_id", F.floor(F.unix_seconds(F.col("accessed_at").cast("timestamp")) / 300).alias("slot")).distinct()
    return pairs_within(a, "slot", "memory_id", "memory_id", "other").groupBy("memory_id", "other").agg(F.count("*").alias("n")).filter("n >= 2")


def affective_plan(spark: SparkSession, d: str) -> DataFrame:
    """Text hits reordered by mood: 0.5 text + 0.35 closeness of importance to a self-state of 0.8 + 0.15 recency."""
    f = bm25(live(spark, d, "content", "importance"), "content", TERMS)
    f = f.join(F.broadcast(f.agg(F.max("score").alias("best"))))
    hours = seconds_between(F.lit(NOW), F.col("event_time")) / 3600.0
    x = f.withColumn("score", F.round(0.5 * F.col("score") / F.col("best") + 0.35 * (1 - F.abs(F.col("importance") - 0.8)) + 0.15 * F.pow(F.lit(0.5), hours / 8760), 6))
    return top(x, 20).select("id", "score")


def abstract_plan(spark: SparkSession, d: str) -> DataFrame:
    """Document titles as topics: token Jaccard with a query, best first."""
    q = F.array(*[F.lit(t) for t in ("notes", "on", "retrieval", "budget")])
    t = spark.read.parquet(f"{d}/documents.parquet").filter("title is not null").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("w"))
    x = t.withColumn("score", F.round(S.jaccard(F.col("w"), q), 6)).filter("score > 0")
    return top(x, 30, key="doc_id").select("doc_id", "score")


def pages_recall(spark: SparkSession, d: str) -> DataFrame:
    """Pages that contain a term in title or text: title hits count double, newer ones more."""
    t = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    days = seconds_between(F.lit(NOW), F.col("updated_at")) / 86400.0
    s = 2.0 * F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("timeline")).cast("int") + F.contains(F.lower("text"), F.lit("timeline")).cast("int")
    x = t.withColumn("hit", s).filter("hit > 0").withColumn("score", F.round(F.col("hit") + 1 / (1 + days / 30), 6))
    return top(x, 25, key="doc_id").select("doc_id", "score")


def regulation_actions(spark: SparkSession, d: str) -> DataFrame:
    """For each namespace: low success, and each area with a bad mood, as suggested actions; and one for several at once."""
    log = spark.read.parquet(f"{d}/behavior_log.parquet").groupBy(F.coalesce("namespace", F.lit("default")).alias("domain")).agg(F.avg("outcome").alias("rate"), F.count("*").alias("n"))
    low = log.filter("n >= 10 and rate < 0.6").select("domain", F.lit("behavior_adjustment").alias("action"))
    mood = spark.read.parquet(f"{d}/emotional_trends.parquet").dropDuplicates(["domain"]).filter("event_count >= 10 and valence < -0.4").select("domain", F.lit("soul_update").alias("action"))
    many = mood.agg(F.count("*").alias("n")).filter("n >= 2").select(F.lit("*").alias("domain"), F.lit("alert_several_domains").alias("action"))
    return low.unionByName(mood).unionByName(many)


def tuning_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Parameters that feedback would move, by namespace: less success widens the context, much forgetting slows decay."""
    rate = spark.read.parquet(f"{d}/behavior_log.parquet").groupBy(F.coalesce("namespace", F.lit("default")).alias("namespace")).agg(F.avg("outcome").alias("rate"), F.count("*").alias("n"))
    gone = store.memories(spark, d, "deleted_at").groupBy("namespace").agg(F.avg(F.col("deleted_at").isNotNull().cast("int")).alias("gone"))
    x = rate.join(gone, "namespace")
    context = F.when((F.col("rate") < 0.6) & (F.col("n") > 5), F.least(F.lit(3.0), F.lit(1.5 * 1.1))).otherwise(1.5)
    mu1 = F.when(F.col("gone") > 0.10, 0.15 * 0.9).when(F.col("gone") < 0.02, 0.15 * 1.1).otherwise(0.15)
    alpha = F.when((F.col("rate") > 0.7) & (F.col("n") >= 5), 0.08 * 1.05).otherwise(0.08)
    return x.select("namespace", F.round("rate", 6).alias("rate"), F.round(context, 6).alias("context_weight"), F.round(mu1, 6).alias("mu1"), F.round(alpha, 6).alias("alpha"))


def signal_levels(spark: SparkSession, d: str) -> DataFrame:
    """Signals of events (valence from the value, arousal from its z-score against the 50 before it): counted by level."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", F.col("event_type").alias("domain"), "value")
    b = baselines(e, "domain", ("ts", "event_id"), "value", 50).filter("n >= 20 and std > 0")
    z = F.abs((F.col("value") - F.col("mean")) / F.col("std"))
    level = F.when(z < 1.5, "normal").when(z < 2.5, "elevated").when(z < 3.5, "high").otherwise("extreme")
    return b.groupBy("domain", level.alias("level")).agg(F.count("*").alias("n"))


def global_arousal(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the last 50 values over all domains, scaled: a top-50, not a sort of everything."""
    e = spark.read.parquet(f"{d}/events.parquet").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return e.agg(F.count("*").alias("n"), F.round(F.avg(F.least(F.lit(1.0), F.col("value") / 100)), 6).alias("arousal"))


def merge_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Memories of one content merged field by field: longest summary, greatest strengths, least importance, all sources."""
    m = store.memories(spark, d, "content", "summary", "importance", "core_strength", "source").filter("trim(content) <> ''")
    g = m.groupBy("namespace", F.sha2("content", 256).alias("content_hash")).agg(
        F.count("*").alias("n"), F.max(F.struct(F.length(F.coalesce("summary", F.lit(""))).alias("len"), F.coalesce("summary", F.lit("")).alias("s"))).alias("s"),
        F.max("core_strength").alias("core_strength"), F.min("importance").alias("importance"), F.countDistinct(F.when(F.trim("source") != "", F.col("source"))).alias("n_sources"),
    )
    return g.filter("n > 1").select("namespace", "content_hash", "n", F.col("s.s").alias("summary"), "core_strength", "importance", "n_sources")


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Byte-folded vectors of four places for summaries: place i mod 4 collects (byte - 128) / 128; scaled to length one."""
    m = store.memories(spark, d, "summary").filter("summary <> ''").withColumn("h", F.hex("summary"))
    codes = F.transform(F.sequence(F.lit(0), (F.length("h") / 2).cast("int") - 1), lambda i: (F.conv(F.substr(F.col("h"), (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int") - 128) / 128.0)
    m = m.select("id", *[_place(codes, k).alias(f"p{k}") for k in range(4)])
    norm = F.sqrt(sum((F.col(f"p{k}") * F.col(f"p{k}") for k in range(4)), F.lit(0.0)))
    return m.select("id", *[F.round(F.col(f"p{k}") / norm, 6).alias(f"e{k}") for k in range(4)])


def _place(codes: Column, k: int) -> Column:
    mine = F.transform(codes, lambda x, i: F.when(i % 4 == k, x).otherwise(0.0))
    return F.aggregate(mine, F.lit(0.0), lambda a, x: a + x)


def privacy_matrix(spark: SparkSession, d: str) -> DataFrame:
    """What each context may see of memories by their level (from importance): counted."""
    m = store.memories(spark, d, "importance")
    level = F.when(F.col("importance") >= 0.8, "private").when(F.col("importance") >= 0.5, "internal").otherwise("public")
    allowed = spark.createDataFrame([("owner", "public"), ("owner", "internal"), ("owner", "private"), ("team", "public"), ("team", "internal"), ("guest", "public")], "context string, level string")
    return m.groupBy(level.alias("level")).agg(F.count("*").alias("n")).join(F.broadcast(allowed), "level").groupBy("context").agg(F.sum("n").alias("n_visible"))


def stdp_net(spark: SparkSession, d: str) -> DataFrame:
    """Net direction of activation out of each memory over all its links."""
    l = store.links(spark, d)
    out = l.select(F.col("source_id").alias("id"), (F.col("temporal_forward") - F.col("temporal_backward")).alias("net")).unionByName(l.select(F.col("target_id").alias("id"), (F.col("temporal_backward") - F.col("temporal_forward")).alias("net")))
    return out.groupBy("id").agg(F.count("*").alias("n_links"), F.sum("net").alias("net"))


QUERIES = {
    f.__name__: f
    for f in (
        discover_associations, access_coactivation, affective_plan, abstract_plan, pages_recall, regulation_actions, tuning_suggestions, signal_levels, global_arousal, merge_dimensions, hash_embedding,
        privacy_matrix, stdp_net,
    )
}

_HOURS = "((epoch_us(now) // 1000000 - epoch_us({0}) // 1000000) / 3600.0::double)"


def _q(ctes: str, body: str) -> str:
    return sql("") + ", " + ctes + " " + body


_CODES = "list_transform(range(0, length(h) // 2), lambda i: (('0x' || substring(h, 2 * i + 1, 2))::int - 128) / 128.0::double)"
SQL = {
    "discover_associations": _q(
        VECTORS_SQL + """, dm as (select distinct memory_id, entity_id from me), lm as (select lower(id) as id, namespace, created from m where deleted_at is null), es as (select memory_id, list(entity_id) as ents from dm group by 1),
        pe as (select distinct x.memory_id as a, y.memory_id as b from dm x join dm y on x.entity_id = y.entity_id and x.memory_id <> y.memory_id),
        pv as (select a.vid as a, b.vid as b from us a join us b on a.vid <> b.vid where list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(a.v, lambda z: z::double * z::double)) * list_sum(list_transform(b.v, lambda z: z::double * z::double))) >= 0.85),
        jb as (select id as a, created, unnest(list(struct_pack(b := id, c := created)) over (partition by namespace order by created, id rows between 5 preceding and 1 preceding)) as o from lm),
        pt as (select a, o.b as b from jb where epoch_us(created) // 1000000 - epoch_us(o.c) // 1000000 <= 604800),
        ps as (select a, b from pe union select a, b from pv union select a, b from pt),
        s as (select x.id as id, y.id as other, coalesce(len(list_intersect(ex.ents, ey.ents)) / (len(ex.ents) + len(ey.ents) - len(list_intersect(ex.ents, ey.ents))), 0) as jac,
          coalesce(greatest(0.0::double, list_sum(list_transform(list_zip(ux.v, uy.v), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(ux.v, lambda z: z::double * z::double)) * list_sum(list_transform(uy.v, lambda z: z::double * z::double)))), 0.0) as cos,
          exp(-(epoch_us(x.created) // 1000000 - epoch_us(y.created) // 1000000) / 86400.0::double / 3) as near
          from ps join lm x on x.id = a join lm y on y.id = b left join es ex on ex.memory_id = a left join es ey on ey.memory_id = b left join us ux on ux.vid = a left join us uy on uy.vid = b where y.created < x.created),
        t as (select id, other, round(0.3::double * jac + 0.5::double * cos + 0.2::double * near, 6) as score, case when (jac > 0.2)::int + (cos > 0.2)::int + (near > 0.2)::int >= 2 then 'multi' when jac >= cos and jac >= near then 'entity' when cos >= near then 'embedding' else 'temporal' end as source from s)""",
        "select * from (select *, row_number() over (partition by id order by score desc, other) as rank from t where score >= 0.4) where rank <= 5",
    ),
    "access_coactivation": _q("a as (select distinct memory_id, epoch_us(accessed_at) // 300000000 as slot from acc)", "select x.memory_id, y.memory_id as other, count(*) as n from a x join a y on x.slot = y.slot and x.memory_id < y.memory_id group by 1, 2 having count(*) >= 2"),
    "affective_plan": _q(FULL_TEXT_SQL + f", x as (select id, round(0.5::double * score / max(score) over () + 0.35::double * (1 - abs(importance - 0.8::double)) + 0.15::double * pow(0.5::double, {_HOURS.format('event_time')} / 8760), 6) as score from ft, now_)", "select id, score from x order by score desc, id limit 20"),
    "abstract_plan": "with t as (select doc_id, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) as w, ['notes', 'on', 'retrieval', 'budget'] as q from documents where title is not null), s as (select doc_id, round(len(list_intersect(w, q)) / (len(w) + 4 - len(list_intersect(w, q))), 6) as score from t) select * from s where score > 0 order by score desc, doc_id limit 30",
    "pages_recall": f"with h as (select doc_id, 2.0::double * contains(lower(coalesce(title, '')), 'timeline')::int + contains(lower(text), 'timeline')::int as hit, (epoch_us({store.NOW_SQL}) // 1000000 - epoch_us(updated_at) // 1000000) / 86400.0::double as days from documents where text is not null), s as (select doc_id, round(hit + 1 / (1 + days / 30), 6) as score from h where hit > 0) select * from s order by score desc, doc_id limit 25",
    "regulation_actions": "with low as (select coalesce(namespace, 'default') as domain, 'behavior_adjustment' as action from behavior_log group by 1 having count(*) >= 10 and avg(outcome) < 0.6), mood as (select distinct domain, 'soul_update' as action from emotional_trends where event_count >= 10 and valence < -0.4) select * from low union all select * from mood union all select '*', 'alert_several_domains' from (select count(*) as n from mood) where n >= 2",
    "tuning_suggestions": sql("") + ", r as (select coalesce(namespace, 'default') as namespace, avg(outcome) as rate, count(*) as n from behavior_log group by 1), g as (select namespace, avg((deleted_at is not null)::int) as gone from m group by 1) select namespace, round(rate, 6) as rate, round(case when rate < 0.6 and n > 5 then 1.65::double else 1.5::double end, 6) as context_weight, round(case when gone > 0.10 then 0.135::double when gone < 0.02 then 0.165::double else 0.15::double end, 6) as mu1, round(case when rate > 0.7 and n >= 5 then 0.084::double else 0.08::double end, 6) as alpha from r join g using (namespace)",
    "signal_levels": "with b as (select *, avg(value) over w as mean, stddev_samp(value) over w as std, count(value) over w as n from events window w as (partition by event_type order by ts, event_id rows between 50 preceding and 1 preceding)), z as (select event_type as domain, abs((value - mean) / std) as z from b where n >= 20 and std > 0) select domain, case when z < 1.5 then 'normal' when z < 2.5 then 'elevated' when z < 3.5 then 'high' else 'extreme' end as level, count(*) as n from z group by 1, 2",
    "global_arousal": "select count(*) as n, round(avg(least(1.0::double, value / 100)), 6) as arousal from (select value from events order by ts desc, event_id desc limit 50)",
    "merge_dimensions": sql("select namespace, sha256(content) as content_hash, count(*) as n, max(struct_pack(len := length(coalesce(summary, '')), s := coalesce(summary, ''))).s as summary, max(core_strength) as core_strength, min(importance) as importance, count(distinct case when trim(source) <> '' then source end) as n_sources from m where trim(content) <> '' group by 1, 2 having count(*) > 1"),
    "hash_embedding": sql("") + f", c as (select id, {_CODES} as codes from (select id, hex(summary) as h from m where summary <> '')), p as (select id, " + ", ".join(f"list_sum(list_transform(codes, lambda x, i: case when (i - 1) % 4 = {k} then x else 0.0::double end)) as p{k}" for k in range(4)) + " from c) select id, " + ", ".join(f"round(p{k} / sqrt(p0 * p0 + p1 * p1 + p2 * p2 + p3 * p3), 6) as e{k}" for k in range(4)) + " from p",
    "privacy_matrix": sql("") + ", l as (select case when importance >= 0.8 then 'private' when importance >= 0.5 then 'internal' else 'public' end as level from m), a as (select * from (values ('owner', 'public'), ('owner', 'internal'), ('owner', 'private'), ('team', 'public'), ('team', 'internal'), ('guest', 'public')) t(context, level)) select context, count(*) as n_visible from l join a using (level) group by 1",
    "stdp_net": sql("select id, count(*) as n_links, sum(net)::bigint as net from (select source_id as id, temporal_forward - temporal_backward as net from hl union all select target_id, temporal_backward - temporal_forward from hl) group by 1"),
}
