"""Consolidation, decay, forgetting, links between memories, health of the store.

Updates are projections over the whole table: each operator returns the new
rows or the report, and the caller writes them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions.common import checkpoint, norm_key, table
from palimpsest.operators import activation as A
from palimpsest.sources import store
from palimpsest.sources.store import NOW, seconds_between, sql

STATE = ("memory_type", "layer", "importance", "working_strength", "core_strength", "consolidation_count", "pinned", "contradicted_by", "superseded_by", "deleted_at", "last_consolidated")


def decayed(m: DataFrame, days: float, mu1: float, mu2: float, where: Column | None = None) -> DataFrame:
    """Exponential decay of both strengths; pinned memories keep theirs."""
    on = ~F.coalesce(F.col("pinned"), F.lit(False)) & (where if where is not None else F.lit(True))


    return m.withColumn("working_strength", F.when(on, F.col("working_strength") * math.exp(-mu1 * days)).otherwise(F.col("working_strength"))).withColumn("core_strength", F.when(on, F.col("core_strength") * math.exp(-mu2 * days)).otherwise(F.col("core_strength")))


def rebalanced(m: DataFrame, promote: float = 0.25, demote: float = 0.05, archive: float = 0.15) -> DataFrame:
    total = F.col("core_strength") + F.col("working_strength")
    layer = (
        F.when(F.col("pinned"), "core")
        .when((F.col("layer") != "core") & (F.col("core_strength") >= promote), "core")
        .when((F.col("layer") == "working") & (F.col("working_strength") < archive) & (F.col("core_strength") < archive), "archive")
        .when((F.col("layer") == "core") & (total < demote), "archive")
        .otherwise(F.col("layer"))
    )
    return m.withColumn("layer", layer)


def consolidate(m: DataFrame, days: float = 1.0, preset: str = "default", seed: int = 7) -> DataFrame:
    """One cycle: transfer and decay of the working layer, replay of a share of the archive, decay of the core, rebalance.

    The replayed share is exactly the first ceil(ratio n) archived memories in a
    seeded hash order (ties by id). Counts of the hash's leading bits tell in
    which of 4,096 slices the last one lies; only that slice is ranked.
    """
    p = S.preset(preset)
    pinned = F.coalesce(F.col("pinned"), F.lit(False))
    working, core, arch = (F.col("layer") == x for x in ("working", "core", "archive"))
    m = m.withColumn("h", F.xxhash64("id", F.lit(seed))).withColumn("slice", F.shiftrightunsigned("h", 52).cast("int"))
    counts = {r["slice"]: r["n"] for r in m.filter(arch).groupBy("slice").agg(F.count("*").alias("n")).collect()}  # at most 4,096 rows
    left, last = math.ceil(p["interleave_ratio"] * sum(counts.values())), 4096
    for k in sorted(counts):
        if left <= counts[k]:
            last = k
            break
        left -= counts[k]
    edge = m.filter(arch & (F.col("slice") == last)).select("id", F.row_number().over(W.orderBy("h", "id")).alias("place")).filter(F.col("place") <= left)
    m = m.join(edge.select("id", F.lit(True).alias("edge")), "id", "left")
    replay = arch & ((F.col("slice") < last) | F.coalesce("edge", F.lit(False)))
    moved = F.col("core_strength") + p["alpha"] * (0.2 + F.col("importance") * F.col("importance")) * F.col("working_strength") * days
    c = F.when(working, moved).when(replay, F.col("core_strength") + p["replay_boost"]).otherwise(F.col("core_strength"))
    m = m.withColumn("core_strength", c).withColumn("consolidation_count", F.col("consolidation_count") + (working | replay).cast("int"))
    c = F.when(~pinned & (working | core), F.col("core_strength") * math.exp(-p["mu2"] * days)).otherwise(F.col("core_strength"))
    w = F.when(~pinned & working, F.col("working_strength") * math.exp(-p["mu1"] * days)).otherwise(F.col("working_strength"))
    return rebalanced(m.withColumn("core_strength", c).withColumn("working_strength", w), p["promote"], p["demote"], p["archive"]).drop("h", "slice", "edge")


def _state(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return store.memories(spark, d, *STATE, *more)


def apply_decay(spark: SparkSession, d: str) -> DataFrame:
    m = decayed(_state(spark, d), 3.0, 0.15, 0.005)
    return m.select("id", F.round("working_strength", 9).alias("working_strength"), F.round("core_strength", 9).alias("core_strength"))


def rebalance_layers(spark: SparkSession, d: str) -> DataFrame:
    return rebalanced(_state(spark, d)).select("id", "layer")


def consolidate_working(spark: SparkSession, d: str) -> DataFrame:
    """One day's cycle over the working and core layers (no replay), with the layers after it."""
    m = consolidate(_state(spark, d).filter("layer <> 'archive'"))
    return m.select("id", "layer", "consolidation_count", F.round("working_strength", 9).alias("working_strength"), F.round("core_strength", 9).alias("core_strength"))


def consolidate_cycle(spark: SparkSession, d: str) -> DataFrame:
    """The whole cycle with its hash-ordered replay; summed by layer."""
    m = consolidate(_state(spark, d))
    return m.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.sum("core_strength"), 6).alias("core"), F.round(F.sum("working_strength"), 6).alias("working"))


def consolidation_stats(spark: SparkSession, d: str) -> DataFrame:
    m = _state(spark, d)
    return m.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg("working_strength"), 6).alias("avg_working"), F.round(F.avg("core_strength"), 6).alias("avg_core"), F.sum("consolidation_count").alias("consolidations"))


def downscale(spark: SparkSession, d: str) -> DataFrame:
    f = F.when(F.coalesce("pinned", F.lit(False)), 1.0).otherwise(0.95)
    return _state(spark, d).select("id", F.round(F.col("working_strength") * f, 9).alias("working_strength"), F.round(F.col("core_strength") * f, 9).alias("core_strength"))


def reward_recent(spark: SparkSession, d: str, recent: int = 50, magnitude: float = 0.15) -> DataFrame:
    """The most recently accessed memories gain strength, capped at 1."""
    last = store.accesses(spark, d).groupBy("memory_id").agg(F.max("accessed_at").alias("last_access"))
    m = _state(spark, d).join(last, F.lower("id") == F.col("memory_id"))
    top = m.orderBy(F.desc("last_access"), "id").limit(recent)
    return top.select("id", F.round(F.least(F.lit(1.0), F.col("working_strength") + magnitude), 9).alias("working_strength"))


def decay_flag(spark: SparkSession, d: str) -> DataFrame:
    """Live memories whose effective strength is below 0.1 with fewer than two accesses."""
    m = A.strengths(A.with_accesses(_state(spark, d), store.accesses(spark, d)))
    return m.filter("deleted_at is null and not coalesce(pinned, false) and effective_strength < 0.1 and n_accesses < 2").select("id", F.round("effective_strength", 6).alias("effective_strength"))


def forget_bulk(spark: SparkSession, d: str) -> DataFrame:
    """What a bulk forget would do to each memory: soft, hard or nothing; counted by namespace."""
    m = A.strengths(A.with_accesses(_state(spark, d), store.accesses(spark, d)))
    days = seconds_between(F.lit(NOW), F.col("deleted_at")) / 86400.0
    what = F.when(days > 30, "hard_delete").when(F.col("deleted_at").isNotNull(), "already_deleted").when(~F.coalesce("pinned", F.lit(False)) & (F.col("effective_strength") < 0.01), "soft_delete").otherwise("keep")
    return m.groupBy("namespace", what.alias("action")).agg(F.count("*").alias("n"))


def decay_links(spark: SparkSession, d: str) -> DataFrame:
    """Links after decay by direction (as a stand-in for the signal's source), pruned below 0.1."""
    f = F.when(F.col("direction") == "bidirectional", 0.95).when(F.col("direction") == "forward", 0.90).otherwise(0.85)
    return store.links(spark, d).withColumn("strength", F.round(F.col("strength") * f, 9)).filter("strength >= 0.1").select("link_id", "strength")


def symmetric(links: DataFrame) -> DataFrame:
    """Every link seen from both ends: (id, other, strength, namespace)."""
    a = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "strength", "namespace")
    return a.unionByName(links.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "strength", "namespace"))


def hebbian_neighbours(spark: SparkSession, d: str) -> DataFrame:
    s = symmetric(store.links(spark, d).filter("source_id <> target_id"))
    return s.groupBy("id").agg(F.countDistinct("other").alias("n_neighbours"), F.round(F.sum("strength"), 6).alias("total_strength"))


def stdp_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Links whose order of activation points one way: cause, effect, confidence."""
    fwd, bwd = F.col("temporal_forward"), F.col("temporal_backward")
    l = store.links(spark, d).filter(fwd + bwd >= 3)
    ahead, back = fwd > 2.0 * bwd, bwd > 2.0 * fwd
    l = l.filter(ahead | back)
    return l.select("link_id", F.when(ahead, F.col("source_id")).otherwise(F.col("target_id")).alias("cause"), F.when(ahead, F.col("target_id")).otherwise(F.col("source_id")).alias("effect"), F.round(F.greatest(fwd, bwd) / (fwd + bwd), 6).alias("confidence"))


def canonical_links(spark: SparkSession, d: str) -> DataFrame:
    """Links merged by unordered pair and namespace: strongest strength, summed counts."""
    l = store.links(spark, d)
    return l.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "namespace").agg(F.max("strength").alias("strength"), F.sum("coactivation_count").alias("coactivations"), F.count("*").alias("n_links"))


def cross_namespace_links(spark: SparkSession, d: str) -> DataFrame:
    ns = lambda p: store.memories(spark, d).select(F.lower("id").alias(f"{p}_id"), F.col("namespace").alias(f"{p}_ns"))
    l = store.links(spark, d).join(ns("s"), F.col("source_id") == F.col("s_id")).join(ns("t"), F.col("target_id") == F.col("t_id"))
    return l.filter("s_ns <> t_ns").select("link_id", "source_id", "target_id", "s_ns", "t_ns", "strength")


def co_recall_30s(spark: SparkSession, d: str, seconds: int = 30) -> DataFrame:
    """Pairs of different memories accessed within 30 seconds, and how often.

    An interval join by time buckets: each access meets those of its own and the
    next bucket only, so the join is an equi-join on bounded buckets.
    """
    a = store.accesses(spark, d).select("access_id", "memory_id", F.unix_micros(F.col("accessed_at").cast("timestamp")).alias("us"))
    width = seconds * 1_000_000
    a = a.withColumn("bucket", F.floor(F.col("us") / width))
    b = a.select(F.col("access_id").alias("id2"), F.col("memory_id").alias("m2"), F.col("us").alias("us2"), F.explode(F.array("bucket", F.col("bucket") - 1)).alias("bucket"))
    p = a.join(b, "bucket").filter((F.col("us2") >= F.col("us")) & (F.col("us2") - F.col("us") <= width) & (F.col("access_id") != F.col("id2")) & (F.col("memory_id") != F.col("m2")))
    p = p.filter((F.col("us2") > F.col("us")) | (F.col("access_id") < F.col("id2")))
    return p.groupBy(F.least("memory_id", "m2").alias("a"), F.greatest("memory_id", "m2").alias("b")).agg(F.count("*").alias("n"))


def orphan_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a rebalance would remove: references from accesses, links and mentions to nothing."""
    m = store.memories(spark, d).select(F.lower("id").alias("k"))
    e = store.entities(spark, d).select(F.lower("id").alias("k"))
    gone = lambda df, c, p: df.join(p, F.col(c) == F.col("k"), "left_anti").agg(F.count("*").alias("n"))
    l, me = store.links(spark, d), store.mentions(spark, d)
    parts = [
        gone(store.accesses(spark, d), "memory_id", m).withColumn("kind", F.lit("access_log")),
        gone(l, "source_id", m).withColumn("kind", F.lit("link_source")),
        gone(l, "target_id", m).withColumn("kind", F.lit("link_target")),
        gone(me, "memory_id", m).withColumn("kind", F.lit("mention_memory")),
        gone(me, "entity_id", e).withColumn("kind", F.lit("mention_entity")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "n")


def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts and averages by type and by layer in one pass (grouping sets)."""
    m = _state(spark, d)
    m.createOrReplaceTempView("palimpsest_memory_stats")
    return spark.sql("select coalesce(memory_type, '*') as memory_type, coalesce(layer, '*') as layer, count(*) as n, round(avg(working_strength), 6) as avg_working, round(avg(core_strength), 6) as avg_core, round(avg(importance), 6) as avg_importance, sum(cast(pinned as int)) as n_pinned from palimpsest_memory_stats group by grouping sets ((memory_type), (layer), ())")


def memory_stats_ns(spark: SparkSession, d: str) -> DataFrame:
    m = _state(spark, d)
    return m.groupBy("namespace").agg(F.count("*").alias("n"), F.sum(F.col("pinned").cast("int")).alias("n_pinned"), F.sum(F.col("deleted_at").isNotNull().cast("int")).alias("n_deleted"), F.date_format(F.min("event_time"), "yyyy-MM-dd HH:mm:ss").alias("first_event"), F.date_format(F.max("event_time"), "yyyy-MM-dd HH:mm:ss").alias("last_event"))


def health(spark: SparkSession, d: str) -> DataFrame:
    """Per namespace: total, live, orphans (no link, no entity), below the forget threshold, superseded."""
    m = A.strengths(A.with_accesses(_state(spark, d), store.accesses(spark, d)))
    tied = symmetric(store.links(spark, d)).select(F.col("id").alias("k")).unionByName(store.mentions(spark, d).select(F.col("memory_id").alias("k"))).distinct().withColumn("tied", F.lit(True))
    m = m.join(tied, F.lower("id") == F.col("k"), "left")
    count = lambda c: F.sum(c.cast("int"))
    return m.groupBy("namespace").agg(
        F.count("*").alias("n_total"), count(F.col("deleted_at").isNull()).alias("n_live"), count(F.col("tied").isNull()).alias("n_orphans"),
        count(F.col("effective_strength") < 0.01).alias("n_below"), count(F.coalesce("superseded_by", F.lit("")) != "").alias("n_superseded"),
    )


def recall_recent(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    """The newest memories of each namespace that are live and not superseded."""
    m = _state(spark, d).filter("deleted_at is null and coalesce(superseded_by, '') = ''")
    r = F.row_number().over(W.partitionBy("namespace").orderBy(F.desc("created"), "id"))
    return m.withColumn("r", r).filter(F.col("r") <= n).select("namespace", F.col("r").cast("bigint").alias("rank"), "id")


def recall_causal(spark: SparkSession, d: str, n: int = 50) -> DataFrame:
    """Causal memories by importance."""
    m = _state(spark, d).filter("memory_type = 'causal' and deleted_at is null and coalesce(superseded_by, '') = ''")
    return m.orderBy(F.desc("importance"), "id").limit(n).select("id", "importance")


def superseded_chains(spark: SparkSession, d: str, depth: int = 16) -> DataFrame:
    """Superseded memories with the head of their chain; a chain that runs in a circle or beyond ``depth`` has no head.

    Pointer doubling: every round halves what is left of the chains.
    """
    m = _state(spark, d).select(F.lower("id").alias("id"), F.when(F.trim("superseded_by") != "", F.lower(F.trim("superseded_by"))).alias("next"))
    known = m.select(F.col("id").alias("k"))
    at = checkpoint(m.filter("next is not null").join(known, F.col("next") == F.col("k"), "left_semi").select("id", "next"))
    first = at
    rounds = max(1, (depth - 1).bit_length())
    for _ in range(rounds):
        nxt = at.select(F.col("id").alias("i2"), F.col("next").alias("n2"))
        new = checkpoint(at.join(nxt, F.col("next") == F.col("i2"), "left").select("id", F.coalesce("n2", "next").alias("next")))
        at = new
    loops = at.select(F.col("id").alias("li"))  # a head has no next of its own
    out = at.join(loops, F.col("next") == F.col("li"), "left").select("id", F.when(F.col("li").isNull(), F.col("next")).alias("head"))
    return first.join(out, "id").select("id", F.col("next").alias("superseded_by"), "head")


def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "memory_embeddings")
    return e.groupBy("model").agg(F.count("*").alias("n_rows"), F.countDistinct("memory_id").alias("n_memories"), F.sum((F.col("embedding").isNull() | (F.size("embedding") != F.col("dimension"))).cast("int")).alias("n_unusable"))


def memories_without_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "memory_embeddings").filter("embedding is not null").select(norm_key("memory_id").alias("k"))
    m = store.memories(spark, d)
    return m.join(e, F.lower("id") == F.col("k"), "left_anti").groupBy("namespace").agg(F.count("*").alias("n"))


def promotion_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Components over strong links among strong memories: size, span and mean importance, if they may be promoted."""
    from palimpsest.operators.components import connected_components

    m = _state(spark, d).filter("core_strength > 0.4").select(F.lower("id").alias("id"), "importance", "created")
    k = m.select(F.col("id").alias("k"))
    l = store.links(spark, d).filter("strength > 0.3")
    l = l.join(k, F.col("source_id") == F.col("k"), "left_semi").join(k, F.col("target_id") == F.col("k"), "left_semi")
    comp = connected_components(l, "source_id", "target_id")
    c = m.join(comp, F.col("id") == F.col("node"))
    g = c.groupBy("component").agg(F.count("*").alias("n"), (seconds_between(F.max("created"), F.min("created")) / 86400.0).alias("span_days"), F.avg("importance").alias("avg_importance"))
    return g.filter("n >= 3 and span_days >= 2 and avg_importance >= 0.3").select("component", "n", F.round("span_days", 6).alias("span_days"), F.round("avg_importance", 6).alias("avg_importance"))


def induced_forgetting(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the most important memory of each type weakens others of its type that share over 0.1 of their words."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("content", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    m = _state(spark, d, "content").filter("content is not null").withColumn("words", words)
    best = m.groupBy("memory_type").agg(F.max_by(F.struct("id", "words"), F.struct(F.col("importance"), F.col("id"))).alias("b"))
    x = m.join(F.broadcast(best.select(F.col("memory_type").alias("t"), F.col("b.id").alias("recalled"), F.col("b.words").alias("rw"))), (F.col("memory_type") == F.col("t")) & (F.col("id") != F.col("recalled")))
    x = x.withColumn("overlap", S.jaccard(F.col("words"), F.col("rw"))).filter("overlap > 0.1")
    return x.select("recalled", "id", F.round("overlap", 9).alias("overlap"), F.round(F.col("working_strength") * (1 - 0.05 * F.col("overlap")), 9).alias("working_strength"))


def sleep_cycle(spark: SparkSession, d: str) -> DataFrame:
    """The phases of a night with the rows that each touches."""
    m = _state(spark, d)
    phases = [
        m.filter("layer = 'working'").agg(F.count("*").alias("n")).withColumn("phase", F.lit("1 consolidate")),
        decay_flag(spark, d).agg(F.count("*").alias("n")).withColumn("phase", F.lit("2 decay_flag")),
        forget_bulk(spark, d).filter("action in ('soft_delete', 'hard_delete')").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("phase", F.lit("3 forget")),
        orphan_cleanup(spark, d).agg(F.sum("n").alias("n")).withColumn("phase", F.lit("4 rebalance")),
    ]
    out = phases[0]
    for p in phases[1:]:
        out = out.unionByName(p)
    return out.select("phase", "n")


QUERIES = {
    f.__name__: f
    for f in (
        apply_decay, rebalance_layers, consolidate_working, consolidate_cycle, consolidation_stats, downscale, reward_recent, decay_flag, forget_bulk, decay_links, hebbian_neighbours,
        stdp_candidates, canonical_links, cross_namespace_links, co_recall_30s, orphan_cleanup, memory_stats, memory_stats_ns, health, recall_recent, recall_causal, superseded_chains,
        embedding_stats, memories_without_embeddings, promotion_clusters, induced_forgetting, sleep_cycle,
    )
}

_P = "coalesce(pinned, false)"
_LAYER = "case when pinned then 'core' when layer <> 'core' and core_strength >= 0.25 then 'core' when layer = 'working' and working_strength < 0.15 and core_strength < 0.15 then 'archive' when layer = 'core' and core_strength + working_strength < 0.05 then 'archive' else layer end"
_sym = "sym as (select source_id as id, target_id as other, strength, namespace from hl union all select target_id, source_id, strength, namespace from hl)"
_FLAG = "from s where deleted_at is null and not coalesce(pinned, false) and effective_strength < 0.1 and n_accesses < 2"
_ACTION = f"case when (epoch_us(now) // 1000000 - epoch_us(deleted_at) // 1000000) / 86400.0::double > 30 then 'hard_delete' when deleted_at is not null then 'already_deleted' when not {_P} and effective_strength < 0.01 then 'soft_delete' else 'keep' end"
_GONE = "select 'access_log' as kind, count(*) as n from acc where memory_id not in (select lower(id) from m) union all select 'link_source', count(*) from hl where source_id not in (select lower(id) from m) union all select 'link_target', count(*) from hl where target_id not in (select lower(id) from m) union all select 'mention_memory', count(*) from me where memory_id not in (select lower(id) from m) union all select 'mention_entity', count(*) from me where entity_id not in (select lower(id) from en)"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))"
SQL = {
    "apply_decay": sql(f"select id, round(case when {_P} then working_strength else working_strength * exp(-0.15::double * 3) end, 9) as working_strength, round(case when {_P} then core_strength else core_strength * exp(-0.005::double * 3) end, 9) as core_strength from m"),
    "rebalance_layers": sql(f"select id, {_LAYER} as layer from m"),
    "consolidate_working": sql("") + f""", t as (select *, case when layer = 'working' then core_strength + 0.08::double * (0.2::double + importance * importance) * working_strength else core_strength end as c1 from m where layer <> 'archive'),
      u as (select * replace (case when {_P} then c1 else c1 * exp(-0.005::double) end as core_strength, case when {_P} or layer <> 'working' then working_strength else working_strength * exp(-0.15::double) end as working_strength, consolidation_count + (layer = 'working')::int as consolidation_count) from t)
      select id, {_LAYER} as layer, consolidation_count, round(working_strength, 9) as working_strength, round(core_strength, 9) as core_strength from u""",
    "consolidation_stats": sql("select layer, count(*) as n, round(avg(working_strength), 6) as avg_working, round(avg(core_strength), 6) as avg_core, sum(consolidation_count)::bigint as consolidations from m group by 1"),
    "downscale": sql(f"select id, round(working_strength * (case when {_P} then 1.0::double else 0.95::double end), 9) as working_strength, round(core_strength * (case when {_P} then 1.0::double else 0.95::double end), 9) as core_strength from m"),
    "reward_recent": sql("") + ", la as (select memory_id, max(accessed_at) as last_access from acc group by 1) select id, round(least(1.0::double, working_strength + 0.15::double), 9) as working_strength from m join la on lower(id) = memory_id order by last_access desc, id limit 50",
    "decay_flag": sql("") + f", {A.STRENGTH} select id, round(effective_strength, 6) as effective_strength {_FLAG}",
    "forget_bulk": sql("") + f", {A.STRENGTH} select namespace, {_ACTION} as action, count(*) as n from s, now_ group by 1, 2",
    "decay_links": sql("") + ", x as (select link_id, round(strength * (case direction when 'bidirectional' then 0.95::double when 'forward' then 0.90::double else 0.85::double end), 9) as strength from hl) select * from x where strength >= 0.1",
    "hebbian_neighbours": sql("") + f", {_sym} select id, count(distinct other) as n_neighbours, round(sum(strength), 6) as total_strength from sym where id <> other group by 1",
    "stdp_candidates": sql("select link_id, case when temporal_forward > 2.0 * temporal_backward then source_id else target_id end as cause, case when temporal_forward > 2.0 * temporal_backward then target_id else source_id end as effect, round(greatest(temporal_forward, temporal_backward) / (temporal_forward + temporal_backward), 6) as confidence from hl where temporal_forward + temporal_backward >= 3 and (temporal_forward > 2.0 * temporal_backward or temporal_backward > 2.0 * temporal_forward)"),
    "canonical_links": sql("select least(source_id, target_id) as a, greatest(source_id, target_id) as b, namespace, max(strength) as strength, sum(coactivation_count)::bigint as coactivations, count(*) as n_links from hl group by 1, 2, 3"),
    "cross_namespace_links": sql("select link_id, source_id, target_id, s.namespace as s_ns, t.namespace as t_ns, strength from hl join m s on source_id = lower(s.id) join m t on target_id = lower(t.id) where s.namespace <> t.namespace"),
    "co_recall_30s": sql("select least(a.memory_id, b.memory_id) as a, greatest(a.memory_id, b.memory_id) as b, count(*) as n from acc a join acc b on a.memory_id <> b.memory_id and b.accessed_at between a.accessed_at and a.accessed_at + interval 30 seconds and (b.accessed_at > a.accessed_at or a.access_id < b.access_id) group by 1, 2"),
    "orphan_cleanup": sql(_GONE),
    "memory_stats": sql("select coalesce(memory_type, '*') as memory_type, coalesce(layer, '*') as layer, count(*) as n, round(avg(working_strength), 6) as avg_working, round(avg(core_strength), 6) as avg_core, round(avg(importance), 6) as avg_importance, sum(pinned::int)::bigint as n_pinned from m group by grouping sets ((memory_type), (layer), ())"),
    "memory_stats_ns": sql("select namespace, count(*) as n, sum(pinned::int)::bigint as n_pinned, count(deleted_at) as n_deleted, strftime(min(event_time), '%Y-%m-%d %H:%M:%S') as first_event, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') as last_event from m group by 1"),
    "health": sql("") + f", {A.STRENGTH}, {_sym}, tied as (select id as k from sym union select memory_id from me) select namespace, count(*) as n_total, count(*) filter (deleted_at is null) as n_live, count(*) filter (lower(id) not in (select k from tied)) as n_orphans, count(*) filter (effective_strength < 0.01) as n_below, count(*) filter (coalesce(superseded_by, '') <> '') as n_superseded from s group by 1",
    "recall_recent": sql("select namespace, rank, id from (select namespace, id, row_number() over (partition by namespace order by created desc, id) as rank from m where deleted_at is null and coalesce(superseded_by, '') = '') where rank <= 20"),
    "recall_causal": sql("select id, importance from m where memory_type = 'causal' and deleted_at is null and coalesce(superseded_by, '') = '' order by importance desc, id limit 50"),
    "superseded_chains": ("with recursive " + sql("")[5:]) + """, ch as (select lower(id) as id, lower(trim(superseded_by)) as nx from m where trim(superseded_by) <> '' and lower(trim(superseded_by)) in (select lower(id) from m)),
      walk as (select id, nx as cur, 1 as n from ch union all select walk.id, ch.nx, n + 1 from walk join ch on walk.cur = ch.id where n < 20),
      heads as (select id, max(cur) as head from walk where cur not in (select id from ch) group by 1)
      select ch.id, ch.nx as superseded_by, head from ch left join heads using (id)""",
    "embedding_stats": "select model, count(*) as n_rows, count(distinct memory_id) as n_memories, count(*) filter (embedding is null or len(embedding) <> dimension) as n_unusable from memory_embeddings group by 1",
    "memories_without_embeddings": sql("select namespace, count(*) as n from m where lower(id) not in (select lower(trim(memory_id)) from memory_embeddings where embedding is not null and memory_id is not null) group by 1"),
    "induced_forgetting": sql("") + f""", w as (select *, {_WORDS} as words from m where content is not null), best as (select memory_type as t, arg_max(struct_pack(id := id, words := words), row(importance, id)) as b from w group by 1),
      x as (select b.id as recalled, w.id, working_strength, len(list_intersect(words, b.words)) as i, len(words) + len(b.words) - len(list_intersect(words, b.words)) as u from w join best on memory_type = t and w.id <> b.id)
      select recalled, id, round(i / u, 9) as overlap, round(working_strength * (1 - 0.05::double * (i / u)), 9) as working_strength from x where u > 0 and i / u > 0.1""",
    "sleep_cycle": sql("") + f", {A.STRENGTH}, gone as ({_GONE}) select '1 consolidate' as phase, count(*) as n from m where layer = 'working' union all select '2 decay_flag', count(*) {_FLAG} union all select '3 forget', count(*) from s, now_ where {_ACTION} in ('soft_delete', 'hard_delete') union all select '4 rebalance', sum(n)::bigint from gone",
}
