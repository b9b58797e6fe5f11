"""The knowledge graph: bi-temporal edges, traversal, entity lookup and resolution signals, edge decisions, PageRank."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import scoring as S
from palimpsest.functions.common import checkpoint, ns, release, table
from palimpsest.operators.components import connected_components
from palimpsest.sources import store
from palimpsest.sources.store import NOW, seconds_between, sql

#: Predicate, cardinality, symmetric.
PREDICATES = [
    ("works_at", "one_to_one", False), ("married_to", "one_to_one", True), ("preceded_by", "one_to_one", False), ("created_by", "one_to_one", False), ("occurred_on", "one_to_one", False),
    ("member_of", "one_to_many", False), ("parent_of", "one_to_many", False), ("uses", "one_to_many", False), ("leads_to", "one_to_many", False),
    ("related_to", "many_to_many", True), ("contradicts", "many_to_many", True), ("caused_by", "many_to_many", False), ("depends_on", "many_to_many", False), ("part_of", "many_to_many", False),
]


def cardinality(predicate: Column) -> Column:
    """Of a predicate; one that is not canonical is many to many."""
    out = F.lit("many_to_many")
    for name, card, _ in PREDICATES:
        out = F.when(predicate == name, card).otherwise(out)
    return out


def temporal_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer-part edges of the orders: valid time from shipping, transaction time from ordering.

    In a slot (subject, predicate, object) each edge is valid up to the next
    one's start and known up to the next one's recording.
    """
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_discount")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    e = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("o_custkey").alias("subject"),
        F.when(F.col("l_returnflag") == "R", "contradicts").when(F.col("l_returnflag") == "A", "uses").otherwise("related_to").alias("predicate"),
        F.pmod("l_partkey", F.lit(50)).alias("object"), F.col("l_shipdate").alias("valid_from"), F.col("o_orderdate").alias("recorded_at"), (1 - F.col("l_discount")).alias("confidence"),
    )
    slot = W.partitionBy("subject", "predicate", "object")
    return e.withColumn("valid_to", F.lead("valid_from").over(slot.orderBy("valid_from", "id"))).withColumn("invalidated_at", F.lead("recorded_at").over(slot.orderBy("recorded_at", "id")))


def live_at(at: datetime.datetime) -> Column:
    return F.col("invalidated_at").isNull() | (F.col("invalidated_at") > F.lit(at))


def valid_at(at: datetime.datetime) -> Column:
    """Half-open: from <= at < to; an open end is null."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= F.lit(at))) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(at)))


AT = datetime.datetime(1996, 1, 1)
AT_SQL = "timestamp '1996-01-01 00:00:00'"


def edges_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = temporal_edges(spark, d).filter((F.col("recorded_at") <= F.lit(AT)) & live_at(AT) & valid_at(AT))
    return e.select("id", "subject", "predicate", "object")


def live_edges(spark: SparkSession, d: str) -> DataFrame:
    e = temporal_edges(spark, d).filter(live_at(NOW))
    return e.groupBy("predicate").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_subjects"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def edges_with_superseded(spark: SparkSession, d: str) -> DataFrame:
    """All edges of every subject, annotated: live, superseded, or not yet known at the time."""
    e = temporal_edges(spark, d)
    state = F.when(F.col("recorded_at") > F.lit(AT), "unknown_then").when(live_at(AT), "live").otherwise("superseded")
    return e.groupBy("predicate", state.alias("state")).agg(F.count("*").alias("n"))


def invalid_edges(spark: SparkSession, d: str) -> DataFrame:
    """Constraint check: valid range the wrong way round, or invalidated before it was recorded."""
    e = temporal_edges(spark, d)
    bad = F.when(F.col("valid_to") < F.col("valid_from"), "valid_range").when(F.col("invalidated_at") < F.col("recorded_at"), "transaction_range").when(F.col("confidence").isNull() | F.isnan("confidence"), "confidence").otherwise("ok")
    return e.groupBy(bad.alias("result")).agg(F.count("*").alias("n"))


def edge_decision(spark: SparkSession, d: str) -> DataFrame:
    """What each new relation does to the live one before it in its slot, by the predicate's cardinality."""
    r = store.relations(spark, d).filter("created_at is not null")
    card = cardinality(F.col("relation"))
    slot = F.when(card == "one_to_one", F.lit("")).otherwise(F.col("target_id"))
    w = W.partitionBy("source_id", "relation", "slot").orderBy("created_at", "id")
    x = r.withColumn("slot", slot).withColumn("p_target", F.lag("target_id").over(w)).withColumn("p_conf", F.lag("confidence").over(w))
    decision = F.when(F.col("p_target").isNull(), "add").when((F.col("p_target") == F.col("target_id")) & (F.col("confidence") <= F.col("p_conf") + 0.05), "none").when((F.col("p_target") != F.col("target_id")) & (F.col("confidence") + 0.05 < F.col("p_conf")), "defer").otherwise("update")
    return x.select("id", "relation", decision.alias("decision"))


def undirected(r: DataFrame) -> DataFrame:
    """Distinct undirected edges without loops, seen from both ends: (x, y)."""
    a = r.select(F.col("source_id").alias("x"), F.col("target_id").alias("y"))
    return a.unionByName(a.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct()


def neighbours_khop(spark: SparkSession, d: str, depth: int = 3, kind: str = "organization") -> DataFrame:
    """Entities within ``depth`` relations of any entity of a kind, with their distance. Each level only expands what is new."""
    adj = undirected(store.relations(spark, d))
    seen = checkpoint(store.entities(spark, d).filter(F.col("entity_type") == kind).select(F.lower("id").alias("id"), F.lit(0).alias("distance")))
    front = seen.select("id")
    for level in range(1, depth + 1):
        step = adj.join(front, F.col("x") == F.col("id"), "left_semi").select(F.col("y").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        step = checkpoint(step.withColumn("distance", F.lit(level)))
        seen, front = seen.unionByName(step), step.select("id")
    return seen.select("id", F.col("distance").cast("bigint").alias("distance"), F.round(F.pow(F.lit(0.5), F.col("distance")), 6).alias("graph_score"))


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6, together: int = 10) -> DataFrame:
    """(id, score) by power iteration to an L1 change of ``tolerance``, at most ``rounds``; mass of ends without edges returns to the seeds.

    ``edges``: x, y both ways; ``seeds``: id. Where no edge leads to an end, only
    seeds without edges lose mass, and how much is known beforehand: then
    ``together`` rounds run as one job, after which the change is looked at.
    """
    edges = checkpoint(edges)
    degree = checkpoint(edges.groupBy("x").agg(F.count("*").alias("deg")))
    seeds = checkpoint(seeds.distinct())
    n = seeds.count()
    if not n:
        return seeds.select("id", F.lit(0.0).alias("score")).limit(0)
    base = seeds.select("id", F.lit(1.0 / n).alias("seed"))
    flows = checkpoint(edges.join(degree, "x"))
    known = edges.join(degree, edges["y"] == degree["x"], "left_anti").isEmpty()
    alone = seeds.join(degree, F.col("id") == F.col("x"), "left_anti").count() / n
    together = together if known else 1
    rank, written, lost = base.select("id", F.col("seed").alias("score")), None, alone
    for done in range(0, rounds, together):
        old = new = rank
        for _ in range(min(together, rounds - done)):
            if not known:
                lost = old.join(degree, F.col("id") == F.col("x"), "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
            old = new
            flow = new.join(flows, F.col("id") == F.col("x")).groupBy(F.col("y").alias("id")).agg(F.sum(F.col("score") / F.col("deg")).alias("f"))
            back = damping * lost + (1 - damping)
            new = flow.join(base, "id", "full").select("id", (damping * F.coalesce("f", F.lit(0.0)) + back * F.coalesce("seed", F.lit(0.0))).alias("score"))
            lost = alone * back
        both = checkpoint(new.join(old.withColumnRenamed("score", "old"), "id", "full"))
        if written is not None:
            release(written)
        written, rank = both, both.filter("score is not null").select("id", "score")
        if both.agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] < tolerance:
            break
    return rank


def ppr(spark: SparkSession, d: str) -> DataFrame:
    adj = undirected(store.relations(spark, d))
    seeds = store.entities(spark, d).filter("entity_type = 'project'").select(F.lower("id").alias("id"))
    return personalized_pagerank(adj, seeds).select("id", F.round("score", 8).alias("score"))


def relation_components(spark: SparkSession, d: str) -> DataFrame:
    c = connected_components(store.relations(spark, d), "source_id", "target_id")
    return c.select(F.col("node").alias("id"), "component")


def resolve_alias(spark: SparkSession, d: str) -> DataFrame:
    """Normalised aliases that name an entity of their namespace: 0.7 + 0.3 by how lately it was seen."""
    e = store.entities(spark, d).select(F.col("id").alias("entity_id"), F.col("namespace").alias("ens"), F.lower(F.trim("name")).alias("n"), F.coalesce("last_seen", "first_seen").alias("seen"))
    a = table(spark, d, "graph_entity_aliases").select("alias_id", ns().alias("ans"), F.lower(F.trim("alias")).alias("n2"))
    x = a.join(e, (F.col("ans") == F.col("ens")) & (F.col("n2") == F.col("n")))
    w = W.partitionBy("alias_id")
    lo, hi, s = F.min(F.unix_seconds(F.col("seen").cast("timestamp"))).over(w), F.max(F.unix_seconds(F.col("seen").cast("timestamp"))).over(w), F.unix_seconds(F.col("seen").cast("timestamp"))
    share = F.when(hi > lo, (s - lo) / (hi - lo)).otherwise(1.0)
    return x.select("alias_id", "entity_id", F.round(0.7 + 0.3 * F.coalesce(share, F.lit(0.0)), 6).alias("score"))


def canonical_entity_ids(spark: SparkSession, d: str) -> DataFrame:
    e = store.entities(spark, d)
    return e.select("id", F.substring(F.sha2(F.concat(F.lower(F.trim("name")), F.lit("|"), F.col("namespace")), 256), 1, 32).alias("canonical_id"))


def entity_stats(spark: SparkSession, d: str) -> DataFrame:
    parts = [store.entities(spark, d), store.relations(spark, d), store.mentions(spark, d)]
    out = None
    for name, p in zip(("entities", "relations", "mentions"), parts):
        c = p.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def list_entities(spark: SparkSession, d: str) -> DataFrame:
    """Live entities with their number of mentions, the 100 most mentioned."""
    n = store.mentions(spark, d).groupBy("entity_id").agg(F.count("*").alias("n_mentions"), F.countDistinct("memory_id").alias("n_memories"))
    e = store.entities(spark, d).filter("deleted_at is null").join(n, F.lower("id") == F.col("entity_id"))
    return e.orderBy(F.desc("n_mentions"), "id").limit(100).select("id", "entity_type", "n_mentions", "n_memories")


def purge_garbage_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities to delete: persons with a name of at most two characters or only digits, and those without a mention."""
    m = store.mentions(spark, d).select("entity_id").distinct()
    e = store.entities(spark, d).join(m, F.lower("id") == F.col("entity_id"), "left")
    name = F.trim("name")
    bad = (F.col("entity_type") == "person") & ((F.length(name) <= 2) | name.rlike(r"^\d+$"))
    why = F.when(bad, "garbage_name").when(F.col("entity_id").isNull(), "no_mention")
    return e.withColumn("why", why).filter("why is not null").groupBy("entity_type", "why").agg(F.count("*").alias("n"))


def role_edges(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by role, as edges of the polymorphic store (role to predicate)."""
    p = F.when(F.col("role") == "subject", "subject_of").when(F.col("role") == "author", "created_by").when(F.col("role") == "object", "object_of").otherwise("mentions")
    return store.mentions(spark, d).groupBy(p.alias("predicate")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two strings by common characters, swaps and a common prefix of up to four."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Weights of the resolution signals, of which the present ones are scaled to one, and the scores from which a pair is merged or deferred.
NAME, TYPE, RECENCY, TOGETHER = 0.6, 0.2, 0.2, 0.2
MERGE, DEFER = 0.85, 0.60
#: Entities of a namespace in one block, and pairs compared at once.
NAME_BLOCK, NAME_PAIRS = 512, 1 << 13


def jaro_winkler_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``jaro_winkler`` of each two rows of code points, padded with zeros."""
    la, lb = (a > 0).sum(1), (b > 0).sum(1)
    reach = (np.maximum(la, lb) // 2 - 1).astype(np.int32)
    rows, place = np.arange(len(a)), np.arange(b.shape[1], dtype=np.int32)
    free, hit = b > 0, np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        can = b == a[:, i, None]
        can &= free
        can &= np.abs(place - i) <= reach[:, None]
        first = can.argmax(1)
        hit[:, i] = can[rows, first]
        free[rows, first] &= ~hit[:, i]
    used = (b > 0) & ~free
    m = hit.sum(1)
    width = min(a.shape[1], b.shape[1])
    left = np.take_along_axis(a, np.argsort(~hit, 1, kind="stable"), 1)[:, :width]
    right = np.take_along_axis(b, np.argsort(~used, 1, kind="stable"), 1)[:, :width]
    swaps = ((left != right) & (np.arange(width) < m[:, None])).sum(1) / 2
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - swaps) / np.maximum(m, 1)) / 3, 0.0)
    same = (a[:, :width] == b[:, :width]) & (a[:, :width] > 0)
    prefix = np.logical_and.accumulate(same[:, :4], 1).sum(1)
    equal = (la == lb) & (same.sum(1) == la)
    return np.where(equal, 1.0, np.where(m > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0))


@F.pandas_udf(T.DoubleType())
def name_match(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    chars = name_codes(a.tolist() + b.tolist())
    at = range(0, len(a), NAME_PAIRS)
    return pd.Series(np.concatenate([jaro_winkler_pairs(chars[: len(a)][i : i + NAME_PAIRS], chars[len(a) :][i : i + NAME_PAIRS]) for i in at]))


def name_codes(names: list[str]) -> np.ndarray:
    """Small codes of the characters, a row a name, padded with zeros."""
    points = np.array(names, dtype=str).view(np.uint32).reshape(len(names), -1)
    known = np.unique(np.append(points, np.uint32(0)))
    return np.searchsorted(known, points).astype(np.uint8 if len(known) < 256 else np.uint32)


def jaro_winkler_bound(common: np.ndarray, la: np.ndarray, lb: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The most that two names can reach whose letters have so many in common, wherever they stand."""
    jaro = np.where(common > 0, (common / la + common / lb + 1) / 3, 0.0)
    return jaro + prefix * 0.1 * (1 - jaro)


def alike_in_block(x: pd.DataFrame) -> pd.DataFrame:
    """Pairs (id, id2) of two blocks of a namespace that reach ``DEFER`` by name, type and recency; names are compared only where they can."""
    chars = name_codes(x["n"].tolist())
    length = (chars > 0).sum(1)
    letters = np.stack([(chars == k).sum(1) for k in range(1, int(chars.max()) + 1)], 1).astype(np.uint16 if chars.shape[1] > 255 else np.uint8)
    start = chars[:, :4] if chars.shape[1] >= 4 else np.pad(chars, ((0, 0), (0, 4 - chars.shape[1])))
    low, high = np.flatnonzero(~x["right"].to_numpy(bool)), np.flatnonzero(x["right"].to_numpy(bool))
    ids, kind = x["id"].to_numpy(str), x["entity_type"].fillna("").to_numpy(str)
    seen = x["seen"].to_numpy("float64")
    out = []
    step = max(1, NAME_PAIRS // max(1, len(high)))
    same_block = x["i"].iloc[0] == x["j"].iloc[0]
    for at in range(0, len(low), step):
        l, r = (g.ravel() for g in np.meshgrid(low[at : at + step], high, indexing="ij"))
        if same_block:
            keep = ids[l] < ids[r]
            l, r = l[keep], r[keep]
        typed = (kind[l] != "") & (kind[r] != "")
        recency = np.exp2(-np.abs(seen[l] - seen[r]) / 86400.0 / 30)
        known = ~np.isnan(recency)
        rest = TYPE * (typed & (kind[l] == kind[r])) + RECENCY * np.where(known, recency, 0.0)
        need = (DEFER - 1e-6) * (NAME + TYPE * typed + RECENCY * known) - rest
        can = need <= NAME
        l, r, need = l[can], r[can], need[can]
        prefix = np.logical_and.accumulate((start[l] == start[r]) & (start[l] > 0), 1).sum(1)
        can = NAME * jaro_winkler_bound(np.minimum(letters[l], letters[r]).sum(1), length[l], length[r], prefix) >= need
        l, r, need = l[can], r[can], need[can]
        ok = NAME * jaro_winkler_pairs(chars[l], chars[r]) >= need
        out.append(pd.DataFrame({"id": ids[l[ok]], "id2": ids[r[ok]]}))
    p = pd.concat(out) if out else pd.DataFrame({"id": [], "id2": []}, dtype=object)
    swap = p["id"] > p["id2"]
    return pd.DataFrame({"id": p["id"].where(~swap, p["id2"]), "id2": p["id2"].where(~swap, p["id"])})


def resolution_candidates(e: DataFrame, together: DataFrame) -> DataFrame:
    """(id, id2) of one namespace: all that can be merged or deferred, all in one memory, and all with six first letters of a word in common."""
    count = e.groupBy("namespace").agg(F.ceil(F.count("*") / NAME_BLOCK).cast("int").alias("blocks"))
    x = e.join(F.broadcast(count), "namespace").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    x = x.select("namespace", "blocks", "k", "id", "n", "entity_type", F.unix_seconds(F.col("seen").cast("timestamp")).cast("double").alias("seen"))
    rest = ["id", "n", "entity_type", "seen"]
    low = x.select("namespace", F.col("k").alias("i"), F.explode(F.sequence("k", F.col("blocks") - 1)).alias("j"), F.lit(False).alias("right"), *rest)
    high = x.select("namespace", F.explode(F.sequence(F.lit(0), "k")).alias("i"), F.col("k").alias("j"), F.lit(True).alias("right"), *rest)
    alike = low.unionByName(high).groupBy("namespace", "i", "j").applyInPandas(alike_in_block, "id string, id2 string")
    block = e.withColumn("b", F.explode(F.array_distinct(F.transform(F.filter(F.split("n", r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 6), lambda w: F.substring(w, 1, 6)))))
    words = block.join(block.select("namespace", "b", F.col("id").alias("id2")), ["namespace", "b"]).filter("id < id2")
    return alike.unionByName(words.select("id", "id2")).unionByName(together.select("id", "id2")).distinct()


def mentioned_together(e: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, id2, together): entities of one namespace in the same memories, by the share of the rarer one's memories."""
    me = mentions.select("memory_id", "entity_id").distinct().join(e.select("id", "namespace"), F.col("entity_id") == F.lower("id")).select("memory_id", "id", "namespace")
    n = me.groupBy("id").agg(F.count("*").alias("n"))
    both = me.join(me.select("memory_id", "namespace", F.col("id").alias("id2")), ["memory_id", "namespace"]).filter("id < id2").groupBy("id", "id2").agg(F.count("*").alias("both"))
    both = both.join(n, "id").join(n.select(F.col("id").alias("id2"), F.col("n").alias("n2")), "id2")
    return both.select("id", "id2", (F.col("both") / F.least("n", "n2")).alias("together"))


def resolution_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entities of a namespace: fused signals and the decision to merge, defer or keep apart.

    Signals: name, type, recency, co-mention; one that is missing leaves the
    weights of the others. All pairs that reach a merge or a deferral are
    found, since every two entities of a namespace meet; those kept apart are
    listed where a memory mentions both or a word begins alike.
    """
    e = store.entities(spark, d).filter("name is not null and trim(name) <> ''").select("id", "namespace", "entity_type", F.lower(F.trim("name")).alias("n"), F.coalesce("last_seen", "first_seen").alias("seen"))
    e = checkpoint(e)
    together = checkpoint(mentioned_together(e, store.mentions(spark, d)))
    p = resolution_candidates(e, together).join(together, ["id", "id2"], "left").join(e.drop("namespace"), "id")
    p = p.join(e.select(*[F.col(c).alias(c + "2") for c in ("id", "entity_type", "n", "seen")]), "id2")
    days = F.abs(seconds_between(F.col("seen"), F.col("seen2"))) / 86400.0
    signals = [(NAME, F.col("jw")), (TYPE, (F.col("entity_type") == F.col("entity_type2")).cast("double")), (RECENCY, F.pow(F.lit(2.0), -days / 30)), (TOGETHER, F.col("together"))]
    have = sum(F.when(v.isNotNull(), w).otherwise(0.0) for w, v in signals)
    fused = sum(F.coalesce(w * v, F.lit(0.0)) for w, v in signals) / have
    p = p.withColumn("jw", name_match("n", "n2")).withColumn("fused", F.round(fused, 6))
    return p.select("id", "id2", "fused", F.when(F.col("fused") >= MERGE, "merge").when(F.col("fused") >= DEFER, "defer").otherwise("new").alias("decision"))


def proposed_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Relations that are not canonical, by use."""
    p = F.regexp_replace(F.trim(F.lower("relation")), r"\s+", " ")
    return store.relations(spark, d).groupBy(p.alias("predicate")).agg(F.count("*").alias("n")).select("predicate", "n", cardinality(F.col("predicate")).alias("cardinality"), F.col("predicate").isin([x[0] for x in PREDICATES]).alias("canonical"))


def entity_sets(spark: SparkSession, d: str, least: int = 3) -> DataFrame:
    """Subjects with several distinct objects under one relation, and the first ten of those."""
    g = store.relations(spark, d).groupBy("source_id").agg(F.count("*").alias("degree"), F.countDistinct("target_id").alias("n_objects"), F.min("target_id").alias("first_object"))
    return g.filter(F.col("n_objects") >= least)


def factual_plan(spark: SparkSession, d: str) -> DataFrame:
    """Anchors (entities named in a query), their one-hop neighbours, and memories by how many anchors they were seen via."""
    anchors = store.entities(spark, d).filter("entity_type = 'project' and deleted_at is null").select(F.lower("id").alias("anchor"))
    adj = undirected(store.relations(spark, d))
    hop = adj.join(anchors, F.col("x") == F.col("anchor")).select("anchor", F.col("y").alias("eid")).unionByName(anchors.select("anchor", F.col("anchor").alias("eid"))).distinct()
    m = store.mentions(spark, d).select("memory_id", "entity_id").distinct().join(hop, F.col("entity_id") == F.col("eid"))
    s = m.groupBy("memory_id").agg(F.countDistinct("anchor").alias("seen_via"))
    return s.join(F.broadcast(anchors.agg(F.count("*").alias("n_anchors")))).select("memory_id", "seen_via", F.round(F.col("seen_via") / F.col("n_anchors"), 6).alias("graph_score"))


def episodic_plan(spark: SparkSession, d: str) -> DataFrame:
    """Live memories of each namespace inside a window, newest first, with their place in it."""
    lo, hi = datetime.datetime(2025, 3, 1), datetime.datetime(2025, 4, 1)
    m = store.memories(spark, d, "deleted_at").filter((F.col("event_time") >= F.lit(lo)) & (F.col("event_time") <= F.lit(hi)) & F.col("deleted_at").isNull())
    span = (hi - lo).total_seconds()
    m = m.withColumn("rank", F.row_number().over(W.partitionBy("namespace").orderBy(F.desc("event_time"), "id")))
    return m.select("namespace", F.col("rank").cast("bigint").alias("rank"), "id", F.round(seconds_between(F.col("event_time"), F.lit(lo)) / span, 6).alias("recency"))


def associative_plan(spark: SparkSession, d: str) -> DataFrame:
    """From seed memories over their entities and one relation to other memories: least distance, best confidence."""
    seeds = store.memories(spark, d, "pinned").filter("pinned").select(F.lower("id").alias("seed"))
    me = store.mentions(spark, d).select("memory_id", "entity_id", "confidence")
    near = me.join(seeds, F.col("memory_id") == F.col("seed"), "left_semi").select("entity_id").distinct()
    adj = undirected(store.relations(spark, d).filter("confidence >= 0.5"))
    hop = adj.join(near, F.col("x") == F.col("entity_id"), "left_semi").select(F.col("y").alias("e")).distinct()
    reach = near.select(F.col("entity_id").alias("e"), F.lit(1).alias("distance")).unionByName(hop.withColumn("distance", F.lit(2))).groupBy("e").agg(F.min("distance").alias("distance"))
    out = me.join(reach, F.col("entity_id") == F.col("e")).join(seeds, F.col("memory_id") == F.col("seed"), "left_anti")
    return out.groupBy("memory_id").agg(F.min("distance").cast("bigint").alias("distance"), F.max("confidence").alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        edges_as_of, live_edges, edges_with_superseded, invalid_edges, edge_decision, neighbours_khop, ppr, relation_components, resolve_alias, canonical_entity_ids, entity_stats, list_entities,
        purge_garbage_entities, role_edges, resolution_decisions, proposed_predicates, entity_sets, factual_plan, episodic_plan, associative_plan,
    )
}

_TE = """te0 as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id, o_custkey as subject, case l_returnflag when 'R' then 'contradicts' when 'A' then 'uses' else 'related_to' end as predicate, l_partkey % 50 as object, l_shipdate as valid_from, o_orderdate as recorded_at, 1 - l_discount as confidence from lineitem join orders on l_orderkey = o_orderkey),
te as (select *, lead(valid_from) over (partition by subject, predicate, object order by valid_from, id) as valid_to, lead(recorded_at) over (partition by subject, predicate, object order by recorded_at, id) as invalidated_at from te0)"""
_CARD = "case relation " + " ".join(f"when '{n}' then '{c}'" for n, c, _ in PREDICATES) + " else 'many_to_many' end"
_ADJ = "adj as (select distinct * from (select source_id as x, target_id as y from er union all select target_id, source_id from er) where x <> y)"
_CANON = ", ".join(f"'{n}'" for n, _, _ in PREDICATES)


def _q(ctes: str, body: str) -> str:
    return sql("") + ", " + ctes + " " + body


SQL = {
    "edges_as_of": f"with {_TE} select id, subject, predicate, object from te where recorded_at <= {AT_SQL} and (invalidated_at is null or invalidated_at > {AT_SQL}) and (valid_from is null or valid_from <= {AT_SQL}) and (valid_to is null or valid_to > {AT_SQL})",
    "live_edges": f"with {_TE} select predicate, count(*) as n, count(distinct subject) as n_subjects, round(avg(confidence), 6) as avg_confidence from te where invalidated_at is null or invalidated_at > {store.NOW_SQL} group by 1",
    "edges_with_superseded": f"with {_TE} select predicate, case when recorded_at > {AT_SQL} then 'unknown_then' when invalidated_at is null or invalidated_at > {AT_SQL} then 'live' else 'superseded' end as state, count(*) as n from te group by 1, 2",
    "invalid_edges": f"with {_TE} select case when valid_to < valid_from then 'valid_range' when invalidated_at < recorded_at then 'transaction_range' when confidence is null or isnan(confidence) then 'confidence' else 'ok' end as result, count(*) as n from te group by 1",
    "edge_decision": _q(f"x as (select *, lag(target_id) over w as p_target, lag(confidence) over w as p_conf from (select *, case when {_CARD} = 'one_to_one' then '' else target_id end as slot from er where created_at is not null) window w as (partition by source_id, relation, slot order by created_at, id))", "select id, relation, case when p_target is null then 'add' when p_target = target_id and confidence <= p_conf + 0.05::double then 'none' when p_target <> target_id and confidence + 0.05::double < p_conf then 'defer' else 'update' end as decision from x"),
    "neighbours_khop": _q(_ADJ + ", d0 as (select lower(id) as id from en where entity_type = 'organization'), d1 as (select distinct y as id from adj where x in (select id from d0)), d2 as (select distinct y as id from adj where x in (select id from d1)), d3 as (select distinct y as id from adj where x in (select id from d2))", "select id, min(k)::bigint as distance, round(pow(0.5::double, min(k)), 6) as graph_score from (select id, 0 as k from d0 union all select id, 1 from d1 union all select id, 2 from d2 union all select id, 3 from d3) group by 1"),
    "relation_components": ("with recursive " + sql("")[5:]) + ", " + _ADJ + ", reach as (select x as id, x as other from adj union select reach.id, adj.y from reach join adj on reach.other = adj.x) select id, min(other) as component from reach group by 1",
    "resolve_alias": _q("e as (select id as entity_id, namespace as ens, lower(trim(name)) as n, coalesce(last_seen, first_seen) as seen from en), x as (select alias_id, entity_id, floor(epoch(seen))::bigint as s from graph_entity_aliases a join e on coalesce(a.namespace, 'default') = ens and lower(trim(alias)) = n)", "select alias_id, entity_id, round(0.7::double + 0.3::double * coalesce(case when max(s) over w > min(s) over w then (s - min(s) over w) / (max(s) over w - min(s) over w) else 1.0::double end, 0.0::double), 6) as score from x window w as (partition by alias_id)"),
    "canonical_entity_ids": sql("select id, substring(sha256(lower(trim(name)) || '|' || namespace), 1, 32) as canonical_id from en"),
    "entity_stats": sql("select 'entities' as kind, count(*) as n from en union all select 'relations', count(*) from er union all select 'mentions', count(*) from me"),
    "list_entities": _q("n as (select entity_id, count(*) as n_mentions, count(distinct memory_id) as n_memories from me group by 1)", "select id, entity_type, n_mentions, n_memories from en join n on lower(id) = entity_id where deleted_at is null order by n_mentions desc, id limit 100"),
    "purge_garbage_entities": sql("select entity_type, why, count(*) as n from (select entity_type, case when entity_type = 'person' and (length(trim(name)) <= 2 or regexp_full_match(trim(name), '\\d+')) then 'garbage_name' when lower(id) not in (select entity_id from me) then 'no_mention' end as why from en) where why is not null group by 1, 2"),
    "role_edges": sql("select case role when 'subject' then 'subject_of' when 'author' then 'created_by' when 'object' then 'object_of' else 'mentions' end as predicate, count(*) as n, round(avg(confidence), 6) as avg_confidence from me group by 1"),
    "proposed_predicates": sql(f"select predicate, n, {_CARD.replace('relation', 'predicate', 1)} as cardinality, predicate in ({_CANON}) as canonical from (select regexp_replace(trim(lower(relation)), '\\s+', ' ', 'g') as predicate, count(*) as n from er group by 1)"),
    "entity_sets": sql("select source_id, count(*) as degree, count(distinct target_id) as n_objects, min(target_id) as first_object from er group by 1 having count(distinct target_id) >= 3"),
    "factual_plan": _q(_ADJ + ", an as (select lower(id) as anchor from en where entity_type = 'project' and deleted_at is null), hop as (select anchor, y as eid from adj join an on x = anchor union select anchor, anchor from an)", "select memory_id, count(distinct anchor) as seen_via, round(count(distinct anchor) / (select count(*) from an), 6) as graph_score from (select distinct memory_id, entity_id from me) join hop on entity_id = eid group by 1"),
    "episodic_plan": sql("select namespace, row_number() over (partition by namespace order by event_time desc, id) as rank, id, round((epoch_us(event_time) // 1000000 - epoch_us(timestamp '2025-03-01') // 1000000) / 2678400.0::double, 6) as recency from m where event_time between timestamp '2025-03-01' and timestamp '2025-04-01' and deleted_at is null"),
    "associative_plan": _q("adj as (select distinct * from (select source_id as x, target_id as y from er where confidence >= 0.5 union all select target_id, source_id from er where confidence >= 0.5) where x <> y), sd as (select lower(id) as seed from m where pinned), nr as (select distinct entity_id from me where memory_id in (select seed from sd)), rc as (select e, min(k) as distance from (select entity_id as e, 1 as k from nr union all select y, 2 from adj where x in (select entity_id from nr)) group by 1)", "select memory_id, min(distance)::bigint as distance, max(confidence) as score from me join rc on entity_id = e where memory_id not in (select seed from sd) group by 1"),
}
