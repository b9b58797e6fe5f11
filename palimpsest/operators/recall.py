"""Recall for any question: seven channels over candidates, then thinning.

Candidates come first: the best ``3 k`` memories by full text, by vector, by the
entities that the question names, and the newest in its time range. Only their
union is joined with accesses, links and strengths, so what a recall reads of
the large tables is filtered by at most twelve k ids.

Defined results: an empty question finds nothing by text; without a vector that
channel is silent; a namespace ``None`` means all; equal scores go by id.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions.common import checkpoint
from palimpsest.operators import activation as A
from palimpsest.operators import questions as Q
from palimpsest.operators import retrieval as R
from palimpsest.sources import store
from palimpsest.sources.store import NOW, seconds_between, sql


@dataclass(frozen=True)
class Marker:
    """What a situation felt like before: mean valence and how often it was met."""

    valence: float = 0.0
    encounters: int = 0


def somatic(marker: Marker, memory_type: Column, importance: Column) -> Column:
    """Strength of the marker by how emotional a memory is; silent below 0.01."""
    if abs(marker.valence) < 0.01:
        return F.lit(0.0)
    relevance = F.when(memory_type == "emotional", 1.0).when(importance >= 0.7, 0.7).otherwise(0.3)
    return F.least(F.lit(1.0), abs(marker.valence) * relevance * min(marker.encounters / 5, 1.0))


def update_marker(marker: Marker, recalled: DataFrame) -> Marker:
    """The marker after a recall (memory_type, importance): emotional memories feed their weight back as valence."""
    r = recalled.filter("memory_type = 'emotional'").agg(F.avg("importance").alias("v"), F.count("*").alias("n")).first()
    if not r["n"]:
        return marker
    total = marker.encounters + 1
    return Marker((marker.valence * marker.encounters + r["v"]) / total, total)


def overlap_score(at: Column, start: datetime.datetime, end: datetime.datetime) -> Column:
    """1 in the middle of a range, 0.5 at its edges, 0 outside."""
    half = int((end - start).total_seconds()) / 2
    inside = (at >= F.lit(start)) & (at <= F.lit(end))
    if half <= 0:
        return F.when(inside, 1.0).otherwise(0.0)
    middle = start + (end - start) / 2
    return F.when(inside, F.greatest(F.lit(0.5), 1 - F.abs(seconds_between(at, F.lit(middle))) / half * 0.5)).otherwise(0.0)


def analyse(spark: SparkSession, question: str, now: datetime.datetime) -> dict:
    """Kind, intent and time range of a question, and the names that it may hold, by the same expressions as columns."""
    q = F.lit(question)
    r = spark.range(1).select(R.query_kind(q).alias("kind"), R.query_intent(q).alias("intent"), Q.time_range(q, F.lit(now)).alias("range"), F.transform(Q.mention_texts(q), lambda w: F.lower(w)).alias("names")).first()
    span = r["range"] if r["range"] and r["range"]["start"] else None
    return {"kind": r["kind"], "intent": r["intent"], "range": (span["start"], span["end"]) if span else None, "names": list(dict.fromkeys(r["names"])), "terms": R.query_terms(question)}


def recall_scored(spark: SparkSession, d: str, question: str, namespace: str | None = None, k: int = 10, vector: DataFrame | None = None, marker: Marker = Marker(), now: datetime.datetime = NOW) -> DataFrame:
    """(id, memory_type, importance, the seven channels, score) of the candidates."""
    what, n = analyse(spark, question, now), 3 * k
    m = R.live(spark, d, "content", "memory_type", "importance", "contradicted_by")
    m = m.filter(F.col("namespace") == namespace) if namespace is not None else m
    text = R.top(R.bm25(m.select("id", "content"), "content", what["terms"]).withColumn("score", F.round("score", 6)), n)
    text = checkpoint(text.select(F.col("id").alias("tid"), (F.col("score") / F.max("score").over(W.partitionBy())).alias("fts")))  # at most 3 k rows
    own = m.select(F.lower("id").alias("own"))
    near = None
    if vector is not None:
        v = R.usable(spark, d).join(own, F.lower("id") == F.col("own"), "left_semi")
        near = checkpoint(R.top(R.vector_scores(v, vector).withColumn("score", F.round(F.greatest(F.lit(0.0), F.col("cosine")), 6)), n).select(F.lower("id").alias("vid"), F.col("score").alias("emb")))
    named = Q.named_entities(spark, d).filter(F.col("surface").isin(what["names"])).select(F.lower("entity_id").alias("eid")).distinct()
    rel = store.relations(spark, d)
    hop = rel.select(F.col("source_id").alias("x"), F.col("target_id").alias("y")).unionByName(rel.select(F.col("target_id").alias("x"), F.col("source_id").alias("y"))).join(named, F.col("x") == F.col("eid"), "left_semi").select(F.col("y").alias("eid")).distinct().join(named, "eid", "left_anti")
    weight = named.withColumn("w", F.lit(1.0)).unionByName(hop.withColumn("w", F.lit(0.5)))
    ents = store.mentions(spark, d).select("memory_id", "entity_id").distinct().join(weight, F.col("entity_id") == F.col("eid")).join(own, F.col("memory_id") == F.col("own"), "left_semi").groupBy("memory_id").agg(F.sum("w").alias("s"))
    ents = R.top(ents.withColumnRenamed("memory_id", "id").withColumnRenamed("s", "score"), n)
    ents = checkpoint(ents.select(F.col("id").alias("nid"), (F.col("score") / F.max("score").over(W.partitionBy())).alias("entity")))
    ids = text.select(F.lower("tid").alias("cid")).unionByName(ents.select(F.col("nid").alias("cid")))
    ids = ids.unionByName(near.select(F.col("vid").alias("cid"))) if near is not None else ids
    if what["range"]:
        when = m.filter((F.col("event_time") >= F.lit(what["range"][0])) & (F.col("event_time") <= F.lit(what["range"][1])))
        ids = ids.unionByName(when.orderBy(F.desc("event_time"), "id").limit(n).select(F.lower("id").alias("cid")))
    ids = F.broadcast(checkpoint(ids.distinct()))  # at most 12 k ids
    c = m.withColumn("cid", F.lower("id")).join(ids, "cid")
    used = store.accesses(spark, d).join(ids, F.col("memory_id") == F.col("cid"), "left_semi")
    c = A.retrieval_activation(A.with_accesses(c, used, now), what["terms"])
    link = store.links(spark, d).filter("source_id <> target_id").join(ids, F.col("source_id") == F.col("cid"), "left_semi").join(ids, F.col("target_id") == F.col("cid"), "left_semi")
    ties = link.select(F.col("source_id").alias("hid"), "strength").unionByName(link.select(F.col("target_id").alias("hid"), "strength")).groupBy("hid").agg(F.sum("strength").alias("s"))
    ties = ties.select("hid", (F.col("s") / F.max("s").over(W.partitionBy())).alias("hebbian"))  # candidates only
    c = c.join(text.withColumn("tid", F.lower("tid")), F.col("cid") == F.col("tid"), "left").join(ents, F.col("cid") == F.col("nid"), "left").join(ties, F.col("cid") == F.col("hid"), "left")
    c = c.join(near, F.col("cid") == F.col("vid"), "left") if near is not None else c.withColumn("emb", F.lit(0.0))
    hours = seconds_between(F.lit(now), F.col("created")) / 3600.0
    when = overlap_score(F.col("event_time"), *what["range"]) if what["range"] else 0.3 + 0.4 / (1 + F.exp(F.least(hours - 120, F.lit(700.0))))
    c = c.withColumn("actr", S.normalize_activation(F.col("activation"))).withColumn("temporal", when).withColumn("somatic", somatic(marker, F.col("memory_type"), F.col("importance")))
    factor = F.lit(1.0)
    for row, y in zip(S.MEMORY_TYPES, R.AFFINITY[what["intent"]]):
        factor = F.when(F.col("memory_type") == row[0], y).otherwise(factor)
    channels = [F.round(F.coalesce(F.col(x), F.lit(0.0)), 6).alias(x) for x in R.CHANNELS]
    c = c.select("id", "memory_type", "importance", factor.alias("factor"), *channels)
    score = sum((F.col(x) * y for x, y in R.channel_weights(what["kind"]).items()), F.lit(0.0))
    return c.withColumn("score", F.round(score * F.col("factor"), 5)).drop("factor")


def recall(spark: SparkSession, d: str, question: str, namespace: str | None = None, k: int = 10, vector: DataFrame | None = None, marker: Marker = Marker(), now: datetime.datetime = NOW, closest: float = 0.85) -> DataFrame:
    """The k best memories for a question: (id, score), near-copies of better ones left out."""
    best = R.top(recall_scored(spark, d, question, namespace, k, vector, marker, now), 3 * k).select("id", "rank", "score")
    v = R.usable(spark, d).join(F.broadcast(best.select("id")), "id", "left_semi")
    return R.greedy_dedup(best.join(v, "id", "left"), closest, k)


def recall_with_associations(spark: SparkSession, d: str, found: DataFrame, weakest: float = 0.2, most: int = 5) -> DataFrame:
    """(id, other, strength): for each recalled memory its strongest links of at least ``weakest``."""
    ids = F.broadcast(checkpoint(found.select(F.lower("id").alias("id")).distinct()))
    l = store.links(spark, d).filter((F.col("source_id") != F.col("target_id")) & (F.col("strength") >= weakest))
    both = l.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "strength").unionByName(l.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "strength"))
    x = both.join(ids, "id", "left_semi").groupBy("id", "other").agg(F.max("strength").alias("strength"))
    r = F.row_number().over(W.partitionBy("id").orderBy(F.desc("strength"), "other"))
    return x.withColumn("r", r).filter(F.col("r") <= most).drop("r")


QUESTION, MARKED = "retry counters of the archive queue 60 days ago", Marker(-0.6, 3)


def recall_question(spark: SparkSession, d: str) -> DataFrame:
    """One question with a time range, a vector and a marker: its candidates' channels and scores, the best 30."""
    x = recall_scored(spark, d, QUESTION, vector=R._query_vector(spark, d), marker=MARKED)
    return R.top(x, 30).select("id", "memory_type", *R.CHANNELS, "score")


def recall_answers(spark: SparkSession, d: str) -> DataFrame:
    """The same question to the end: ten memories without near-copies."""
    return recall(spark, d, QUESTION, vector=R._query_vector(spark, d), marker=MARKED)


def recalled_links(spark: SparkSession, d: str) -> DataFrame:
    """The strongest links of the full-text hits."""
    return recall_with_associations(spark, d, R.bm25_topk(spark, d))


QUERIES = {f.__name__: f for f in (recall_question, recall_answers, recalled_links)}

_TERMS = R.query_terms(QUESTION)
_W = R.channel_weights("temporal")
_HITS = " + ".join(f"contains(lower(coalesce(content, '')), '{k}')::int" for k in _TERMS)
_LO, _HI = NOW - datetime.timedelta(days=60), NOW
_MID, _HALF = _LO + (_HI - _LO) / 2, (_HI - _LO).total_seconds() / 2
_US = lambda c: f"epoch_us({c}) // 1000000"
_TS = lambda t: f"timestamp '{t:%Y-%m-%d %H:%M:%S}'"
_NAMES = ", ".join("'" + " ".join(w) + "'" for n in range(1, 5) for i in range(9 - n) for w in [QUESTION.split()[i : i + n]])
SQL = {
    "recall_question": sql("") + ", " + R._LIVE + ", " + R._bm25_sql("ft", "live", "content", _TERMS) + ", " + R._VEC + f""",
        tx as (select lower(id) as id, s / max(s) over () as fts from (select id, round(score, 6) as s from ft order by s desc, id limit 30)),
        vl as (select lower(id) as id, round(greatest(0.0::double, cosine), 6) as emb from vs where lower(id) in (select lower(id) from live) order by emb desc, vs.id limit 30),
        e0 as (select id as entity_id, lower(trim(name)) as surface from en where deleted_at is null and trim(name) <> ''), ne as (select surface, entity_id from e0 union select lower(trim(alias)), entity_id from graph_entity_aliases join e0 on canonical_id = entity_id),
        qe as (select distinct lower(entity_id) as eid from ne where surface in ({_NAMES})), nr as (select source_id as x, target_id as y from er union all select target_id, source_id from er), wt as (select eid, 1.0::double as w from qe union all select distinct y, 0.5::double from nr where x in (select eid from qe) and y not in (select eid from qe)),
        ec as (select id, s / max(s) over () as entity from (select memory_id as id, sum(w) as s from (select distinct memory_id, entity_id from me) join wt on entity_id = eid where memory_id in (select lower(id) from live) group by 1 order by s desc, id limit 30)),
        tr as (select lower(id) as id from live where event_time between {_TS(_LO)} and {_TS(_HI)} order by event_time desc, live.id limit 30),
        cd as (select id from tx union select id from vl union select id from ec union select id from tr),
        lc as (select * from hl where source_id <> target_id and source_id in (select id from cd) and target_id in (select id from cd)), hc as (select id, s / max(s) over () as hebbian from (select id, sum(strength) as s from (select source_id as id, strength from lc union all select target_id, strength from lc) group by 1)),
        """ + A.BASE + f""",
        x as (select b.id, memory_type, round(coalesce(fts, 0), 6) as fts, round(coalesce(emb, 0), 6) as emb,
          round(coalesce(1 / (1 + exp(-((base_level + 1.5::double * ({_HITS}) / {len(_TERMS)} + importance * 2.0::double - (case when coalesce(contradicted_by, '') <> '' then 3.0::double else 0.0::double end)) + 5.5::double) / 1.5::double)), 0), 6) as actr,
          round(coalesce(entity, 0), 6) as entity, round(case when event_time between {_TS(_LO)} and {_TS(_HI)} then greatest(0.5::double, 1 - abs({_US('event_time')} - {_US(_TS(_MID))}) / {_HALF}::double * 0.5::double) else 0.0::double end, 6) as temporal, round(coalesce(hebbian, 0), 6) as hebbian,
          round(least(1.0::double, 0.6::double * (case when memory_type = 'emotional' then 1.0::double when importance >= 0.7 then 0.7::double else 0.3::double end) * 0.6::double), 6) as somatic
          from b join cd on cd.id = lower(b.id) left join tx on tx.id = lower(b.id) left join vl on vl.id = lower(b.id) left join ec on ec.id = lower(b.id) left join hc on hc.id = lower(b.id) where deleted_at is null and coalesce(superseded_by, '') = '')
        select id, memory_type, fts, emb, actr, entity, temporal, hebbian, somatic, round((""" + " + ".join(f"{c} * {w}::double" for c, w in _W.items()) + ") * (case memory_type " + " ".join(f"when '{r[0]}' then {y}::double" for r, y in zip(S.MEMORY_TYPES, R.AFFINITY["general"])) + " else 1.0::double end), 5) as score from x order by score desc, id limit 30",
    "recalled_links": sql("") + ", " + R._F + ", hit as (select lower(id) as id from (select id from ft order by score desc, id limit 25)), bo as (select id, other, max(strength) as strength from (select source_id as id, target_id as other, strength from hl where source_id <> target_id and strength >= 0.2 union all select target_id, source_id, strength from hl where source_id <> target_id and strength >= 0.2) where id in (select id from hit) group by 1, 2) select id, other, strength from (select *, row_number() over (partition by id order by strength desc, other) as r from bo) where r <= 5",
}
