"""Activation, forgetting curves and confidence of memories.

Accesses are reduced to one row a memory before they meet the memories, so the
shuffle by key carries partial sums and a hot memory is combined on the map side.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.sources import store
from palimpsest.sources.store import NOW, seconds_between, sql


def access_summary(accesses: DataFrame, now: datetime.datetime, decay: float = 0.5) -> DataFrame:
    """(memory_id, n_accesses, power_sum, last_access)."""
    age = seconds_between(F.lit(now), F.col("accessed_at"))
    return accesses.groupBy("memory_id").agg(F.count("*").alias("n_accesses"), F.sum(S.power_law_term(age, decay)).alias("power_sum"), F.max("accessed_at").alias("last_access"))


def with_accesses(memories: DataFrame, accesses: DataFrame, now: datetime.datetime = NOW, decay: float = 0.5) -> DataFrame:
    """Memories with base-level activation (null without accesses) and the days since the last access."""
    a = access_summary(accesses, now, decay)
    m = memories.join(a, F.lower(memories["id"]) == a["memory_id"], "left").drop("memory_id")
    last = F.coalesce("last_access", "created")
    return m.withColumn("n_accesses", F.coalesce("n_accesses", F.lit(0))).withColumn("base_level", F.log("power_sum")).withColumn("age_days", seconds_between(F.lit(now), last) / 86400.0)


def retrieval_activation(memories: DataFrame, keywords: Sequence[str], preset: str = "default") -> DataFrame:
    """Base level + context + importance - contradiction; null where there is no access. Needs ``with_accesses``."""
    p = S.preset(preset)
    penalty = F.when(F.coalesce(F.col("contradicted_by"), F.lit("")) != "", p["contradiction_penalty"]).otherwise(0.0)
    a = F.col("base_level") + S.spreading(F.col("content"), keywords, p["context_weight"]) + F.col("importance") * p["importance_weight"] - penalty
    return memories.withColumn("activation", a)


def strengths(memories: DataFrame) -> DataFrame:
    """Stability, retrievability and effective strength. Needs ``with_accesses``."""
    m = memories.withColumn("stability", S.stability("memory_type", F.col("n_accesses"), F.col("importance"), F.col("consolidation_count")))
    m = m.withColumn("retrievability", S.retrievability(F.col("age_days"), F.col("stability")))
    return m.withColumn("effective_strength", (F.col("working_strength") + F.col("core_strength")) * F.col("retrievability"))


def confidence(memories: DataFrame) -> DataFrame:
    """Reliability, salience against the strongest of all, score and label. Needs ``strengths``."""
    contradicted = F.coalesce(F.col("contradicted_by"), F.lit("")) != ""
    r = S.by_type("memory_type", 3, 0.7) * F.when(contradicted, 0.7).otherwise(1.0)
    r = F.when(F.col("pinned"), F.least(F.lit(1.0), r * 1.1)).otherwise(r)
    m = memories.withColumn("reliability", 0.95 * r + 0.05 * F.col("importance"))
    top = memories.agg(F.max("effective_strength").alias("top"))  # one row
    m = m.join(F.broadcast(top))
    m = m.withColumn("salience", F.when(F.col("top") > 0, F.col("effective_strength") / F.col("top")).otherwise(S.sigmoid(2 * (F.col("effective_strength") - 0.5))))
    m = m.withColumn("confidence", 0.7 * F.col("reliability") + 0.3 * F.col("salience"))
    return m.withColumn("confidence_label", S.label(F.col("confidence"), S.RECORD_LABELS, "vague"))


def _base(spark: SparkSession, d: str, *more: str) -> DataFrame:
    want = ("memory_type", "importance", "working_strength", "core_strength", "consolidation_count", "pinned", "contradicted_by", "deleted_at", "superseded_by", "layer", *more)
    return with_accesses(store.memories(spark, d, *want), store.accesses(spark, d))


def actr_base_level(spark: SparkSession, d: str) -> DataFrame:
    m = _base(spark, d)
    return m.select("id", F.col("n_accesses").cast("bigint").alias("n_accesses"), F.round("base_level", 6).alias("base_level"), F.round(S.normalize_activation(F.col("base_level")), 6).alias("normalized"))


CONTEXT = ["retry", "Queue", "archive", "embedding"]


def actr_retrieval(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval_activation(_base(spark, d, "content"), CONTEXT)
    return m.select("id", F.round(S.spreading(F.col("content"), CONTEXT, 1.5), 6).alias("context"), F.round("activation", 6).alias("activation"), F.round(F.coalesce(S.sigmoid(F.col("activation")), F.lit(0.0)), 6).alias("actr_score"))


def ebbinghaus_strength(spark: SparkSession, d: str) -> DataFrame:
    m = strengths(_base(spark, d))
    forget = ~F.coalesce(F.col("pinned"), F.lit(False)) & (F.col("effective_strength") < 0.01)
    return m.select("id", F.round("stability", 4).alias("stability"), F.round("retrievability", 6).alias("retrievability"), F.round("effective_strength", 6).alias("effective_strength"), forget.alias("should_forget"))


def confidence_batch(spark: SparkSession, d: str) -> DataFrame:
    m = confidence(strengths(_base(spark, d)))
    return m.select("id", F.round("reliability", 6).alias("reliability"), F.round("salience", 6).alias("salience"), F.round("confidence", 9).alias("confidence"))


def confidence_labels(spark: SparkSession, d: str) -> DataFrame:
    m = confidence(strengths(_base(spark, d)))
    lab = S.label(F.round("confidence", 9), S.RECORD_LABELS, "vague")
    return m.groupBy("memory_type", lab.alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 7).alias("avg_confidence"))


def calibrated_confidence(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval_activation(confidence(strengths(_base(spark, d, "content"))), CONTEXT)
    a = F.least(F.greatest((F.col("activation") + 10) / 20, F.lit(0.0)), F.lit(1.0))
    return m.filter("activation is not null").select("id", F.round(0.4 * a + 0.4 * F.col("reliability") + 0.2 * F.col("salience"), 5).alias("calibrated"))


def classify_layers(spark: SparkSession, d: str) -> DataFrame:
    m = store.memories(spark, d, "core_strength", "working_strength", "pinned", "layer")
    new = F.when(F.col("pinned") | (F.col("core_strength") >= 0.7), "core").when(F.col("working_strength") >= 0.6, "working").otherwise("archive")
    return m.groupBy("layer", new.alias("computed_layer")).agg(F.count("*").alias("n"))


def recency_scores(spark: SparkSession, d: str) -> DataFrame:
    """Half-life recency, position in a window and temporal score of each memory."""
    m = store.memories(spark, d)
    hours = seconds_between(F.lit(NOW), F.col("event_time")) / 3600.0
    start, end = datetime.datetime(2025, 6, 1), datetime.datetime(2025, 9, 1)
    half = (end - start).total_seconds() / 2
    mid = start + datetime.timedelta(seconds=half)
    dist = F.abs(seconds_between(F.col("event_time"), F.lit(mid)))
    inside = (F.col("event_time") >= F.lit(start)) & (F.col("event_time") <= F.lit(end))
    return m.select("id", F.round(F.pow(F.lit(0.5), hours / 24 / 365), 6).alias("recency"), F.round(F.when(inside, F.greatest(F.lit(0.5), 1 - 0.5 * dist / half)).otherwise(0.0), 6).alias("overlap"), F.round(0.3 + 0.4 * F.pow(F.lit(0.5), hours / (72 * 100)), 6).alias("temporal"))


def feedback_polarity(spark: SparkSession, d: str) -> DataFrame:
    """Sign of positive less negative words in the summary."""
    m = store.memories(spark, d, "summary")
    low = F.lower(F.coalesce("summary", F.lit("")))
    count = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    diff = count(S.POSITIVE_WORDS) - count(S.NEGATIVE_WORDS)
    return m.groupBy(F.signum(diff).cast("int").alias("polarity")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (actr_base_level, actr_retrieval, ebbinghaus_strength, confidence_batch, confidence_labels, calibrated_confidence, classify_layers, recency_scores, feedback_polarity)}

_SEC = "(epoch_us({a}) // 1000000 - epoch_us({b}) // 1000000)"
AGG = f"agg as (select memory_id, count(*) as n_accesses, sum(pow(greatest({_SEC.format(a='now', b='accessed_at')}::double, 0.001), -0.5)) as power_sum, max(accessed_at) as last_access from acc, now_ group by 1)"
BASE = f"""{AGG}, b as (select m.*, coalesce(n_accesses, 0) as n_accesses, ln(power_sum) as base_level, {_SEC.format(a='now', b='coalesce(last_access, m.created)')} / 86400.0::double as age_days
  from m left join agg on lower(m.id) = agg.memory_id, now_)"""
STRENGTH = f"""{BASE}, s0 as (select *, (1 / {S.by_type_sql('memory_type', 2, 0.03)}) * (1 + 0.5::double * ln(n_accesses::double + 1)) * (0.5::double + importance) * (1 + 0.2::double * consolidation_count) as stability from b),
 s1 as (select *, case when age_days <= 0 then 1.0::double else exp(-age_days / stability) end as retrievability from s0),
 s as (select *, (working_strength + core_strength) * retrievability as effective_strength from s1)"""
_REL0 = f"{S.by_type_sql('memory_type', 3, 0.7)} * (case when coalesce(contradicted_by, '') <> '' then 0.7::double else 1.0::double end)"
CONFIDENCE = f"""{STRENGTH}, c0 as (select *, 0.95::double * (case when pinned then least(1.0::double, ({_REL0}) * 1.1::double) else {_REL0} end) + 0.05::double * importance as reliability, max(effective_strength) over () as top from s),
 c1 as (select *, case when top > 0 then effective_strength / top else 1 / (1 + exp(-2 * (effective_strength - 0.5))) end as salience from c0),
 c as (select *, 0.7::double * reliability + 0.3::double * salience as confidence from c1)"""
_HITS = " + ".join(f"contains(lower(coalesce(content, '')), '{k.lower()}')::int" for k in CONTEXT)
_ACT = f"base_level + 1.5::double * ({_HITS}) / {len(CONTEXT)} + importance * 2.0::double - (case when coalesce(contradicted_by, '') <> '' then 3.0::double else 0.0::double end)"
_OTHER = {
    "classify_layers": "select layer, case when pinned or core_strength >= 0.7 then 'core' when working_strength >= 0.6 then 'working' else 'archive' end as computed_layer, count(*) as n from m group by 1, 2",
}


def _with(ctes: str, body: str) -> str:
    return sql("").rstrip() + ", " + ctes + " " + body


_pos = " + ".join(f"contains(t, '{w}')::int" for w in S.POSITIVE_WORDS)
_neg = " + ".join(f"contains(t, '{w}')::int" for w in S.NEGATIVE_WORDS)
SQL = {
    "actr_base_level": _with(BASE, "select id, n_accesses, round(base_level, 6) as base_level, round(coalesce(1 / (1 + exp(-(base_level + 5.5::double) / 1.5::double)), 0.0::double), 6) as normalized from b"),
    "actr_retrieval": _with(BASE, f"select id, round(1.5::double * ({_HITS}) / {len(CONTEXT)}, 6) as context, round({_ACT}, 6) as activation, round(coalesce(1 / (1 + exp(-({_ACT}))), 0.0::double), 6) as actr_score from b"),
    "ebbinghaus_strength": _with(STRENGTH, "select id, round(stability, 4) as stability, round(retrievability, 6) as retrievability, round(effective_strength, 6) as effective_strength, (not coalesce(pinned, false) and effective_strength < 0.01) as should_forget from s"),
    "confidence_batch": _with(CONFIDENCE, "select id, round(reliability, 6) as reliability, round(salience, 6) as salience, round(confidence, 9) as confidence from c"),
    "confidence_labels": _with(CONFIDENCE, f"select memory_type, {S.label_sql("round(confidence, 9)", S.RECORD_LABELS, 'vague')} as label, count(*) as n, round(avg(confidence), 7) as avg_confidence from c group by 1, 2"),
    "calibrated_confidence": _with(CONFIDENCE, f"select id, round(0.4::double * least(greatest(({_ACT} + 10) / 20, 0.0::double), 1.0::double) + 0.4::double * reliability + 0.2::double * salience, 5) as calibrated from c where base_level is not null"),
    "classify_layers": sql(_OTHER["classify_layers"]),
    "recency_scores": sql(f"""select id, round(pow(0.5::double, ({_SEC.format(a='now', b='event_time')} / 3600.0::double) / 24 / 365), 6) as recency,
      round(case when event_time between timestamp '2025-06-01' and timestamp '2025-09-01' then greatest(0.5::double, 1 - 0.5::double * abs({_SEC.format(a='event_time', b="timestamp '2025-07-17 00:00:00'")}) / 3974400.0::double) else 0.0::double end, 6) as overlap,
      round(0.3::double + 0.4::double * pow(0.5::double, ({_SEC.format(a='now', b='event_time')} / 3600.0::double) / 7200), 6) as temporal from m, now_"""),
    "feedback_polarity": sql(f"select sign(({_pos}) - ({_neg}))::int as polarity, count(*) as n from (select lower(coalesce(summary, '')) as t from m) group by 1"),
}
