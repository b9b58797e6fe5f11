"""Upkeep of the store and of an agent's files: text normal forms, marks of time, tasks and keys in pages, updates that trends suggest, backfills, migrations."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.common import checkpoint, ns, table
from palimpsest.operators import feedback, knowledge, retrieval
from palimpsest.sources import store
from palimpsest.sources.store import sql

#: Kinds of entities; anything else is unknown.
KINDS = ["person", "organization", "project", "place", "tool", "concept"]
#: Edges that each node of a pair graph keeps.
KEPT_EDGES = 5


def plain_query(q: Column) -> Column:
    """A text as a full-text query: letters and digits, single blanks; ``memory`` if nothing is left."""
    c = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(q, F.lit("")), r"[^a-zA-Z0-9\s]", " "), r"\s+", " "))
    return F.when(c == "", "memory").otherwise(c)


def plain_queries(spark: SparkSession, d: str) -> DataFrame:
    return store.memories(spark, d, "summary").select("id", plain_query(F.col("summary")).alias("query"))


def entity_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Types as typed, read leniently: case and blanks do not matter, unknown words are unknown."""
    k = F.lower(F.trim(F.coalesce("entity_type", F.lit(""))))
    kind = F.when(k.isin(KINDS), k).when(k == "organisation", "organization").otherwise("unknown")
    return store.entities(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def time_marks(spark: SparkSession, d: str) -> DataFrame:
    """How precisely a memory's time is known (rank 0 none, 2 day, 3 exact), how many of its fields say something, and whether any tells a story."""
    m = store.memories(spark, d, "occurred_at", "summary", "source", "source_file", "metadata")
    said = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) != "").cast("bigint")
    midnight = F.date_trunc("day", "occurred_at") == F.col("occurred_at")
    rank = F.when(F.col("occurred_at").isNull(), 0).when(midnight, 2).otherwise(3).cast("bigint")
    fields = [said(c) for c in ("summary", "source", "source_file", "metadata")]
    return m.select("id", rank.alias("precision"), (fields[0] + fields[1] + fields[2] + fields[3]).alias("info"), ((fields[0] + fields[3]) > 0).alias("narrative"))


def checklist_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Checkbox lines of pages: the task and whether it is done."""
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    rx = r"^\s*[-*] \[([ xX])\] (\S[^\r]*)"
    return x.filter(F.col("x").rlike(rx)).select("doc_id", F.col("line").cast("bigint").alias("line"), (F.lower(F.regexp_extract("x", rx, 1)) == "x").alias("done"), F.trim(F.regexp_extract("x", rx, 2)).alias("task"))


def key_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the form ``Key: value`` in pages, counted by key: fields of an identity file."""
    x = table(spark, d, "documents").filter("text is not null").select(F.explode(F.split("text", "\n")).alias("x"))
    rx = r"^\**([A-Z][A-Za-z]{1,18}):\**\s+(\S[^\r]*)"
    return x.filter(F.col("x").rlike(rx)).select(F.regexp_extract("x", rx, 1).alias("key"), F.regexp_extract("x", rx, 2).alias("value")).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def suggested_updates(spark: SparkSession, d: str) -> DataFrame:
    """What trends and outcomes suggest to change: a bad mood's area is reviewed, a weak action set back, a strong one raised."""
    mood = table(spark, d, "emotional_trends").dropDuplicates(["domain"]).filter("event_count >= 10 and abs(valence) > 0.4").select(F.col("domain").alias("target"), F.when(F.col("valence") < 0, "review").otherwise("keep").alias("change"))
    acts = table(spark, d, "behavior_log").dropDuplicates(["id"]).groupBy("action").agg(F.avg("outcome").alias("rate"), F.count("*").alias("n")).filter("n >= 10")
    acts = acts.withColumn("change", F.when(F.col("rate") < 0.4, "set_back").when(F.col("rate") > 0.6, "raise")).filter("change is not null").select(F.col("action").alias("target"), "change")
    return mood.withColumn("kind", F.lit("mood")).unionByName(acts.withColumn("kind", F.lit("action")))


def aligned_drives(spark: SparkSession, d: str) -> DataFrame:
    """Drives and the memories that have one of their words: how many, and their mean importance."""
    m = store.memories(spark, d, "content", "importance")
    low = F.lower(F.coalesce("content", F.lit("")))
    hits = F.array_compact(F.array(*[F.when(F.greatest(*[F.contains(low, F.lit(k)) for k in words]), F.lit(name)) for name, words in feedback.DRIVES]))
    return m.select("importance", F.explode(hits).alias("drive")).groupBy("drive").agg(F.count("*").alias("n"), F.round(F.sum(F.col("importance").cast("decimal(18,6)")).cast("double") / F.count("*"), 6).alias("importance"))


def several_anomalies(spark: SparkSession, d: str, sigma: float = 2.0) -> DataFrame:
    """Hours in which two and more kinds of events deviate from their last 50 values at once."""
    e = table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("domain"), "value")
    b = feedback.baselines(e, "domain", ("ts", "event_id"), "value", 50).filter("n >= 20 and std > 0")
    odd = b.filter(F.abs((F.col("value") - F.col("mean")) / F.col("std")) > sigma)
    h = odd.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour")).agg(F.countDistinct("domain").alias("n_domains"), F.count("*").alias("n"))
    return h.filter("n_domains >= 2")


def expanded_hits(spark: SparkSession, d: str) -> DataFrame:
    """Full-text hits and what is linked to them: a linked memory scores half of its best hit, by the link's strength."""
    hit = checkpoint(retrieval.bm25_topk(spark, d).select(F.lower("id").alias("id"), "score"))
    l = store.links(spark, d).filter("source_id <> target_id and strength >= 0.2")
    both = l.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "strength").unionByName(l.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "strength"))
    near = both.join(hit, "id").groupBy(F.col("other").alias("id")).agg(F.max(0.5 * F.col("score") * F.least(F.lit(1.0), F.col("strength"))).alias("score"))
    return hit.withColumn("direct", F.lit(True)).unionByName(near.withColumn("direct", F.lit(False))).groupBy("id").agg(F.round(F.max("score"), 6).alias("score"), F.max("direct").alias("direct"))


def sparse_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pair graph with the five best edges of each node, either end's choice; edges between two emotional memories weigh a fifth more."""
    p = checkpoint(knowledge.cluster_pairs(spark, d))
    both = p.select(F.col("a").alias("x"), "a", "b", "score").unionByName(p.select(F.col("b").alias("x"), "a", "b", "score"))
    r = F.row_number().over(W.partitionBy("x").orderBy(F.desc("score"), "a", "b"))
    kept = both.withColumn("r", r).filter(F.col("r") <= KEPT_EDGES).select("a", "b", "score").distinct()
    felt = store.memories(spark, d, "memory_type").filter("memory_type = 'emotional'").select(F.lower("id").alias("id")).distinct()
    x = kept.join(felt.select(F.col("id").alias("a"), F.lit(True).alias("fa")), "a", "left").join(felt.select(F.col("id").alias("b"), F.lit(True).alias("fb")), "b", "left")
    return x.select("a", "b", F.round(F.col("score") * F.when(F.col("fa") & F.col("fb"), 1.2).otherwise(1.0), 6).alias("score"))


def synthesis_plan(spark: SparkSession, d: str) -> DataFrame:
    """Groups that pass the gate: the template that their main type takes, how long the prompt gets, and in which order."""
    g = knowledge.namespace_gate(spark, d).filter("decision = 'synthesize'").select("namespace", "month", "n")
    m = store.memories(spark, d, "memory_type", "content").withColumn("month", F.date_format("created", "yyyy-MM"))
    t = m.groupBy("namespace", "month", "memory_type").agg(F.count("*").alias("k"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"))
    main = t.groupBy("namespace", "month").agg(F.min_by("memory_type", F.struct(-F.col("k"), F.col("memory_type"))).alias("main"), F.sum("chars").alias("chars"))
    template = F.when(F.col("main") == "causal", "causal_chain").when(F.col("main") == "procedural", "pattern").when(F.col("main").isin("episodic", "emotional"), "timeline").otherwise("general")
    x = g.join(main, ["namespace", "month"]).select("namespace", "month", "n", template.alias("template"), "chars")
    place = F.row_number().over(W.partitionBy("namespace").orderBy(F.desc("n"), "month"))
    return x.withColumn("place", place.cast("bigint"))


def substrate_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a move into one store of nodes and edges writes, by kind: vectors, deleted memories, provenance, triples."""
    m = store.memories(spark, d, "deleted_at", "superseded_by", "contradicted_by")
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    parts = [
        retrieval.usable(spark, d).select(F.lit("node_embedding").alias("kind")), m.filter("deleted_at is not null").select(F.lit("deleted_node").alias("kind")), m.filter(said("superseded_by")).select(F.lit("superseded_edge").alias("kind")),
        m.filter(said("contradicted_by")).select(F.lit("contradicted_edge").alias("kind")), store.relations(spark, d).select(F.lit("triple").alias("kind")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


def export_rates(spark: SparkSession, d: str) -> DataFrame:
    """For each producer: files, distinct lines, hours between its first and last delivery, and lines an hour."""
    e = table(spark, d, "memory_exports")
    g = e.groupBy("producer").agg(F.countDistinct("file_no").alias("n_files"), F.countDistinct("file_no", "line_no").alias("n_lines"), (F.unix_seconds(F.max("delivered_at").cast("timestamp")) - F.unix_seconds(F.min("delivered_at").cast("timestamp"))).alias("s"))
    return g.select("producer", "n_files", "n_lines", F.round(F.when(F.col("s") > 0, F.col("n_lines") / (F.col("s") / 3600.0)), 4).alias("per_hour"))


def rerank(candidates: DataFrame, query: str, score: Callable[[str, str], float], text: str = "content") -> DataFrame:
    """``candidates`` (id, ...) with ``rerank_score`` from a scorer that a user supplies, such as a cross-encoder; squashed to 0..1."""
    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([1 / (1 + math.exp(-score(query, t or ""))) for t in texts], dtype="float64")

    return candidates.withColumn("rerank_score", run(F.col(text)))


def reranker_faults(before: DataFrame, after: DataFrame, again: DataFrame) -> list[str]:
    """What a reranker must not do: lose or add rows, or give another order on the same input."""
    faults = []
    if before.select("id").exceptAll(after.select("id")).count() or after.select("id").exceptAll(before.select("id")).count():
        faults.append("rows")
    if after.select("id", "rerank_score").exceptAll(again.select("id", "rerank_score")).count():
        faults.append("order")
    return faults


QUERIES = {
    f.__name__: f
    for f in (
        plain_queries, entity_kinds, time_marks, checklist_tasks, key_lines, suggested_updates, aligned_drives, several_anomalies, expanded_hits, sparse_pairs, synthesis_plan, substrate_backfill, export_rates,
    )
}

_SAID = lambda c: f"(trim(coalesce({c}, '')) <> '')::bigint"
_LINES = "l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null), x as (select doc_id, i - 1 as line, ls[i] as x from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from l))"
_DRIVES = " union all ".join("select importance, '" + n + "' as drive from m where " + " or ".join(f"contains(lower(coalesce(content, '')), '{k}')" for k in ws) for n, ws in feedback.DRIVES)
SQL = {
    "plain_queries": sql("select id, case when q = '' then 'memory' else q end as query from (select id, trim(regexp_replace(regexp_replace(coalesce(summary, ''), '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as q from m)"),
    "entity_kinds": sql("select case when k in (" + ", ".join(f"'{k}'" for k in KINDS) + ") then k when k = 'organisation' then 'organization' else 'unknown' end as kind, count(*) as n from (select lower(trim(coalesce(entity_type, ''))) as k from en) group by 1"),
    "time_marks": sql(f"select id, (case when occurred_at is null then 0 when date_trunc('day', occurred_at) = occurred_at then 2 else 3 end)::bigint as precision, {_SAID('summary')} + {_SAID('source')} + {_SAID('source_file')} + {_SAID('metadata')} as info, {_SAID('summary')} + {_SAID('metadata')} > 0 as narrative from m"),
    "checklist_tasks": "with " + _LINES + " select doc_id, line, lower(regexp_extract(x, '^\\s*[-*] \\[([ xX])\\] (\\S[^\\r]*)', 1)) = 'x' as done, trim(regexp_extract(x, '^\\s*[-*] \\[([ xX])\\] (\\S[^\\r]*)', 2)) as task from x where regexp_matches(x, '^\\s*[-*] \\[([ xX])\\] (\\S[^\\r]*)')",
    "key_lines": "with " + _LINES + ", k as (select regexp_extract(x, '^\\**([A-Z][A-Za-z]{1,18}):\\**\\s+(\\S[^\\r]*)', 1) as key, regexp_extract(x, '^\\**([A-Z][A-Za-z]{1,18}):\\**\\s+(\\S[^\\r]*)', 2) as value from x where regexp_matches(x, '^\\**([A-Z][A-Za-z]{1,18}):\\**\\s+(\\S[^\\r]*)')) select key, count(*) as n, count(distinct value) as n_values from k group by 1",
    "suggested_updates": "select domain as target, case when valence < 0 then 'review' else 'keep' end as change, 'mood' as kind from (select domain, min(valence) as valence, min(event_count) as event_count from emotional_trends group by 1) where event_count >= 10 and abs(valence) > 0.4 union all select action, case when rate < 0.4 then 'set_back' else 'raise' end, 'action' from (select action, avg(outcome) as rate, count(*) as n from (select id, min(action) as action, min(outcome) as outcome from behavior_log group by 1) group by 1) where n >= 10 and (rate < 0.4 or rate > 0.6)",
    "aligned_drives": sql(f"select drive, count(*) as n, round(sum(importance::decimal(18,6))::double / count(*), 6) as importance from ({_DRIVES}) group by 1"),
    "several_anomalies": "with b as (select *, avg(value) over w as mean, stddev_samp(value) over w as std, count(value) over w as n from events window w as (partition by event_type order by ts, event_id rows between 50 preceding and 1 preceding)) select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(distinct event_type) as n_domains, count(*) as n from b where n >= 20 and std > 0 and abs((value - mean) / std) > 2 group by 1 having count(distinct event_type) >= 2",
    "expanded_hits": sql("") + ", " + retrieval._F + ", hit as (select lower(id) as id, round(score, 6) as score from (select id, score from ft order by score desc, id limit 25)), bo as (select source_id as id, target_id as other, strength from hl where source_id <> target_id and strength >= 0.2 union all select target_id, source_id, strength from hl where source_id <> target_id and strength >= 0.2), nr as (select other as id, max(0.5::double * score * least(1.0::double, strength)) as score from bo join hit using (id) group by 1) select id, round(max(score), 6) as score, max(direct) as direct from (select *, true as direct from hit union all select *, false from nr) group by 1",
    "sparse_pairs": sql("") + f", p as ({knowledge.SQL['cluster_pairs']}), bo as (select a as x, a, b, score from p union all select b, a, b, score from p), k as (select distinct a, b, score from (select *, row_number() over (partition by x order by score desc, a, b) as r from bo) where r <= 5), fe as (select distinct lower(id) as id from m where memory_type = 'emotional') select a, b, round(score * case when a in (select id from fe) and b in (select id from fe) then 1.2::double else 1.0::double end, 6) as score from k",
    "synthesis_plan": sql("") + f", g as ({knowledge.SQL['namespace_gate']}), t as (select namespace, strftime(created, '%Y-%m') as month, memory_type, count(*) as k, sum(length(coalesce(content, ''))) as chars from m group by 1, 2, 3), mn as (select namespace, month, arg_min(memory_type, (-k, memory_type)) as main, sum(chars)::bigint as chars from t group by 1, 2) select namespace, month, n, case when main = 'causal' then 'causal_chain' when main = 'procedural' then 'pattern' when main in ('episodic', 'emotional') then 'timeline' else 'general' end as template, chars, row_number() over (partition by namespace order by n desc, month) as place from g join mn using (namespace, month) where decision = 'synthesize'",
    "substrate_backfill": sql("") + ", " + retrieval._VEC.split(", vs as")[0].split(",\n qv")[0] + " select kind, count(*) as n from (select 'node_embedding' as kind from us union all select 'deleted_node' from m where deleted_at is not null union all select 'superseded_edge' from m where trim(coalesce(superseded_by, '')) <> '' union all select 'contradicted_edge' from m where trim(coalesce(contradicted_by, '')) <> '' union all select 'triple' from er) group by 1",
    "export_rates": "select producer, count(distinct file_no) as n_files, count(distinct (file_no, line_no)) as n_lines, round(case when s > 0 then count(distinct (file_no, line_no)) / (s / 3600.0::double) end, 4) as per_hour from (select *, floor(epoch(max(delivered_at) over (partition by producer))) - floor(epoch(min(delivered_at) over (partition by producer))) as s from memory_exports) group by producer, s",
}
