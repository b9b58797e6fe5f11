"""From what plans find to scored rows: signals of each plan, factual scores with reserved rows, windows, caps, outcomes and metrics as text."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions.common import table
from palimpsest.operators import association, graph, retrieval
from palimpsest.sources import store
from palimpsest.sources.store import NOW, NOW_SQL, seconds_between, sql

#: What edges found and reserved rows add, and how many rows a plan may use.
EDGE_BONUS, RESERVED = 0.3, 0.5
CAPS = {"anchors": 5, "edges": 500, "candidates": 1000, "seeds": 10, "pool": 100}
#: The days that a dated question reserves rows for.
DATED = (datetime.datetime(2025, 6, 1), datetime.datetime(2025, 7, 1))


def edge_seeded(breadth: Column, seeded: Column, bonus: float = EDGE_BONUS) -> Column:
    return breadth * (1 - bonus) + F.when(seeded, bonus).otherwise(0.0)


def reserved_score(score: Column, reserved: Column) -> Column:
    return F.when(reserved, score * (1 - RESERVED) + RESERVED).otherwise(score)


def combine_factual(vector: Column, bm25: Column, graph_score: Column, recency: Column) -> Column:
    """Weighted mean of text, vector, graph and recency over what is there; text is 0.7 vector + 0.3 words, more where words count."""
    v, b = F.coalesce(vector, F.lit(0.0)), F.coalesce(bm25, F.lit(0.0))
    text = F.when(vector.isNotNull() | bm25.isNotNull(), F.least(F.lit(1.0), 0.7 * v + 0.3 * b + F.when(b > 0.05, 0.15).otherwise(0.0)))
    parts = [(0.25, text), (0.30, vector), (0.30, graph_score), (0.15, recency)]
    have = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts), F.lit(0.0))
    total = sum((F.when(x.isNotNull(), w * S.clamp01(x)).otherwise(0.0) for w, x in parts), F.lit(0.0))
    return F.when(have > 0, total / have).otherwise(0.0)


def factual_scored(spark: SparkSession, d: str) -> DataFrame:
    """Memories of the factual plan with their score; rows of the asked days are reserved and come first, by relevance."""
    g = graph.factual_plan(spark, d).select(F.col("memory_id").alias("k"), "graph_score")
    m = store.memories(spark, d, "content", "deleted_at").filter("deleted_at is null")
    words = retrieval.bm25(m.select("id", "content"), "content", retrieval.TERMS).select(F.col("id").alias("wid"), F.round(F.least(F.col("score") / 20, F.lit(1.0)), 6).alias("bm25"))
    seeded = store.relations(spark, d).select(F.col("source_id").alias("e")).distinct()
    edges = store.mentions(spark, d).join(seeded, F.col("entity_id") == F.col("e"), "left_semi").select(F.col("memory_id").alias("sk")).distinct().withColumn("seeded", F.lit(True))
    x = m.withColumn("k", F.lower("id")).join(g, "k").join(words, F.col("id") == F.col("wid"), "left").join(edges, F.col("k") == F.col("sk"), "left")
    reserved = (F.col("event_time") >= F.lit(DATED[0])) & (F.col("event_time") < F.lit(DATED[1]))
    gs = reserved_score(edge_seeded(F.col("graph_score"), F.coalesce("seeded", F.lit(False))), reserved)
    recency = F.pow(F.lit(0.5), seconds_between(F.lit(NOW), F.col("event_time")) / 3600.0 / 8760)
    x = x.select("id", reserved.alias("reserved"), F.coalesce("bm25", F.lit(0.0)).alias("relevance"), F.round(combine_factual(F.lit(None).cast("double"), F.col("bm25"), gs, recency), 6).alias("score"))
    first = F.when(F.col("reserved"), F.col("relevance")).otherwise(0.0)
    place = F.row_number().over(W.orderBy(F.desc("reserved"), F.desc(first), F.desc("score"), "id"))
    best = x.orderBy(F.desc("reserved"), F.desc(first), F.desc("score"), "id").limit(CAPS["candidates"])
    return best.select("id", "reserved", "score", place.cast("bigint").alias("place"))


def scored_plans(spark: SparkSession, d: str) -> DataFrame:
    """The rows of every plan as signals: graph, recency, text or mood."""
    row = lambda df, plan, key, signal, value: df.select(F.lit(plan).alias("plan"), F.col(key).cast("string").alias("id"), F.lit(signal).alias("signal"), F.round(value, 6).alias("value"))
    parts = [
        row(graph.factual_plan(spark, d), "factual", "memory_id", "graph", F.col("graph_score")),
        row(graph.episodic_plan(spark, d), "episodic", "id", "recency", F.col("recency")),
        row(graph.associative_plan(spark, d), "associative", "memory_id", "graph", F.pow(F.lit(0.5), F.col("distance"))),
        row(association.abstract_plan(spark, d), "abstract", "doc_id", "text", F.col("score")),
        row(association.affective_plan(spark, d), "affective", "id", "mood", F.col("score")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hybrid_scored(spark: SparkSession, d: str, k: float = 60.0) -> DataFrame:
    """Two strong plans fused by reciprocal ranks: the mood's and the topics' rows, as the plan hybrid runs them."""
    lists = scored_plans(spark, d).filter("plan in ('affective', 'abstract')")
    ranked = lists.withColumn("rank", F.row_number().over(W.partitionBy("plan").orderBy(F.desc("value"), "id")))
    return ranked.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank") - 1)), 9).alias("score"), F.count("*").alias("n_plans"))


def budget_caps(spark: SparkSession, d: str) -> DataFrame:
    """What each plan would use against its cap, and whether it is cut."""
    n = scored_plans(spark, d).groupBy("plan").agg(F.count("*").alias("used"))
    cap = F.when(F.col("plan") == "associative", CAPS["pool"]).when(F.col("plan") == "affective", CAPS["seeds"]).otherwise(CAPS["candidates"]).cast("bigint")
    return n.select("plan", "used", cap.alias("cap"), (F.col("used") > cap).alias("cut"))


def outcome(plan: Column, empty: Column, reason: Column) -> Column:
    """The label of a result: ok, no match, or why a plan gave way."""
    return F.when(reason == "no_time", F.lit("downgraded_from_episodic")).when(reason == "no_self_state", F.lit("downgraded_from_affective")).when(reason == "no_topics", F.lit("l5_unavailable")).when(empty & (plan == "factual"), F.lit("no_entity_found")).when(empty, F.lit("no_match")).otherwise(F.lit("ok"))


def plan_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Events as answered questions: their plan's outcome, counted. A value under 5 is an empty result, under 1 one without time."""
    e = table(spark, d, "events")
    plan = F.when(F.pmod("event_id", F.lit(3)) == 0, "factual").when(F.pmod("event_id", F.lit(3)) == 1, "episodic").otherwise("affective")
    reason = F.when((F.col("value") < 1) & (plan == "episodic"), "no_time").when((F.col("value") < 1) & (plan == "affective"), "no_self_state").otherwise("")
    return e.groupBy(plan.alias("plan"), outcome(plan, F.col("value") < 5, reason).alias("outcome")).agg(F.count("*").alias("n"))


def metrics_text(spark: SparkSession, d: str) -> DataFrame:
    """The counters in the text form that scrapers read, one line a row."""
    o = plan_outcomes(spark, d)
    lines = o.select(F.concat(F.lit('retrieval_total{plan="'), "plan", F.lit('",outcome="'), "outcome", F.lit('"} '), F.col("n").cast("string")).alias("line"))
    rate = o.groupBy("plan").agg(F.sum(F.when(F.col("outcome") != "ok", F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n"))
    rates = rate.select(F.concat(F.lit('retrieval_not_ok_total{plan="'), "plan", F.lit('"} '), F.col("bad").cast("string")).alias("line"))
    head = spark.createDataFrame([("# TYPE retrieval_total counter",), ("# TYPE retrieval_not_ok_total counter",)], "line string")
    return head.unionByName(lines).unionByName(rates)


#: Windows as a question may give them: name, kind, from, to, seconds.
WINDOWS = [
    ("none", "none", None, None, None), ("at", "at", "2025-05-01 12:00:00", None, None), ("range", "range", "2025-03-01 00:00:00", "2025-04-01 00:00:00", None), ("open_end", "range", "2025-03-01 00:00:00", None, None),
    ("open_start", "range", None, "2025-02-01 00:00:00", None), ("inverted", "range", "2025-04-01 00:00:00", "2025-03-01 00:00:00", None), ("relative", "relative", None, None, 604800),
]
EARLIEST = "2020-01-01 00:00:00"


def resolved_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each window as [start, end], inverted ones turned, and how many memories happened in it."""
    w = spark.createDataFrame(WINDOWS, "name string, kind string, a string, b string, seconds bigint")
    at = lambda c: c.cast("timestamp_ntz")
    now = F.lit(NOW).cast("timestamp_ntz")
    start = F.when(F.col("kind") == "at", at(F.col("a"))).when(F.col("kind") == "range", at(F.coalesce("a", F.lit(EARLIEST)))).when(F.col("kind") == "relative", (now - F.make_dt_interval(secs=F.col("seconds"))))
    end = F.when(F.col("kind") == "at", at(F.col("a"))).when(F.col("kind") == "range", F.coalesce(at(F.col("b")), now)).when(F.col("kind") == "relative", now)
    w = w.select("name", F.least(start, end).alias("start"), F.greatest(start, end).alias("end"))
    m = store.memories(spark, d, "deleted_at").filter("deleted_at is null").select("event_time")
    hits = m.join(w, (F.col("event_time") >= F.col("start")) & (F.col("event_time") <= F.col("end"))).groupBy("name").agg(F.count("*").alias("n"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return w.join(hits, "name", "left").select("name", text("start").alias("start"), text("end").alias("end"), F.coalesce("n", F.lit(0)).alias("n"))


def newest_of_entities(spark: SparkSession, d: str, most: int = 20) -> DataFrame:
    """The newest memories that mention each entity, at most ``most`` an entity, each memory once."""
    m = store.memories(spark, d, "deleted_at").filter("deleted_at is null").select(F.lower("id").alias("memory_id"), "created")
    x = store.mentions(spark, d).select("memory_id", "entity_id").distinct().join(m, "memory_id")
    r = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("created"), "memory_id"))
    return x.withColumn("r", r).filter(F.col("r") <= most).groupBy("memory_id").agg(F.count("*").alias("n_entities"))


QUERIES = {f.__name__: f for f in (factual_scored, scored_plans, hybrid_scored, budget_caps, plan_outcomes, metrics_text, resolved_windows, newest_of_entities)}

_P = {k: f"({v})" for k, v in (("factual", graph.SQL["factual_plan"]), ("episodic", graph.SQL["episodic_plan"]), ("associative", graph.SQL["associative_plan"]), ("abstract", association.SQL["abstract_plan"]), ("affective", association.SQL["affective_plan"]))}
_PLANS = (
    f"select 'factual' as plan, memory_id as id, 'graph' as signal, round(graph_score, 6) as value from {_P['factual']} union all select 'episodic', id, 'recency', round(recency, 6) from {_P['episodic']}"
    f" union all select 'associative', memory_id, 'graph', round(pow(0.5::double, distance), 6) from {_P['associative']} union all select 'abstract', doc_id::varchar, 'text', round(score, 6) from {_P['abstract']} union all select 'affective', id, 'mood', round(score, 6) from {_P['affective']}"
)
_OUT = """o as (select plan, case when value < 1 and plan = 'episodic' then 'downgraded_from_episodic' when value < 1 and plan = 'affective' then 'downgraded_from_affective' when value < 5 and plan = 'factual' then 'no_entity_found' when value < 5 then 'no_match' else 'ok' end as outcome, count(*) as n
    from (select value, case event_id % 3 when 0 then 'factual' when 1 then 'episodic' else 'affective' end as plan from events) group by 1, 2)"""
_BM = retrieval.SQL["bm25_documents"]
SQL = {
    "scored_plans": _PLANS,
    "hybrid_scored": f"select id, round(sum(1 / (60.0::double + rank - 1)), 9) as score, count(*) as n_plans from (select id, row_number() over (partition by plan order by value desc, id) as rank from ({_PLANS}) where plan in ('affective', 'abstract')) group by 1",
    "budget_caps": f"select plan, used, cap, used > cap as cut from (select plan, count(*) as used, (case plan when 'associative' then 100 when 'affective' then 10 else 1000 end)::bigint as cap from ({_PLANS}) group by 1)",
    "plan_outcomes": f"with {_OUT} select * from o",
    "metrics_text": f"with {_OUT} select 'retrieval_total{{plan=\"' || plan || '\",outcome=\"' || outcome || '\"}} ' || n as line from o union all select 'retrieval_not_ok_total{{plan=\"' || plan || '\"}} ' || coalesce(sum(n) filter (outcome <> 'ok'), 0)::bigint from o group by plan union all select '# TYPE retrieval_total counter' union all select '# TYPE retrieval_not_ok_total counter'",
    "resolved_windows": sql("") + ", w0 as (select * from (values " + ", ".join("(" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in w) + ")" for w in WINDOWS) + f""") t(name, kind, a, b, seconds)),
        w1 as (select name, case kind when 'at' then a::timestamp when 'range' then coalesce(a, '{EARLIEST}')::timestamp when 'relative' then {NOW_SQL} - to_seconds(seconds) end as s, case kind when 'at' then a::timestamp when 'range' then coalesce(b::timestamp, {NOW_SQL}) when 'relative' then {NOW_SQL} end as e from w0),
        w2 as (select name, least(s, e) as s, greatest(s, e) as e from w1) select name, strftime(s, '%Y-%m-%d %H:%M:%S') as start, strftime(e, '%Y-%m-%d %H:%M:%S') as "end", (select count(*) from m where deleted_at is null and event_time between s and e) as n from w2""",
    "newest_of_entities": sql("select memory_id, count(*) as n_entities from (select memory_id, row_number() over (partition by entity_id order by created desc, memory_id) as r from (select distinct memory_id, entity_id from me) join (select lower(id) as memory_id, created from m where deleted_at is null) using (memory_id)) where r <= 20 group by 1"),
    "factual_scored": sql("") + f""", fp as {_P['factual']}, lm as (select id, lower(id) as k, content, event_time from m where deleted_at is null),
        tk as (select id, regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+') as t from lm), st as (select count(*) as n, avg(len(t)) as avg_len, """ + ", ".join(f"sum((list_contains(t, '{q}'))::int) as d{i}" for i, q in enumerate(retrieval.TERMS)) + " from tk), ft as (select id, " + " + ".join(f"greatest(1e-6::double, ln((n - d{i} + 0.5::double) / (d{i} + 0.5::double))) * len(list_filter(t, lambda x: x = '{q}')) * 2.2::double / (len(list_filter(t, lambda x: x = '{q}')) + 1.2::double * (0.25::double + 0.75::double * len(t) / avg_len))" for i, q in enumerate(retrieval.TERMS)) + " as score from tk, st where " + " or ".join(f"list_contains(t, '{q}')" for q in retrieval.TERMS) + """),
        sd as (select distinct memory_id from me where entity_id in (select source_id from er)),
        x as (select lm.id, event_time >= timestamp '2025-06-01' and event_time < timestamp '2025-07-01' as reserved, case when score is not null then round(least(score / 20, 1.0::double), 6) end as b, graph_score * 0.7::double + (case when sd.memory_id is not null then 0.3::double else 0 end) as g0, pow(0.5::double, (epoch_us(now) // 1000000 - epoch_us(event_time) // 1000000) / 3600.0::double / 8760) as rec from lm join fp on fp.memory_id = k left join ft on ft.id = lm.id left join sd on sd.memory_id = k, now_),
        y as (select id, reserved, coalesce(b, 0) as rel, case when reserved then g0 * 0.5::double + 0.5::double else g0 end as g, b, rec from x),
        z as (select id, reserved, rel, round((case when b is not null then 0.25::double * least(1.0::double, 0.3::double * b + case when b > 0.05 then 0.15::double else 0 end) else 0 end + 0.3::double * least(greatest(g, 0), 1) + 0.15::double * least(greatest(rec, 0), 1)) / (case when b is not null then 0.7::double else 0.45::double end), 6) as score from y)
        select id, reserved, score, row_number() over (order by reserved desc, case when reserved then rel else 0 end desc, score desc, id) as place from z order by place limit 1000""",
}
