"""Rolling statistics: emotional trends, action outcomes, anomalies, alignment with drives, notifications, access rights."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions.common import ns, table
from palimpsest.sources import store
from palimpsest.sources.store import sql


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "behavior_log").select("id", "action", "outcome", ns().alias("namespace"), "loaded_at")


def action_stats(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy("action").agg(F.count("*").alias("total"), F.sum("outcome").alias("positive"), F.round(F.avg("outcome"), 6).alias("score"))


def should_deprioritize(spark: SparkSession, d: str) -> DataFrame:
    """Actions of a namespace with at least ten outcomes of which under half succeed; and the successful ones."""
    g = _log(spark, d).groupBy("namespace", "action").agg(F.count("*").alias("total"), F.avg("outcome").alias("score")).filter("total >= 10")
    return g.select("namespace", "action", "total", F.round("score", 6).alias("score"), F.when(F.col("score") < 0.5, "deprioritize").when(F.col("score") >= 0.8, "successful").otherwise("keep").alias("advice"))


def latest(log: DataFrame, n: int, *by: str) -> DataFrame:
    """The last n rows of each key. A limit pushed below the exchange keeps a hot key's sort small (window group limit)."""
    r = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("loaded_at"), F.desc("id")))
    return log.withColumn("r", r).filter(F.col("r") <= n)


def action_score_last20(spark: SparkSession, d: str) -> DataFrame:
    return latest(_log(spark, d), 20, "action").groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("outcome"), 6).alias("score"))


def recent_logs(spark: SparkSession, d: str) -> DataFrame:
    return latest(_log(spark, d), 5, "namespace", "action").select("namespace", "action", "id", "outcome", F.col("r").cast("bigint").alias("rank"))


def prune_old_logs(spark: SparkSession, d: str) -> DataFrame:
    """What stays when each action keeps its last 100 rows."""
    return latest(_log(spark, d), 100, "action").select("id", "action")


def emotional_trends(spark: SparkSession, d: str) -> DataFrame:
    """Event-weighted mean valence, clamped to ±1, of each area of life."""
    t = table(spark, d, "emotional_trends").dropDuplicates(["domain"])
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("valence")))
    area = F.split("domain", "/")[0]
    g = t.groupBy(area.alias("area")).agg(F.sum("event_count").alias("n_events"), (F.sum(v * F.col("event_count")) / F.sum("event_count")).alias("mean"))
    text = F.when(F.col("mean") > 0.3, "positive").when(F.col("mean") < -0.3, "negative").otherwise("neutral")
    return g.select("area", "n_events", F.round("mean", 6).alias("mean_valence"), text.alias("band"))


def trends_needing_update(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "emotional_trends").dropDuplicates(["domain"]).filter("event_count >= 10 and valence < -0.5")
    strength = 0.7 * F.abs("valence") + 0.3 * F.least(F.col("event_count") / 20, F.lit(1.0))
    return t.select("domain", "event_count", "valence", F.round(strength, 6).alias("signal"), F.round(F.col("valence") * 0.9, 9).alias("decayed_valence"))


def _metric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("metric"), "value")


def in_chunks(df: DataFrame, key: str, order: Sequence[str], size: int, rows: int = 10_000) -> DataFrame:
    """``df`` with ``_chunk`` and ``_own``, for windows over the ``size`` rows before each one that no task sorts a whole key for.

    A row's position within its key comes from the counts of the days before and
    its place within its day; each ``rows`` positions are a chunk, which also
    gets a copy (not ``_own``) of the ``size`` rows before it. ``order`` starts
    with a timestamp.
    """
    day = F.date_trunc("day", order[0])
    x = df.withColumn("_day", day)
    counts = x.groupBy(F.col(key).alias("_k"), F.col("_day").alias("_d")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("_k").orderBy("_d")) - F.col("_n")).drop("_n")  # a row a day
    x = x.join(before, F.col(key).eqNullSafe(F.col("_k")) & F.col("_day").eqNullSafe(F.col("_d"))).drop("_k", "_d")
    at = F.col("_before") + F.row_number().over(W.partitionBy(key, "_day").orderBy(*order)) - 1
    rows = max(rows, size)
    x = x.withColumn("_at", at).withColumn("_home", F.floor(F.col("_at") / rows))
    ahead = F.col("_at") >= (F.col("_home") + 1) * rows - size
    x = x.withColumn("_chunk", F.explode(F.when(ahead, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    return x.withColumn("_own", F.col("_chunk") == F.col("_home")).drop("_day", "_before", "_at", "_home")


def baselines(df: DataFrame, metric: str, order: Sequence[str], value: str, size: int = 100) -> DataFrame:
    """Mean, sample deviation and count of the ``size`` values before each one."""
    w = W.partitionBy(metric, "_chunk").orderBy(*order).rowsBetween(-size, -1)
    x = in_chunks(df, metric, order, size)
    return x.withColumn("mean", F.avg(value).over(w)).withColumn("std", F.stddev_samp(value).over(w)).withColumn("n", F.count(value).over(w)).filter("_own").drop("_chunk", "_own")


def direction(value: Column, mean: Column, std: Column, n: Column, sigma: float, least: int) -> Column:
    """normal, high or low; with no deviation any other value counts."""
    s = F.coalesce(std, F.lit(0.0))
    high, low = F.when(s == 0, value > mean).otherwise((value - mean) / s > sigma), F.when(s == 0, value < mean).otherwise((value - mean) / s < -sigma)
    return F.when(n < least, "normal").when(high, "high").when(low, "low").otherwise("normal")


def anomaly_flags(spark: SparkSession, d: str) -> DataFrame:
    b = baselines(_metric(spark, d), "metric", ("ts", "event_id"), "value")
    z = F.when((F.col("n") == 0) | (F.coalesce("std", F.lit(0.0)) == 0), 0.0).otherwise((F.col("value") - F.col("mean")) / F.col("std"))
    return b.select("event_id", F.round("mean", 9).alias("mean"), F.round("std", 8).alias("std"), "n", F.round(z, 7).alias("z"), direction(F.col("value"), F.col("mean"), F.col("std"), F.col("n"), 2.0, 5).alias("direction"))


def nearest_ranks(df: DataFrame, key: str, value: str, shares: Sequence[float], cells: int = 1024) -> DataFrame:
    """(key, p, value): the value at rank round(p (n - 1)) of each key, exactly, without sorting a key's whole history in one task.

    A histogram of ``cells`` equal cells between a key's least and greatest
    value tells in which cell each rank lies; only the values of those cells are
    ranked. Nulls are left out.
    """
    x = df.filter(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    span = x.groupBy("_k").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
    width = F.col("hi") - F.col("lo")
    cell = F.when(width > 0, F.least(F.lit(cells - 1), F.floor((F.col("_v") - F.col("lo")) / width * cells))).otherwise(0).cast("int")
    x = x.join(span, "_k").select("_k", "_v", cell.alias("cell"))
    counts = x.groupBy("_k", "cell").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("_k").orderBy("cell")) - F.col("c")  # at most ``cells`` rows a key
    ranks = span.select("_k", "n", F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("p")).withColumn("rank", F.floor(F.col("p") * (F.col("n") - 1) + 0.5))
    hit = counts.withColumn("before", before).join(ranks, "_k").filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))).select("_k", "cell", "p", (F.col("rank") - F.col("before")).alias("rank"))
    inside = x.join(hit.select("_k", "cell").distinct(), ["_k", "cell"], "left_semi")
    placed = inside.withColumn("i", F.row_number().over(W.partitionBy("_k", "cell").orderBy("_v")) - 1)
    return placed.join(hit, ["_k", "cell"]).filter(F.col("i") == F.col("rank")).select(F.col("_k").alias(key), "p", F.col("_v").alias(value))


def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """The value at rank round(p (n - 1)) of each metric."""
    return nearest_ranks(_metric(spark, d), "metric", "value", (0.5, 0.9, 0.95, 0.99)).select("metric", "p", "value")


def adaptive_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Deviation level of each metric's last value from its own mean and population deviation, once calibrated."""
    g = _metric(spark, d).groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.sqrt(F.var_pop("value")).alias("sd"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    dev = F.abs(F.col("last") - F.col("mean")) / F.col("sd")
    level = F.when((F.col("n") < 20) | (F.col("sd") == 0), "uncalibrated").when(dev < 1.5, "normal").when(dev < 2.5, "elevated").when(dev < 3.5, "high").otherwise("extreme")
    return g.select("metric", "n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), F.round(dev, 5).alias("deviation"), level.alias("level"))


#: Fixed values of the example: drives and their keywords.
DRIVES = [("reliability", ["retry", "recover", "restart"]), ("memory", ["archive", "buffer", "cache"]), ("quality", ["test", "review", "audit"])]


def alignment(content: Column, drives: Sequence[tuple[str, Sequence[str]]] = DRIVES) -> Column:
    """Mean over the drives that match of (matched keywords / 3, at most 1); 0 if none does."""
    low = F.lower(F.coalesce(content, F.lit("")))
    scores = [F.least(F.lit(1.0), sum((F.contains(low, F.lit(k)).cast("int") for k in words), F.lit(0)) / 3.0) for _, words in drives]
    total = sum(scores, F.lit(0.0))
    n = sum(((s > 0).cast("int") for s in scores), F.lit(0))
    return F.when(n > 0, total / n).otherwise(0.0)


def drive_alignment(spark: SparkSession, d: str) -> DataFrame:
    m = store.memories(spark, d, "content", "importance")
    a = alignment(F.col("content"))
    return m.select("id", F.round(a, 6).alias("alignment"), F.round(F.least(F.lit(1.0), F.col("importance") * (1 + 0.5 * a)), 6).alias("boosted"))


def notifications(spark: SparkSession, d: str) -> DataFrame:
    """For standing queries (namespace, least importance) and a cursor: new memories, newest first, each once an agent."""
    subs = [("agent-a", "atlas", 0.5), ("agent-a", "*", 0.9), ("agent-b", "harbor", 0.3)]
    s = spark.createDataFrame(subs, "agent string, sub_ns string, least double")
    cursor = datetime.datetime(2025, 6, 1)
    m = store.memories(spark, d, "importance", "deleted_at").filter((F.col("created") > F.lit(cursor)) & F.col("deleted_at").isNull())
    hit = m.join(s, ((F.col("sub_ns") == "*") | (F.col("sub_ns") == F.col("namespace"))) & (F.col("importance") >= F.col("least")))
    return hit.select("agent", "id", "importance", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created")).distinct()


def acl_filter(spark: SparkSession, d: str) -> DataFrame:
    """Memories that each agent may read: its own grants and those on every namespace."""
    grants = [("agent-a", "atlas", "read"), ("agent-a", "harbor", "write"), ("agent-b", "*", "admin"), ("agent-c", "quarry", "none")]
    g = spark.createDataFrame(grants, "agent string, grant_ns string, permission string").filter(F.col("permission").isin("read", "write", "admin"))
    m = store.memories(spark, d)
    hit = m.join(g, (F.col("grant_ns") == "*") | (F.col("grant_ns") == F.col("namespace")))
    return hit.groupBy("agent", "namespace").agg(F.countDistinct("id").alias("n_readable"))


def turn_window_context(spark: SparkSession, d: str) -> DataFrame:
    """Each memory with the types of the four before it in its namespace."""
    m = in_chunks(store.memories(spark, d, "memory_type").select("id", "namespace", "created", "memory_type"), "namespace", ("created", "id"), 4)
    w = W.partitionBy("namespace", "_chunk").orderBy("created", "id").rowsBetween(-4, -1)
    return m.select("id", F.array_join(F.collect_list("memory_type").over(w), ",").alias("context"), "_own").filter("_own").drop("_own")


def metacognition_report(spark: SparkSession, d: str) -> DataFrame:
    """Over the last 500 events of each type: mean, share of empty ones, nearest-rank p95."""
    e = _metric(spark, d).withColumn("r", F.row_number().over(W.partitionBy("metric").orderBy(F.desc("ts"), F.desc("event_id")))).filter("r <= 500")
    e = e.withColumn("i", F.row_number().over(W.partitionBy("metric").orderBy("value", "event_id")) - 1).withColumn("n", F.count("*").over(W.partitionBy("metric")))
    p95 = F.max(F.when(F.col("i") == F.floor(0.95 * (F.col("n") - 1) + 0.5), F.col("value")))
    return e.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.avg((F.col("value") < 10).cast("int")), 6).alias("empty_rate"), p95.alias("p95"))


def domain_ewma(spark: SparkSession, d: str) -> DataFrame:
    """Exponentially weighted valence (alpha 0.3) of each action's outcomes in order, folded over its last 100 signals."""
    rows = latest(_log(spark, d), 100, "action")
    seq = rows.groupBy("action").agg(F.array_sort(F.collect_list(F.struct("loaded_at", "id", "outcome"))).alias("x"))  # at most 100 a key
    fold = F.aggregate("x", F.lit(0.0), lambda s, e: s * 0.7 + 0.3 * (2.0 * e["outcome"] - 1.0))
    return seq.select("action", F.round(fold, 6).alias("valence"))


QUERIES = {
    f.__name__: f
    for f in (
        action_stats, should_deprioritize, action_score_last20, recent_logs, prune_old_logs, emotional_trends, trends_needing_update, anomaly_flags, percentile_nearest_rank, adaptive_baseline,
        drive_alignment, notifications, acl_filter, turn_window_context, metacognition_report, domain_ewma,
    )
}

_LAST = "(select *, row_number() over (partition by {0} order by loaded_at desc, id desc) as r from behavior_log)"
_MET = "met as (select event_id, ts, event_type as metric, value from events)"
_drive = ["least(1.0::double, (" + " + ".join(f"contains(t, '{k}')::int" for k in words) + ") / 3.0::double)" for _, words in DRIVES]
_ALIGN = f"(case when {' + '.join(f'({x} > 0)::int' for x in _drive)} > 0 then ({' + '.join(_drive)}) / ({' + '.join(f'({x} > 0)::int' for x in _drive)}) else 0.0::double end)"
SQL = {
    "action_stats": "select action, count(*) as total, sum(outcome)::bigint as positive, round(avg(outcome), 6) as score from behavior_log group by 1",
    "should_deprioritize": "select namespace, action, total, round(score, 6) as score, case when score < 0.5 then 'deprioritize' when score >= 0.8 then 'successful' else 'keep' end as advice from (select coalesce(namespace, 'default') as namespace, action, count(*) as total, avg(outcome) as score from behavior_log group by 1, 2) where total >= 10",
    "action_score_last20": f"select action, count(*) as n, round(avg(outcome), 6) as score from {_LAST.format('action')} where r <= 20 group by 1",
    "recent_logs": f"select coalesce(namespace, 'default') as namespace, action, id, outcome, r as rank from {_LAST.format(chr(99) + 'oalesce(namespace, ' + chr(39) + 'default' + chr(39) + '), action')} where r <= 5",
    "prune_old_logs": f"select id, action from {_LAST.format('action')} where r <= 100",
    "emotional_trends": "with t as (select distinct on (domain) * from emotional_trends), g as (select split_part(domain, '/', 1) as area, sum(event_count)::bigint as n_events, sum(greatest(-1.0::double, least(1.0::double, valence)) * event_count) / sum(event_count) as mean from t group by 1) select area, n_events, round(mean, 6) as mean_valence, case when mean > 0.3 then 'positive' when mean < -0.3 then 'negative' else 'neutral' end as band from g",
    "trends_needing_update": "select distinct domain, event_count, valence, round(0.7::double * abs(valence) + 0.3::double * least(event_count / 20, 1.0::double), 6) as signal, round(valence * 0.9::double, 9) as decayed_valence from emotional_trends where event_count >= 10 and valence < -0.5",
    "anomaly_flags": f"""with {_MET}, b as (select *, avg(value) over w as mean, stddev_samp(value) over w as std, count(value) over w as n from met window w as (partition by metric order by ts, event_id rows between 100 preceding and 1 preceding))
      select event_id, round(mean, 9) as mean, round(std, 8) as std, n, round(case when n = 0 or coalesce(std, 0) = 0 then 0.0::double else (value - mean) / std end, 7) as z,
      case when n < 5 then 'normal' when (case when coalesce(std, 0) = 0 then value > mean else (value - mean) / std > 2 end) then 'high' when (case when coalesce(std, 0) = 0 then value < mean else (value - mean) / std < -2 end) then 'low' else 'normal' end as direction from b""",
    "percentile_nearest_rank": f"with {_MET}, r as (select *, row_number() over (partition by metric order by value, event_id) - 1 as i, count(*) over (partition by metric) as n from met) select metric, p, value from r, (select unnest([0.5::double, 0.9::double, 0.95::double, 0.99::double]) as p) where i = floor(p * (n - 1) + 0.5::double)",
    "adaptive_baseline": f"with {_MET}, g as (select metric, count(*) as n, avg(value) as mean, sqrt(var_pop(value)) as sd, arg_max(value, row(ts, event_id)) as last from met group by 1) select metric, n, round(mean, 5) as mean, round(sd, 5) as sd, round(abs(last - mean) / sd, 5) as deviation, case when n < 20 or sd = 0 then 'uncalibrated' when abs(last - mean) / sd < 1.5 then 'normal' when abs(last - mean) / sd < 2.5 then 'elevated' when abs(last - mean) / sd < 3.5 then 'high' else 'extreme' end as level from g",
    "drive_alignment": sql("") + f", x as (select *, lower(coalesce(content, '')) as t from m) select id, round({_ALIGN}, 6) as alignment, round(least(1.0::double, importance * (1 + 0.5::double * {_ALIGN})), 6) as boosted from x",
    "notifications": sql("") + ", subs as (select * from (values ('agent-a', 'atlas', 0.5), ('agent-a', '*', 0.9), ('agent-b', 'harbor', 0.3)) t(agent, sub_ns, least_)) select distinct agent, id, importance, strftime(created, '%Y-%m-%d %H:%M:%S') as created from m join subs on (sub_ns = '*' or sub_ns = namespace) and importance >= least_ where created > timestamp '2025-06-01' and deleted_at is null",
    "acl_filter": sql("") + ", g as (select * from (values ('agent-a', 'atlas', 'read'), ('agent-a', 'harbor', 'write'), ('agent-b', '*', 'admin'), ('agent-c', 'quarry', 'none')) t(agent, grant_ns, permission) where permission in ('read', 'write', 'admin')) select agent, namespace, count(distinct id) as n_readable from m join g on grant_ns = '*' or grant_ns = namespace group by 1, 2",
    "turn_window_context": sql("select id, coalesce(string_agg(memory_type, ',') over (partition by namespace order by created, id rows between 4 preceding and 1 preceding), '') as context from m"),
    "metacognition_report": f"with {_MET}, e as (select * from (select *, row_number() over (partition by metric order by ts desc, event_id desc) as r from met) where r <= 500), f as (select *, row_number() over (partition by metric order by value, event_id) - 1 as i, count(*) over (partition by metric) as n from e) select metric, count(*) as n, round(avg(value), 5) as mean, round(avg((value < 10)::int), 6) as empty_rate, max(value) filter (i = floor(0.95::double * (n - 1) + 0.5::double)) as p95 from f group by 1",
    "domain_ewma": f"with x as (select action, outcome, r from {_LAST.format('action')} where r <= 100) select action, round(sum(0.3::double * (2.0::double * outcome - 1) * pow(0.7::double, r - 1)), 6) as valence from x group by 1",
}
