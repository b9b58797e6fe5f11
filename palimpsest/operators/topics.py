"""Topics compiled from memories: candidates, neighbour graphs, pages, quality, conflicts, merging and splitting, sections, digests.

A topic here is an entity with the memories that mention it (three or more);
``discover_topics`` finds others as communities of close vectors.
"""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions.common import checkpoint, table
from palimpsest.operators import vector_join
from palimpsest.operators.components import pairs_within
from palimpsest.operators.knowledge import SQL as KNOWLEDGE_SQL
from palimpsest.operators.knowledge import VECTORS_SQL, label_propagation, memory_vectors, topic_overlap
from palimpsest.operators.vector_join import Best, Block
from palimpsest.sources import store
from palimpsest.sources.store import NOW, NOW_SQL, seconds_between, sql

#: Ledger rows of earlier runs, as the queries see them: namespace, status, the newest memory that was compiled, start.
RUNS = [
    ("atlas", "succeeded", "2025-03-01 00:00:00", "2025-03-02 00:00:00"), ("atlas", "failed", "2025-09-01 00:00:00", "2025-09-02 00:00:00"), ("atlas", "succeeded", "2025-05-01 00:00:00", "2025-05-02 00:00:00"),
    ("harbor", "succeeded", "2024-12-01 00:00:00", "2024-12-02 00:00:00"), ("quarry", "running", "2025-08-01 00:00:00", "2025-08-02 00:00:00"),
]
LEAST_IMPORTANCE, MOST_CANDIDATES, LEAST_COSINE = 0.3, 200, 0.6
MERGE_FROM, LINK_FROM, MOST_POINTS = 0.6, 0.2, 15
#: Words that say nothing of a page's content.
STOP = "the and for are but not with this that from was were has have had its into over under after before than then they their there which who will would can could may only also".split()
COMPILED = datetime.datetime(2025, 6, 1)


def watermarks(runs: DataFrame) -> DataFrame:
    """(namespace, mark): the high-water mark of each namespace's last run that succeeded."""
    return runs.filter("status = 'succeeded'").groupBy("namespace").agg(F.max_by("high_water", "started_at").alias("mark"))


def neighbours_of(n: Column) -> Column:
    """How many neighbours a graph of n vectors takes: the root of n, from 3 to 10."""
    return F.least(F.lit(10), F.greatest(F.lit(3), F.floor(F.sqrt(n)))).cast("int")


def compile_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What the next compile of each namespace takes: important memories since its watermark, the newest first."""
    runs = spark.createDataFrame(RUNS, "namespace string, status string, high_water string, started_at string")
    marks = watermarks(runs).select("namespace", F.col("mark").cast("timestamp_ntz").alias("mark"))
    m = store.memories(spark, d, "importance", "deleted_at").filter(F.col("deleted_at").isNull() & (F.col("importance") >= LEAST_IMPORTANCE)).join(marks, "namespace", "left")
    m = m.filter(F.col("mark").isNull() | (F.col("created") >= F.col("mark")))
    r = F.row_number().over(W.partitionBy("namespace").orderBy(F.desc("created"), "id"))
    return m.withColumn("place", r).filter(F.col("place") <= MOST_CANDIDATES).select("namespace", F.col("place").cast("bigint").alias("place"), F.lower("id").alias("id"))


def mutual_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one namespace that are among the nearest of each other, by cosine, from 0.6 on."""
    m = store.memories(spark, d, "deleted_at").filter("deleted_at is null").groupBy(F.lower("id").alias("id")).agg(F.min("namespace").alias("namespace"))
    v = checkpoint(memory_vectors(spark, d).join(m, "id"))
    k = v.groupBy("namespace").agg(neighbours_of(F.count("*")).alias("k"))
    packed = vector_join.blocks(v.join(k, "namespace"), within=("namespace",), extra=("k",))
    if packed is None:
        return spark.createDataFrame([], "a string, b string, cosine double")

    class Nearest(Best):
        def __init__(self, left: Block):
            super().__init__(left, left.column("k"))

        def add(self, right: Block, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> None:
            super().add(right, i, j, np.round(cos, 6))

    # a cosine counts as it is rounded
    found = vector_join.fold_pairs(packed, LEAST_COSINE - 5e-7, Nearest, "id string, other string, score double")
    both = found.select(F.col("id").alias("a"), F.col("other").alias("b"), F.round("score", 6).alias("cosine")).filter(F.col("cosine") >= LEAST_COSINE).join(v.select(F.col("id").alias("a"), "namespace"), "a")
    r = F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    near = both.withColumn("r", r).join(k, "namespace").filter(F.col("r") <= F.col("k")).select("a", "b", "cosine")
    one, two = near.filter("a < b"), near.filter("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return one.join(two, ["a", "b"]).select("a", "b", "cosine")


def discover_topics(spark: SparkSession, d: str, smallest: int = 3) -> DataFrame:
    """Communities of the mutual neighbours: their members and cohesion (mean cosine inside)."""
    e = checkpoint(mutual_neighbours(spark, d))
    lab = checkpoint(label_propagation(e.withColumnRenamed("cosine", "score")))
    inside = e.join(lab.select(F.col("id").alias("a"), "label"), "a").join(lab.select(F.col("id").alias("b"), F.col("label").alias("other")), "b").filter("label = other")
    cohesion = inside.groupBy("label").agg(F.avg("cosine").alias("cohesion"))
    size = lab.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= smallest)
    return size.join(cohesion, "label").select("label", "n", F.round("cohesion", 6).alias("cohesion"))


def members(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """(topic, id, ...) of topics with three memories and more."""
    me = store.mentions(spark, d).select("memory_id", "entity_id").distinct()
    m = store.memories(spark, d, *columns).withColumn("id", F.lower("id"))
    x = me.join(m, F.col("memory_id") == F.col("id")).withColumnRenamed("entity_id", "topic").drop("memory_id")
    return x.join(x.groupBy("topic").agg(F.count("*").alias("size")).filter("size >= 3").select("topic"), "topic", "left_semi")


def compiled_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each topic without a language model: title from its longest memory, the memories in order, summary, tags.

    Contents are appended in order of time; the digest stands for the page's text.
    """
    x = members(spark, d, "content", "memory_type").filter("trim(content) <> ''")
    words = lambda c: F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, 5), " ")
    g = x.groupBy("topic").agg(
        F.count("*").alias("n"), F.min_by("content", F.struct(-F.length("content"), F.col("id"))).alias("longest"), F.array_sort(F.collect_list(F.struct("created", "id", F.sha2("content", 256).alias("h")))).alias("parts"),
        F.min_by("content", F.struct("created", "id")).alias("first"), F.array_sort(F.collect_set("memory_type")).alias("tags"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["h"]), "\n")
    return g.select("topic", "n", words(F.col("longest")).alias("title"), F.sha2(text, 256).alias("digest"), F.length(F.split("first", r"\n\s*\n")[0]).cast("bigint").alias("summary_chars"), F.array_join("tags", ",").alias("tags"))


def topic_quality(spark: SparkSession, d: str) -> DataFrame:
    """0.4 coherence + 0.35 coverage + 0.25 freshness, less 0.05 for each contradicted source up to 0.2; the worst first."""
    x = members(spark, d, "content", "deleted_at", "contradicted_by")
    age = seconds_between(F.lit(NOW), F.col("created")) / 86400.0
    g = x.groupBy("topic").agg(
        F.avg(F.least(F.lit(1.0), F.length(F.coalesce("content", F.lit(""))) / 400.0)).alias("coherence"), F.avg(F.col("deleted_at").isNull().cast("int")).alias("coverage"), F.avg(1 / (1 + age / 30)).alias("freshness"),
        F.sum((F.trim(F.coalesce("contradicted_by", F.lit(""))) != "").cast("int")).alias("against"),
    )
    score = 0.4 * F.col("coherence") + 0.35 * F.col("coverage") + 0.25 * F.col("freshness") - F.least(F.lit(0.2), 0.05 * F.col("against"))
    g = g.select("topic", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("quality"), "against")
    worst = g.orderBy("quality", "topic").limit(100)
    return worst.withColumn("place", F.row_number().over(W.orderBy("quality", "topic")).cast("bigint"))


def page_words(content: Column) -> Column:
    """Distinct words of a page that say something: longer than two letters, not only digits, no stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(content), r"\s+"), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$") & ~w.isin(STOP)))


def topic_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Topics that share sources: how alike their contents are, what kind of conflict that is, and what to do."""
    p = topic_overlap(spark, d).filter("overlap > 0.15").select("topic", "other", "overlap")
    w = members(spark, d, "content").filter("content is not null").groupBy("topic").agg(F.array_distinct(F.flatten(F.collect_list(page_words(F.col("content"))))).alias("w"))
    x = p.join(w, "topic").join(w.select(F.col("topic").alias("other"), F.col("w").alias("w2")), "other")
    alike = F.round(S.jaccard(F.col("w"), F.col("w2")), 6)
    kind = F.when(F.greatest(F.col("overlap"), F.col("alike")) >= 0.6, "redundant").when(F.col("alike") < 0.3, "contradiction").otherwise("outdated")
    advice = F.when(F.col("kind") == "redundant", "merge into one topic").when(F.col("kind") == "contradiction", "review both").otherwise("compile again from the newest sources")
    return x.select("topic", "other", "overlap", alike.alias("alike")).withColumn("kind", kind).withColumn("advice", advice)


def topic_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """What to do with topics: merge those that share most sources, link those that share some, split those with too many points."""
    o = topic_overlap(spark, d)
    pairs = o.filter(F.col("overlap") >= LINK_FROM).select(F.when(F.col("overlap") >= MERGE_FROM, "merge").otherwise("link").alias("action"), "topic", "other", F.lit(0).cast("bigint").alias("parts"))
    n = members(spark, d).groupBy("topic").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_POINTS)
    return pairs.unionByName(n.select(F.lit("split").alias("action"), "topic", F.lit(None).cast("string").alias("other"), F.ceil(F.col("n") / MOST_POINTS).alias("parts")))


def split_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics with too many points cut into parts in order of time: the size and time span of each part.

    The parts come from ranks within slices of the topic, so a large topic is no single sort.
    """
    x = members(spark, d)
    big = x.groupBy("topic").agg(F.count("*").alias("size")).filter(F.col("size") > MOST_POINTS)
    x = x.join(big, "topic").withColumn("slice", F.date_format("created", "yyyy-MM"))
    counts = x.groupBy("topic", "slice").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(W.partitionBy("topic").orderBy("slice")) - F.col("c")).drop("c")
    place = F.row_number().over(W.partitionBy("topic", "slice").orderBy("created", "id")) - 1
    x = x.withColumn("at", place).join(before, ["topic", "slice"]).withColumn("part", F.floor((F.col("before") + F.col("at")) / MOST_POINTS) + 1)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return x.groupBy("topic", "part").agg(F.count("*").alias("n"), day(F.min("created")).alias("first"), day(F.max("created")).alias("last"))


def merged_topics(spark: SparkSession, d: str, least: float = LINK_FROM) -> DataFrame:
    """What merging topics gives, for pairs from ``least`` overlap on: the size of the union of their sources and the time of the newest."""
    p = topic_overlap(spark, d).filter(F.col("overlap") >= least).select("topic", "other")
    x = members(spark, d).select("topic", "id", "created")
    both = p.join(x, "topic").select("topic", "other", "id", "created").unionByName(p.join(x.withColumnRenamed("topic", "other"), "other").select("topic", "other", "id", "created"))
    return both.groupBy("topic", "other").agg(F.countDistinct("id").alias("n"), F.date_format(F.max("created"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


def topic_changes(spark: SparkSession, d: str) -> DataFrame:
    """Since a compile: sources added, removed and kept of each topic, and whether that is enough to compile again."""
    at = F.lit(COMPILED)
    x = members(spark, d, "deleted_at")
    g = x.groupBy("topic").agg(
        F.sum((F.col("created") > at).cast("int")).alias("added"), F.sum((F.coalesce(F.col("deleted_at") > at, F.lit(False)) & (F.col("created") <= at)).cast("int")).alias("removed"), F.sum((F.col("created") <= at).cast("int")).alias("known")
    )
    ratio = (F.col("added") + F.col("removed")) / F.greatest(F.lit(1), F.col("known"))
    return g.select("topic", "added", "removed", "known", F.when(ratio >= 0.5, "eager").when(ratio >= 0.3, "lazy").otherwise("skip").alias("trigger"))


def topic_report(spark: SparkSession, d: str) -> DataFrame:
    """The fleet of topics: how many are compiled again, how many sources are gone, and what to repair (the last source is only marked)."""
    x = members(spark, d, "deleted_at").groupBy("topic").agg(F.count("*").alias("n"), F.sum(F.col("deleted_at").isNotNull().cast("int")).alias("broken"))
    repair = F.when(F.col("broken") == 0, "none").when(F.col("n") - 1 > 1, "remove").otherwise("mark_stale")
    return x.groupBy(repair.alias("repair")).agg(F.count("*").alias("n_topics"), F.sum("n").alias("n_sources"), F.sum("broken").alias("n_broken"))


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings of pages with their level and place: where a page's sections begin."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    h = t.filter(F.col("x").rlike(r"^#{1,6} \S"))
    return h.select("doc_id", F.col("line").cast("bigint").alias("line"), F.length(F.regexp_extract("x", r"^(#+)", 1)).cast("bigint").alias("level"), F.trim(F.regexp_replace("x", r"^#+ ", "")).alias("heading"))


def dimension_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Memories of one namespace and type that share an entity and take opposite stances (importance over 0.7, under 0.3).

    More than a week apart is an evolution, less a contradiction. The memories of an entity meet in blocks.
    """
    m = store.memories(spark, d, "importance", "memory_type", "deleted_at").filter("deleted_at is null and (importance >= 0.7 or importance <= 0.3)")
    m = m.select(F.lower("id").alias("id"), F.concat_ws("|", "namespace", "memory_type").alias("domain"), "created", (F.col("importance") >= 0.7).alias("yes"))
    me = store.mentions(spark, d).select("memory_id", "entity_id").distinct().join(m, F.col("memory_id") == F.col("id"))
    p = pairs_within(me.select(F.concat_ws("|", "domain", "entity_id").alias("g"), "id").distinct(), "g", "id").select("a", "b").distinct()
    x = p.join(m.select(F.col("id").alias("a"), "domain", F.col("created").alias("ca"), F.col("yes").alias("ya")), "a").join(m.select(F.col("id").alias("b"), F.col("created").alias("cb"), F.col("yes").alias("yb")), "b").filter("ya <> yb")
    return x.select("a", "b", "domain", F.when(F.abs(seconds_between(F.col("ca"), F.col("cb"))) > 604800, "evolution").otherwise("contradiction").alias("kind"))


def feedback_digest(spark: SparkSession, d: str) -> DataFrame:
    """For each action the last five outcomes as text, newest first, and whether they ask for a compile."""
    log = table(spark, d, "behavior_log").dropDuplicates(["id"]).select("id", "action", "outcome", "loaded_at")
    last = log.withColumn("r", F.row_number().over(W.partitionBy("action").orderBy(F.desc("loaded_at"), F.desc("id")))).filter("r <= 5")
    g = last.groupBy("action").agg(F.array_sort(F.collect_list(F.struct("r", "outcome"))).alias("x"), F.sum((F.col("outcome") == 0).cast("int")).alias("bad"))
    return g.select("action", F.array_join(F.transform("x", lambda x: F.when(x["outcome"] == 1, "+").otherwise("-")), "").alias("digest"), (F.col("bad") >= 3).alias("compile_again"))


def access_audit(spark: SparkSession, d: str) -> DataFrame:
    """The newest ten accesses of each pinned memory."""
    m = store.memories(spark, d, "pinned").filter("pinned").select(F.lower("id").alias("memory_id"))
    a = store.accesses(spark, d).dropDuplicates(["access_id"]).join(m, "memory_id", "left_semi")
    r = F.row_number().over(W.partitionBy("memory_id").orderBy(F.desc("accessed_at"), F.desc("access_id")))
    return a.withColumn("place", r.cast("bigint")).filter("place <= 10").select("memory_id", "place", "access_id")


QUERIES = {
    f.__name__: f
    for f in (
        compile_candidates, mutual_neighbours, discover_topics, compiled_pages, topic_quality, topic_conflicts, topic_lifecycle, split_topics, merged_topics, topic_changes, topic_report, page_sections,
        dimension_conflicts, feedback_digest, access_audit,
    )
}

_MB = "mb0 as (select entity_id as topic, lower(m.id) as id, m.* exclude (id) from (select distinct memory_id, entity_id from me) join m on memory_id = lower(m.id)), mb as (select * from mb0 where topic in (select topic from mb0 group by 1 having count(*) >= 3))"
_OV = f"ov as ({KNOWLEDGE_SQL['topic_overlap']})"
_STOPS = ", ".join(f"'{w}'" for w in STOP)


def _q(ctes: str, body: str) -> str:
    return sql("") + ", " + ctes + " " + body


SQL = {
    "compile_candidates": _q("rn as (select * from (values " + ", ".join(str(r) for r in RUNS) + ") t(ns, status, high, started)), mk as (select ns, max_by(high, started)::timestamp as mark from rn where status = 'succeeded' group by 1)", "select namespace, place, lower(id) as id from (select namespace, id, row_number() over (partition by namespace order by created desc, id) as place from m left join mk on ns = namespace where deleted_at is null and importance >= 0.3 and (mark is null or created >= mark)) where place <= 200"),
    "mutual_neighbours": _q(VECTORS_SQL + """, lv as (select vid, v, namespace from us join (select lower(id) as id, min(namespace) as namespace from m where deleted_at is null group by 1) on id = vid), p as (select a.namespace, a.vid as a, b.vid as b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(a.v, lambda z: z::double * z::double)) * list_sum(list_transform(b.v, lambda z: z::double * z::double))), 6) as cosine from lv a join lv b on a.namespace = b.namespace and a.vid <> b.vid),
        k as (select namespace, least(10, greatest(3, floor(sqrt(count(*))))) as k from lv group by 1), n as (select a, b, cosine from (select *, row_number() over (partition by a order by cosine desc, b) as r from p where cosine >= 0.6) join k using (namespace) where r <= k)""", "select x.a, x.b, x.cosine from n x join n y on x.a = y.b and x.b = y.a where x.a < x.b"),
    "compiled_pages": _q(_MB, "select topic, count(*) as n, array_to_string(list_slice(regexp_split_to_array(trim(arg_min(content, (-length(content), id))), '\\s+'), 1, 5), ' ') as title, sha256(string_agg(sha256(content), chr(10) order by created, id)) as digest, length(regexp_split_to_array(arg_min(content, (created, id)), '\\n\\s*\\n')[1]) as summary_chars, array_to_string(list_sort(list(distinct memory_type)), ',') as tags from mb where trim(content) <> '' group by 1"),
    "topic_quality": _q(_MB + f", g as (select topic, avg(least(1.0::double, length(coalesce(content, '')) / 400.0::double)) as h, avg((deleted_at is null)::int) as c, avg(1 / (1 + (epoch_us({NOW_SQL}) // 1000000 - epoch_us(created) // 1000000) / 86400.0::double / 30)) as f, sum((trim(coalesce(contradicted_by, '')) <> '')::int)::bigint as against from mb group by 1), s as (select topic, round(greatest(0.0::double, least(1.0::double, 0.4::double * h + 0.35::double * c + 0.25::double * f - least(0.2::double, 0.05::double * against))), 6) as quality, against from g)", "select *, row_number() over (order by quality, topic) as place from s order by quality, topic limit 100"),
    "topic_conflicts": _q(_MB + f", {_OV}, ws as (select topic, list(distinct w) as w from (select topic, unnest(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: length(w) > 2 and not regexp_full_match(w, '\\d+') and w not in ({_STOPS}))) as w from mb where content is not null) group by 1), x as (select ov.topic, other, overlap, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) as alike from ov join ws a on a.topic = ov.topic join ws b on b.topic = other where overlap > 0.15), k as (select *, case when greatest(overlap, alike) >= 0.6 then 'redundant' when alike < 0.3 then 'contradiction' else 'outdated' end as kind from x)", "select *, case kind when 'redundant' then 'merge into one topic' when 'contradiction' then 'review both' else 'compile again from the newest sources' end as advice from k"),
    "topic_lifecycle": _q(_MB + ", " + _OV, "select case when overlap >= 0.6 then 'merge' else 'link' end as action, topic, other, 0::bigint as parts from ov where overlap >= 0.2 union all select 'split', topic, null, ceil(count(*) / 15)::bigint from mb group by topic having count(*) > 15"),
    "split_topics": _q(_MB + ", r as (select topic, created, row_number() over (partition by topic order by created, id) - 1 as i, count(*) over (partition by topic) as n from mb)", "select topic, (i // 15 + 1)::bigint as part, count(*) as n, strftime(min(created), '%Y-%m-%d') as \"first\", strftime(max(created), '%Y-%m-%d') as \"last\" from r where n > 15 group by 1, 2"),
    "merged_topics": _q(_MB + ", " + _OV, "select ov.topic, other, count(distinct id) as n, strftime(max(created), '%Y-%m-%d %H:%M:%S') as newest from ov join mb on mb.topic = ov.topic or mb.topic = other where overlap >= 0.2 group by 1, 2"),
    "topic_changes": _q(_MB + ", g as (select topic, sum((created > timestamp '2025-06-01')::int)::bigint as added, sum((coalesce(deleted_at > timestamp '2025-06-01', false) and created <= timestamp '2025-06-01')::int)::bigint as removed, sum((created <= timestamp '2025-06-01')::int)::bigint as known from mb group by 1)", "select *, case when (added + removed) / greatest(1, known) >= 0.5 then 'eager' when (added + removed) / greatest(1, known) >= 0.3 then 'lazy' else 'skip' end as trigger from g"),
    "topic_report": _q(_MB + ", g as (select topic, count(*) as n, sum((deleted_at is not null)::int) as broken from mb group by 1)", "select case when broken = 0 then 'none' when n - 1 > 1 then 'remove' else 'mark_stale' end as repair, count(*) as n_topics, sum(n)::bigint as n_sources, sum(broken)::bigint as n_broken from g group by 1"),
    "page_sections": "with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null), x as (select doc_id, i - 1 as line, ls[i] as x from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from l)) select doc_id, line, length(regexp_extract(x, '^(#+)', 1)) as level, trim(regexp_replace(x, '^#+ ', '')) as heading from x where regexp_matches(x, '^#{1,6} \\S')",
    "dimension_conflicts": _q("lm as (select lower(id) as id, namespace || '|' || memory_type as domain, created, importance >= 0.7 as yes from m where deleted_at is null and (importance >= 0.7 or importance <= 0.3)), p as (select distinct a.id as a, b.id as b, a.domain, abs(epoch_us(a.created) // 1000000 - epoch_us(b.created) // 1000000) as gap from lm a join me x on x.memory_id = a.id join me y on y.entity_id = x.entity_id join lm b on b.id = y.memory_id and b.domain = a.domain and a.id < b.id where a.yes <> b.yes)", "select a, b, domain, case when gap > 604800 then 'evolution' else 'contradiction' end as kind from p"),
    "feedback_digest": "with l as (select id, min(action) as action, min(outcome) as outcome, min(loaded_at) as loaded_at from behavior_log group by 1), r as (select *, row_number() over (partition by action order by loaded_at desc, id desc) as r from l) select action, string_agg(case outcome when 1 then '+' else '-' end, '' order by r) as digest, sum((outcome = 0)::int) >= 3 as compile_again from r where r <= 5 group by 1",
    "access_audit": _q("a as (select distinct access_id, memory_id, accessed_at from acc)", "select memory_id, place, access_id from (select *, row_number() over (partition by memory_id order by accessed_at desc, access_id desc) as place from a where memory_id in (select lower(id) from m where pinned)) where place <= 10"),
}
