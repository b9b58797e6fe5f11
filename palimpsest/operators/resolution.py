"""Signals by which a mention is taken for an entity, predicates in their canonical form, and the rows that a resolution writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions.common import checkpoint
from palimpsest.operators.graph import PREDICATES
from palimpsest.operators.knowledge import VECTORS_SQL
from palimpsest.operators.retrieval import usable
from palimpsest.sources import store
from palimpsest.sources.store import seconds_between, sql

#: Weights of the signals, and the scores from which a mention is merged or deferred.
WEIGHTS = {"semantic": 0.25, "name": 0.30, "graph": 0.10, "recency": 0.05, "together": 0.10, "affect": 0.05, "identity": 0.10, "somatic": 0.05}
MERGE, DEFER = 0.85, 0.60
#: Canonical predicates with an inverse, and other names of some.
INVERSE = {"caused_by": "leads_to", "leads_to": "caused_by"}
SYNONYMS = {"relatedto": "related_to", "associated_with": "related_to"}
#: Keys of attributes that only the store may set.
RESERVED_KEYS = ["id", "namespace", "entity_type"]


def fuse(signals: dict[str, Column]) -> Column:
    """Weighted mean of the signals that are there."""
    have = sum((F.when(x.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, x in signals.items()), F.lit(0.0))
    total = sum((F.coalesce(WEIGHTS[k] * x, F.lit(0.0)) for k, x in signals.items()), F.lit(0.0))
    return F.when(have > 0, total / have).otherwise(0.0)


def fingerprint_match(a: list[Column], b: list[Column]) -> Column:
    """1 - distance / sqrt(8), as for fingerprints of eight places, at least 0; missing places must be given as numbers."""
    return F.greatest(F.lit(0.0), 1 - F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0))) / 8**0.5)


def mention_signals(spark: SparkSession, d: str) -> DataFrame:
    """Each mention measured against its entity by eight signals, fused, and the decision.

    semantic: the memory's vector and that of the entity's first memory; name:
    the name stands in the text; graph: names beside it and the entity's
    neighbours; recency: when the entity was last seen before; together: mean
    link strength of the memory; affect: importance against the mean of the
    entity's memories; identity: share of true hints (namespace, type, role);
    somatic: strengths of the memory against the entity's means.
    """
    me = checkpoint(store.mentions(spark, d).select("mention_id", "memory_id", "entity_id", "role").dropDuplicates(["mention_id"]))
    pair = me.select("memory_id", "entity_id").distinct()
    m = store.memories(spark, d, "content", "importance", "working_strength", "core_strength").select(F.lower("id").alias("memory_id"), F.col("namespace").alias("mns"), "created", "content", "importance", "working_strength", "core_strength")
    e = store.entities(spark, d).select(F.lower("id").alias("entity_id"), F.col("namespace").alias("ens"), F.lower(F.trim("name")).alias("ename"), "entity_type", F.coalesce("last_seen", "first_seen").alias("seen"))
    v = usable(spark, d).groupBy(F.lower("id").alias("vid")).agg(F.min("v").alias("v"))
    means = pair.join(m, "memory_id").groupBy("entity_id").agg(*[F.avg(c).alias(f"avg_{c}") for c in ("importance", "working_strength", "core_strength")])
    first = pair.join(v, F.col("memory_id") == F.col("vid")).groupBy("entity_id").agg(F.min_by("v", "memory_id").alias("ev"))
    link = store.links(spark, d)
    strong = link.select(F.col("source_id").alias("memory_id"), "strength").unionByName(link.select(F.col("target_id").alias("memory_id"), "strength")).groupBy("memory_id").agg(F.avg("strength").alias("together"))
    r = store.relations(spark, d)
    near = r.select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("o")).unionByName(r.select(F.col("target_id").alias("entity_id"), F.col("source_id").alias("o"))).groupBy("entity_id").agg(F.collect_set("o").alias("around"))
    beside = pair.groupBy("memory_id").agg(F.collect_set("entity_id").alias("beside"))
    x = me.join(m, "memory_id").join(e, "entity_id").join(v, F.col("memory_id") == F.col("vid"), "left").join(first, "entity_id", "left").join(means, "entity_id").join(strong, "memory_id", "left").join(near, "entity_id", "left").join(beside, "memory_id")
    others = F.array_remove("beside", F.col("entity_id"))
    days = seconds_between(F.col("created"), F.col("seen")) / 86400.0
    hints = [(F.col("mns") == F.col("ens")), (F.coalesce("entity_type", F.lit("unknown")) != "unknown"), F.col("role").isNotNull()]
    both = lambda c: [F.col("importance"), F.col("working_strength"), F.col("core_strength")] if not c else [F.col("avg_importance"), F.col("avg_working_strength"), F.col("avg_core_strength")]
    signals = {
        "semantic": F.when(F.col("v").isNotNull() & F.col("ev").isNotNull(), (S.cosine(F.col("v"), F.col("ev")) + 1) / 2),
        "name": F.when(F.col("content").isNotNull() & (F.col("ename") != ""), F.contains(F.lower("content"), F.col("ename")).cast("double")),
        "graph": F.when((F.size(others) > 0) & (F.size("around") > 0), S.jaccard(others, F.col("around"))),
        "recency": F.when(days >= 0, F.pow(F.lit(2.0), -days / 30)),
        "together": F.col("together"),
        "affect": 1 - F.abs(F.col("importance") - F.col("avg_importance")) / 2,
        "identity": sum((h.cast("int") for h in hints), F.lit(0)) / len(hints),
        "somatic": fingerprint_match(both(False), both(True)),
    }
    x = x.select("mention_id", *[c.alias(k + "_s") for k, c in signals.items()])
    fused = F.round(fuse({k: F.col(k + "_s") for k in signals}), 6)
    x = x.withColumn("fused", fused)
    return x.select("mention_id", *[F.round(F.col(k + "_s"), 9).alias(k) for k in signals], "fused", F.when(F.col("fused") >= MERGE, "merge").when(F.col("fused") >= DEFER, "defer").otherwise("new").alias("decision"))


def canonical_predicate(label: Column) -> Column:
    """Lower case, hyphens and blanks as underscores, synonyms replaced."""
    key = F.regexp_replace(F.lower(F.trim(label)), r"[-\s]+", "_")
    out = key
    for name, canon in SYNONYMS.items():
        out = F.when(key == name, canon).otherwise(out)
    return out


def relation_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Predicates in use: canonical form, whether it is known, symmetric, and its inverse."""
    p = store.relations(spark, d).groupBy(canonical_predicate(F.col("relation")).alias("predicate")).agg(F.count("*").alias("n"))
    c = F.col("predicate")
    inverse = F.lit(None).cast("string")
    for name, other in INVERSE.items():
        inverse = F.when(c == name, other).otherwise(inverse)
    inverse = F.when(c.isin([x[0] for x in PREDICATES if x[2]]), c).otherwise(inverse)
    return p.select("predicate", "n", c.isin([x[0] for x in PREDICATES]).alias("known"), c.isin([x[0] for x in PREDICATES if x[2]]).alias("symmetric"), inverse.alias("inverse"))


def delta_rows(spark: SparkSession, d: str) -> DataFrame:
    """What each namespace's relations and entities write: rows by kind and a digest that is the same for the same rows in any order."""
    e = store.entities(spark, d).select("namespace", F.lit("entity").alias("kind"), F.concat_ws("|", "id", F.coalesce("name", F.lit(""))).alias("row"))
    r = store.relations(spark, d).select("namespace", F.lit("edge").alias("kind"), F.concat_ws("|", "source_id", canonical_predicate(F.col("relation")), "target_id").alias("row"))
    x = e.unionByName(r).withColumn("digest", F.substring(F.sha2("row", 256), 1, 12))
    return x.groupBy("namespace", "kind").agg(F.count("*").alias("n"), F.countDistinct("digest").alias("n_distinct"), F.min("digest").alias("least"), F.max("digest").alias("greatest"))


def delta_faults(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a delta must not hold: confidences that are no number, ends that are no entity, reserved attributes."""
    r, e = store.relations(spark, d), store.entities(spark, d)
    ids = e.select(F.lower("id").alias("k")).distinct()
    floats = r.filter(F.col("confidence").isNull() | F.isnan("confidence")).select(F.lit("float").alias("fault"), "id")
    ends = r.select("id", F.explode(F.array("source_id", "target_id")).alias("k")).join(ids, "k", "left_anti").select(F.lit("reference").alias("fault"), "id").distinct()
    keys = F.json_object_keys("attributes")
    attrs = e.filter(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in RESERVED_KEYS]))).select(F.lit("attribute").alias("fault"), "id")
    return floats.unionByName(ends).unionByName(attrs)


def novel_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Ends of relations that are no entity yet, as drafts: how often they occur and what kind their relations suggest."""
    r = store.relations(spark, d)
    ends = r.select(F.col("source_id").alias("name"), "relation").unionByName(r.select(F.col("target_id").alias("name"), "relation"))
    ids = store.entities(spark, d).select(F.lower("id").alias("name")).distinct()
    kind = F.when(F.max((F.col("relation") == "works_at").cast("int")) == 1, "person").otherwise("unknown")
    return ends.join(ids, "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"), kind.alias("kind"))


QUERIES = {f.__name__: f for f in (mention_signals, relation_predicates, delta_rows, delta_faults, novel_endpoints)}

_COS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform({0}, lambda z: z::double * z::double)) * list_sum(list_transform({1}, lambda z: z::double * z::double)))"
_CANON = "case regexp_replace(lower(trim(relation)), '[-\\s]+', '_', 'g') " + " ".join(f"when '{a}' then '{b}'" for a, b in SYNONYMS.items()) + " else regexp_replace(lower(trim(relation)), '[-\\s]+', '_', 'g') end"
_NAMES = ", ".join(f"'{p[0]}'" for p in PREDICATES)
_SYM = ", ".join(f"'{p[0]}'" for p in PREDICATES if p[2])
_HAVE = " + ".join(f"case when {k} is not null then {w}::double else 0 end" for k, w in WEIGHTS.items())
_TOTAL = " + ".join(f"coalesce({w}::double * {k}, 0)" for k, w in WEIGHTS.items())
SQL = {
    "mention_signals": sql("") + f""", {VECTORS_SQL}, mn as (select * from (select mention_id, memory_id, entity_id, role, row_number() over (partition by mention_id order by memory_id, entity_id) as rn from me) where rn = 1),
        pr as (select distinct memory_id, entity_id from mn), lm as (select lower(id) as memory_id, namespace as mns, created, content, importance, working_strength, core_strength from m), le as (select lower(id) as entity_id, namespace as ens, lower(trim(name)) as ename, entity_type, coalesce(last_seen, first_seen) as seen from en),
        mean as (select entity_id, avg(importance) as ai, avg(working_strength) as aw, avg(core_strength) as ac from pr join lm using (memory_id) group by 1), fv as (select entity_id, min_by(v, memory_id) as ev from pr join us on vid = memory_id group by 1),
        st as (select memory_id, avg(strength) as together from (select source_id as memory_id, strength from hl union all select target_id, strength from hl) group by 1), nr as (select entity_id, list(distinct o) as around from (select source_id as entity_id, target_id as o from er union all select target_id, source_id from er) group by 1), bs as (select memory_id, list(distinct entity_id) as beside from pr group by 1),
        x as (select mention_id, case when v is not null and ev is not null then ({_COS.format('v', 'ev')} + 1) / 2 end as semantic, case when content is not null and ename <> '' then contains(lower(content), ename)::int::double end as name,
          case when len(beside) > 1 and around is not null then len(list_intersect(list_filter(beside, lambda b: b <> mn.entity_id), around)) / (len(beside) - 1 + len(around) - len(list_intersect(list_filter(beside, lambda b: b <> mn.entity_id), around))) end as graph,
          case when epoch_us(created) // 1000000 >= epoch_us(seen) // 1000000 then pow(2.0::double, -((epoch_us(created) // 1000000 - epoch_us(seen) // 1000000) / 86400.0::double) / 30) end as recency, together, 1 - abs(importance - ai) / 2 as affect,
          ((mns = ens)::int + (coalesce(entity_type, 'unknown') <> 'unknown')::int + (role is not null)::int) / 3 as identity, greatest(0.0::double, 1 - sqrt(pow(importance - ai, 2) + pow(working_strength - aw, 2) + pow(core_strength - ac, 2)) / sqrt(8.0::double)) as somatic
          from mn join lm using (memory_id) join le on le.entity_id = mn.entity_id left join us on vid = mn.memory_id left join fv on fv.entity_id = mn.entity_id join mean on mean.entity_id = mn.entity_id left join st on st.memory_id = mn.memory_id left join nr on nr.entity_id = mn.entity_id join bs on bs.memory_id = mn.memory_id),
        f as (select *, round(case when {_HAVE} > 0 then ({_TOTAL}) / ({_HAVE}) else 0 end, 6) as fused from x)
        select mention_id, """ + ", ".join(f"round({k}, 9) as {k}" for k in WEIGHTS) + ", fused, case when fused >= 0.85 then 'merge' when fused >= 0.6 then 'defer' else 'new' end as decision from f",
    "relation_predicates": sql(f"select predicate, n, predicate in ({_NAMES}) as known, predicate in ({_SYM}) as symmetric, case when predicate in ({_SYM}) then predicate when predicate = 'caused_by' then 'leads_to' when predicate = 'leads_to' then 'caused_by' end as inverse from (select {_CANON} as predicate, count(*) as n from er group by 1)"),
    "delta_rows": sql(f"select namespace, kind, count(*) as n, count(distinct digest) as n_distinct, min(digest) as least, max(digest) as greatest from (select namespace, kind, substring(sha256(r), 1, 12) as digest from (select namespace, 'entity' as kind, id || '|' || coalesce(name, '') as r from en union all select namespace, 'edge', source_id || '|' || {_CANON} || '|' || target_id from er)) group by 1, 2"),
    "delta_faults": sql("select 'float' as fault, id from er where confidence is null or isnan(confidence) union all select distinct 'reference', id from (select id, source_id as k from er union all select id, target_id from er) where k not in (select lower(id) from en) union all select 'attribute', id from en where json_valid(attributes) and (json_exists(attributes, '$.id') or json_exists(attributes, '$.namespace') or json_exists(attributes, '$.entity_type'))"),
    "novel_endpoints": sql("select name, count(*) as n, case when max((relation = 'works_at')::int) = 1 then 'person' else 'unknown' end as kind from (select source_id as name, relation from er union all select target_id, relation from er) where name not in (select lower(id) from en) group by 1"),
}
