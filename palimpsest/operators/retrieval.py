"""Ranked retrieval: full text, vectors, fusion, and the seven-channel recall.

A query's terms are known before the data are read, so full-text scores need no
index of all tokens: each row yields the frequencies of those terms and its own
length, corpus counts come from one aggregation of the same columns, and only
rows with a term go on. Every ranking breaks ties by id.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions.common import table
from palimpsest.operators import activation as A
from palimpsest.sources import store
from palimpsest.sources.store import NOW, seconds_between, sql

K1, B = 1.2, 0.75
TERMS = ["retry", "counters", "queue", "archive"]
TOKEN = r"[\p{L}\p{N}]+"


def live(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Memories that a recall may return."""
    return store.memories(spark, d, "deleted_at", "superseded_by", *columns).filter("deleted_at is null and coalesce(superseded_by, '') = ''")


def query_terms(text: str) -> list[str]:
    """Distinct lower-cased runs of letters or digits; an empty query has none."""
    import re  # noqa: PLC0415

    return list(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))


def _frequency(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def bm25(docs: DataFrame, content: str, terms: Sequence[str]) -> DataFrame:
    """``docs`` with a positive score for rows that have a term; no terms, no rows."""
    if not terms:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(content), F.lit(""))), F.lit(TOKEN), 0)
    x = docs.withColumn("_tok", tokens).withColumn("_dl", F.size("_tok")).withColumn("_tf", F.array(*[_frequency("_tok", q) for q in terms])).drop("_tok")
    stats = x.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), F.array(*[F.sum((F.col("_tf")[i] > 0).cast("int")) for i in range(len(terms))]).alias("_df"))
    x = x.filter(F.exists("_tf", lambda t: t > 0)).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col("_tf")[i], F.col("_df")[i]
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_n") - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return x.withColumn("score", score).drop("_dl", "_tf", "_n", "_avg", "_df")


def top(df: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k best rows with their rank from 1; a top-k, not a global sort."""
    best = df.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))


def usable(spark: SparkSession, d: str, model: str = "nimbus-embed-64", dim: int = 64) -> DataFrame:
    e = table(spark, d, "memory_embeddings").filter((F.col("model") == model) & (F.size("embedding") == dim))
    ok = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return e.filter(ok & F.col("memory_id").isNotNull()).groupBy(F.col("memory_id").alias("id")).agg(F.min("embedding").alias("v"))


def vector_scores(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """``vectors`` with the cosine to the one row of ``query`` (column q)."""
    return vectors.join(F.broadcast(query)).withColumn("cosine", S.cosine(F.col("v"), F.col("q"))).drop("q")


def _query_vector(spark: SparkSession, d: str) -> DataFrame:
    return usable(spark, d).agg(F.min_by("v", "id").alias("q"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    t = top(bm25(live(spark, d, "content"), "content", TERMS), 25)
    return t.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    s = bm25(docs, "text", ["snapshot", "replica", "timeline", "audit"])
    return s.select("id", F.round("score", 6).alias("score"), F.round(F.least(F.col("score") / 20, F.lit(1.0)), 6).alias("bm25_score"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vector_scores(usable(spark, d), _query_vector(spark, d))
    t = top(v.withColumn("score", F.round("cosine", 6)), 25)
    return t.select("id", "score", F.round((F.col("cosine") + 1) / 2, 6).alias("vector_score"), F.col("rank").cast("bigint").alias("rank"))


def _lists(spark: SparkSession, d: str, n: int) -> tuple[DataFrame, DataFrame]:
    f = top(bm25(live(spark, d, "content"), "content", TERMS).withColumn("score", F.round("score", 6)), n).select("id", F.col("rank").alias("f_rank"))
    v = top(vector_scores(usable(spark, d), _query_vector(spark, d)).withColumn("score", F.round("cosine", 6)), n).select("id", F.col("rank").alias("v_rank"), F.col("score").alias("cos"))
    return f, v


def weighted(f: DataFrame, v: DataFrame, n: int, wv: Column | float, wf: Column | float) -> DataFrame:
    """Full outer join of both lists: rank score of the text, (cosine + 1) / 2 of the vector."""
    text = F.coalesce(1 - (F.col("f_rank") - 1) / n, F.lit(0.0))
    vec = F.coalesce((F.col("cos") + 1) / 2, F.lit(0.0))
    return f.join(v, "id", "full").withColumn("score", vec * wv + text * wf)


def hybrid_weighted(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    f, v = _lists(spark, d, 3 * k)
    return top(weighted(f, v, 3 * k, 0.7, 0.3), k).select("id", F.round("score", 6).alias("score"))


def hybrid_adaptive(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """Weights from the overlap (Jaccard) of the two top lists."""
    f, v = _lists(spark, d, 3 * k)
    sizes = f.join(v, "id", "full").agg((F.sum((F.col("f_rank").isNotNull() & F.col("v_rank").isNotNull()).cast("int")) / F.count("*")).alias("jac"))
    w = F.when(F.col("jac") >= 0.6, 0.5).when(F.col("jac") >= 0.3, 0.6).otherwise(0.7)
    x = f.join(v, "id", "full").join(F.broadcast(sizes.select(w.alias("wv"))))
    text = F.coalesce(1 - (F.col("f_rank") - 1) / (3 * k), F.lit(0.0))
    x = x.withColumn("score", F.coalesce((F.col("cos") + 1) / 2, F.lit(0.0)) * F.col("wv") + text * (1 - F.col("wv")))
    return top(x, k).select("id", F.round("score", 6).alias("score"), "wv")


def rrf(lists: Sequence[DataFrame], k: float, first: int) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) lists whose ranks start at 1; ``first`` is the rank that the formula starts at."""
    rows = lists[0].select("id", "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("id", "rank"))
    return rows.groupBy("id").agg(F.sum(1 / (k + F.col("rank") - 1 + first)).alias("score"))


def rrf_0based(spark: SparkSession, d: str) -> DataFrame:
    f, v = _lists(spark, d, 30)
    s = rrf([f.withColumnRenamed("f_rank", "rank"), v.withColumnRenamed("v_rank", "rank")], 60.0, 0)
    return s.select("id", F.round("score", 8).alias("score"))


def rrf_1based(spark: SparkSession, d: str) -> DataFrame:
    """Scaled by k + 1 and cut off at 1."""
    f, v = _lists(spark, d, 30)
    s = rrf([f.withColumnRenamed("f_rank", "rank"), v.withColumnRenamed("v_rank", "rank")], 60.0, 1)
    return s.select("id", F.round(F.least(F.lit(1.0), F.col("score") * 61), 8).alias("score"))


#: Fusion weights of text, graph, recency, activation, affect for each intent.
FUSION = {"factual": (0.40, 0.45, 0.15, 0.0, 0.0), "episodic": (0.55, 0.15, 0.30, 0.0, 0.0), "abstract": (0.60, 0.0, 0.15, 0.25, 0.0), "affective": (0.50, 0.0, 0.15, 0.0, 0.35)}


def combine(signals: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean over the signals that are there; 0 if none is."""
    total = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in zip(signals, weights)), F.lit(0.0))
    value = sum((F.coalesce(s, F.lit(0.0)) * w for s, w in zip(signals, weights)), F.lit(0.0))
    return F.when(total > 0, S.clamp01(value / total)).otherwise(0.0)


def combine_live_weights(spark: SparkSession, d: str) -> DataFrame:
    """All four intents over every memory's vector, strength and recency signals."""
    m = live(spark, d, "importance", "core_strength")
    v = vector_scores(usable(spark, d), _query_vector(spark, d)).select(F.col("id").alias("vid"), F.greatest(F.lit(0.0), F.round("cosine", 6)).alias("text"))
    x = m.join(v, F.col("id") == F.col("vid"), "left")
    hours = seconds_between(F.lit(NOW), F.col("event_time")) / 3600.0
    recency = F.pow(F.lit(0.5), hours / 24 / 365)
    sig = [F.col("text"), F.lit(None).cast("double"), recency, F.col("core_strength"), F.col("importance")]
    return x.select("id", *[F.round(combine(sig, w), 6).alias(k) for k, w in FUSION.items()])


def entity_channel(spark: SparkSession, d: str) -> DataFrame:
    """Memories by mentions of the entities that a query names: 1 each, 0.5 for those one relation away, over the largest."""
    e = store.entities(spark, d).filter(F.lower("name").contains("skor")).select(F.lower("id").alias("eid"))
    rel = store.relations(spark, d)
    near = rel.select(F.col("source_id").alias("x"), F.col("target_id").alias("y")).unionByName(rel.select(F.col("target_id").alias("x"), F.col("source_id").alias("y")))
    hop = near.join(e, F.col("x") == F.col("eid"), "left_semi").select(F.col("y").alias("eid")).distinct().join(e, "eid", "left_anti")
    w = e.withColumn("w", F.lit(1.0)).unionByName(hop.withColumn("w", F.lit(0.5)))
    s = store.mentions(spark, d).select("memory_id", "entity_id").distinct().join(w, F.col("entity_id") == F.col("eid")).groupBy(F.col("memory_id").alias("id")).agg(F.sum("w").alias("s"))
    best = s.agg(F.max("s").alias("top"))
    return s.join(F.broadcast(best)).select("id", F.round(F.col("s") / F.col("top"), 6).alias("score"))


def hebbian_channel(spark: SparkSession, d: str) -> DataFrame:
    """Links among the candidates of a full-text query, summed and scaled by the largest."""
    c = bm25(live(spark, d, "content"), "content", TERMS).select(F.lower("id").alias("c"))
    l = store.links(spark, d).filter("source_id <> target_id")
    l = l.join(c, F.col("source_id") == F.col("c"), "left_semi").join(c, F.col("target_id") == F.col("c"), "left_semi")
    s = l.select(F.col("source_id").alias("id"), "strength").unionByName(l.select(F.col("target_id").alias("id"), "strength")).groupBy("id").agg(F.sum("strength").alias("s"))
    return s.join(F.broadcast(s.agg(F.max("s").alias("top")))).select("id", F.round(F.col("s") / F.col("top"), 6).alias("score"))


#: Channel weights of the recall.
CHANNELS = {"fts": 0.15, "emb": 0.60, "actr": 0.25, "entity": 0.15, "temporal": 0.10, "hebbian": 0.10, "somatic": 0.08}
#: What a kind of query multiplies.
MODIFIERS = {"temporal": {"emb": 0.5, "actr": 2.0, "temporal": 3.0}, "keyword": {"fts": 3.0, "emb": 0.5, "entity": 2.0}, "semantic": {"emb": 1.5}, "general": {}}
#: Factors of factual, episodic, relational, emotional, procedural, opinion, causal for each intent.
AFFINITY = {
    "definition": (2.0, 0.5, 1.5, 0.3, 0.8, 0.5, 0.8), "howto": (0.8, 0.5, 0.5, 0.3, 2.5, 0.5, 1.0), "event": (0.5, 2.5, 0.8, 1.5, 0.3, 0.5, 0.8),
    "relational": (0.8, 0.5, 2.5, 1.5, 0.3, 1.5, 0.8), "context": (1.2, 1.8, 1.0, 0.8, 1.0, 0.8, 1.0), "general": (1.0,) * 7,
}


def channel_weights(kind: str) -> dict[str, float]:
    """Weights after the query's kind, summing to 1."""
    w = {c: x * MODIFIERS[kind].get(c, 1.0) for c, x in CHANNELS.items()}
    total = sum(w.values())
    return {c: (x / total if total else 1 / len(w)) for c, x in w.items()}


def recall_scores(spark: SparkSession, d: str, kind: str = "general", intent: str = "general") -> DataFrame:
    """Every live memory with the weighted sum of its channels (somatic has no marker here: 0)."""
    m = A.with_accesses(live(spark, d, "content", "memory_type", "importance", "contradicted_by"), store.accesses(spark, d))
    m = A.retrieval_activation(m, TERMS)
    f = bm25(live(spark, d, "content"), "content", TERMS).select(F.col("id").alias("k"), "score")
    f = f.join(F.broadcast(f.agg(F.max("score").alias("top")))).select("k", F.round(F.col("score") / F.col("top"), 6).alias("fts"))
    v = vector_scores(usable(spark, d), _query_vector(spark, d)).select(F.col("id").alias("k"), F.round(F.greatest(F.lit(0.0), F.col("cosine")), 6).alias("emb"))
    e = entity_channel(spark, d).select(F.col("id").alias("k"), F.col("score").alias("entity"))
    h = hebbian_channel(spark, d).select(F.col("id").alias("k"), F.col("score").alias("hebbian"))
    x = m.withColumn("k", F.lower("id"))
    for part in (f, v, e, h):
        x = x.join(part.withColumn("k", F.lower("k")), "k", "left")
    hours = seconds_between(F.lit(NOW), F.col("event_time")) / 3600.0
    x = x.withColumn("actr", S.normalize_activation(F.col("activation"))).withColumn("temporal", 0.3 + 0.4 * F.pow(F.lit(0.5), hours / 72)).withColumn("somatic", F.lit(0.0))
    w = channel_weights(kind)
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * y for c, y in w.items()), F.lit(0.0))
    factor = F.lit(1.0)
    for row, y in zip(S.MEMORY_TYPES, AFFINITY[intent]):
        factor = F.when(F.col("memory_type") == row[0], y).otherwise(factor)
    return x.withColumn("score", F.round(score * factor, 6))


def recall7(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """The flagship recall up to the candidates that are then thinned: the best 3 k."""
    t = top(recall_scores(spark, d, "keyword", "event"), 3 * k)
    return t.select("id", F.round("score", 5).alias("score"), "memory_type")


def greedy_dedup(candidates: DataFrame, threshold: float, k: int) -> DataFrame:
    """Keep rows in rank order unless their vector is within ``threshold`` of a kept one; rows without a vector stay.

    Order-dependent, so one task; the input is a top-k list of at most a few hundred rows by construction.
    """
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept, vectors = [], []
        for r in rows.sort_values("rank").itertuples():
            if len(kept) == k:
                break
            if r.v is not None:
                x = np.asarray(r.v, float)
                x = x / max(np.linalg.norm(x), 1e-12)
                if any(float(x @ y) > threshold for y in vectors):
                    continue
                vectors.append(x)
            kept.append((r.id, r.score))
        return pd.DataFrame(kept, columns=["id", "score"])

    return candidates.select("id", "rank", "score", "v", F.lit(0).alias("one")).groupBy("one").applyInPandas(run, "id string, score double")


def mmr(candidates: DataFrame, lam: float, k: int) -> DataFrame:
    """Maximal marginal relevance over a top-k list: (id, score, place)."""
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        vs = [None if v is None else np.asarray(v, float) / max(np.linalg.norm(v), 1e-12) for v in rows["v"]]
        left, out = list(range(len(rows))), []
        while left and len(out) < k:
            worth = lambda i: lam * rows["score"][i] - (1 - lam) * max([0.0, *(float(vs[i] @ vs[j]) for j in out if vs[i] is not None and vs[j] is not None)])
            best = max(left, key=lambda i: (worth(i), -i))
            out.append(best)
            left.remove(best)
        return pd.DataFrame({"id": [rows["id"][i] for i in out], "score": [rows["score"][i] for i in out], "place": list(range(1, len(out) + 1))})

    return candidates.select("id", "rank", "score", "v", F.lit(0).alias("one")).groupBy("one").applyInPandas(run, "id string, score double, place int")


def _candidates(spark: SparkSession, d: str, n: int) -> DataFrame:
    t = top(recall_scores(spark, d), n).select("id", "rank", "score")
    return t.join(usable(spark, d), "id", "left")


def recall_top10(spark: SparkSession, d: str) -> DataFrame:
    """The whole recall: channels, top 30, near-copies removed, ten left."""
    return greedy_dedup(_candidates(spark, d, 30), 0.85, 10)


def recall_mmr(spark: SparkSession, d: str) -> DataFrame:
    return mmr(_candidates(spark, d, 30), 0.7, 10)


TEMPORAL = r"(?i)\b(yesterday|today|tomorrow|last (week|month|year|night)|this (week|month|morning)|recently|ago|since|before|after|when)\b|\d{4}-\d{2}-\d{2}"
QUESTION = r"(?i)\b(what|why|how|who|where|which|explain|describe)\b"
CODE = r"[a-z][A-Z]|_|\d+\.\d+"
INTENTS = [("howto", r"(?i)\b(how (do|to|can)|steps?|procedure)\b"), ("event", r"(?i)\b(when|happened|meeting|incident|during|after the)\b"), ("relational", r"(?i)\b(who|owner|team|reports? to|together|both)\b"), ("definition", r"(?i)\b(what is|means?|define|is called|code name)\b"), ("context", r"(?i)\b(about|context|background|status)\b")]


def query_kind(q: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(q), r"\s+"), lambda w: w != ""))
    return F.when(q.rlike(TEMPORAL), "temporal").when((words <= 4) & q.rlike(CODE), "keyword").when(((words >= 5) & q.rlike(QUESTION)) | (words >= 7), "semantic").otherwise("general")


def query_intent(q: Column) -> Column:
    out = F.lit("general")
    for name, rx in reversed(INTENTS):
        out = F.when(q.rlike(rx), name).otherwise(out)
    return out


def classify_queries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries taken as queries: their kind and intent, counted."""
    q = F.coalesce("summary", F.lit(""))
    return store.memories(spark, d, "summary").groupBy(query_kind(q).alias("kind"), query_intent(q).alias("intent")).agg(F.count("*").alias("n"))


def query_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of each memory for the query from similarity, text hit and age, over what is known of it."""
    f = bm25(live(spark, d, "content"), "content", TERMS).select(F.col("id").alias("fid"))
    v = vector_scores(usable(spark, d), _query_vector(spark, d)).select(F.col("id").alias("vid"), F.round("cosine", 6).alias("sim"))
    m = live(spark, d).join(v, F.col("id") == F.col("vid"), "left").join(f, F.col("id") == F.col("fid"), "left")
    hours = seconds_between(F.lit(NOW), F.col("event_time")) / 3600.0
    known = F.col("sim").isNotNull()
    score = F.when(known, 0.55 * S.sigmoid(10 * (F.col("sim") - 0.5))).otherwise(0.0) + F.when(F.col("fid").isNotNull(), 0.20).otherwise(0.0) + 0.05 * F.exp(-hours / 8760)
    c = F.round(score / F.when(known, 1.0).otherwise(0.45), 6)
    return m.select("id", c.alias("confidence"), S.label(c, S.QUERY_LABELS, "very low").alias("label"))


def session_probe(spark: SparkSession, d: str, threshold: float = 0.6) -> DataFrame:
    """Whether the topic goes on: Jaccard of a cheap three-item probe with the working memory (the last seven accessed)."""
    probe = top(bm25(live(spark, d, "content"), "content", TERMS).withColumn("score", F.round("score", 6)), 3).agg(F.collect_set(F.lower("id")).alias("p"))
    wm = store.accesses(spark, d).groupBy("memory_id").agg(F.max("accessed_at").alias("t")).orderBy(F.desc("t"), "memory_id").limit(7).agg(F.collect_set("memory_id").alias("w"))
    j = S.jaccard(F.col("p"), F.col("w"))
    return probe.join(F.broadcast(wm)).select(F.round(j, 6).alias("overlap"), (j >= threshold).alias("continuous"))


def bm25_languages(spark: SparkSession, d: str) -> DataFrame:
    """Scripts of the documents as a tokeniser sees them: with CJK or not, tokens in all."""
    t = table(spark, d, "documents").filter("text is not null")
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 0))
    return t.groupBy(F.col("text").rlike(r"[一-鿿]").alias("has_cjk")).agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_documents, vector_topk, hybrid_weighted, hybrid_adaptive, rrf_0based, rrf_1based, combine_live_weights, entity_channel, hebbian_channel, recall7, recall_top10, recall_mmr,
        classify_queries, query_confidence, session_probe, bm25_languages,
    )
}

_LIVE = "live as (select * from m where deleted_at is null and coalesce(superseded_by, '') = '')"


def _bm25_sql(name: str, source: str, content: str, terms: Sequence[str]) -> str:
    tf = ", ".join(f"len(list_filter(tok, lambda x: x = '{q}')) as tf{i}" for i, q in enumerate(terms))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(terms)))
    one = " + ".join(f"greatest(1e-6::double, ln((n - df{i} + 0.5::double) / (df{i} + 0.5::double))) * tf{i} * 2.2::double / (tf{i} + 1.2::double * (0.25::double + 0.75::double * dl / av))" for i in range(len(terms)))
    some = " or ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"{name}_t as (select *, regexp_extract_all(lower(coalesce({content}, '')), '[\\p{{L}}\\p{{N}}]+') as tok from {source}), {name}_x as (select * exclude (tok), len(tok) as dl, {tf} from {name}_t), {name}_s as (select count(*) as n, avg(dl) as av, {df} from {name}_x), {name} as (select {name}_x.*, {one} as score from {name}_x, {name}_s where {some})"


_COS = "list_sum(list_transform(list_zip(v, q), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(v, lambda z: z::double * z::double)) * list_sum(list_transform(q, lambda z: z::double * z::double)))"
_VEC = f"""us as (select memory_id as id, min(embedding) as v from memory_embeddings where model = 'nimbus-embed-64' and len(embedding) = 64 and memory_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1),
 qv as (select arg_min(v, id) as q from us), vs as (select id, {_COS} as cosine from us, qv)"""
_F = _LIVE + ", " + _bm25_sql("ft", "live", "content", TERMS)
FULL_TEXT_SQL = _F
_L = _F + ", " + _VEC + ", fl as (select id, row_number() over (order by round(score, 6) desc, id) as f_rank from ft qualify f_rank <= 30), vl as (select id, round(cosine, 6) as cos, row_number() over (order by round(cosine, 6) desc, id) as v_rank from vs qualify v_rank <= 30), j as (select coalesce(fl.id, vl.id) as id, f_rank, v_rank, cos, coalesce((cos + 1) / 2, 0.0::double) as vec, coalesce(1 - (f_rank - 1) / 30.0::double, 0.0::double) as txt from fl full join vl on fl.id = vl.id)"


def _q(ctes: str, body: str) -> str:
    return sql("") + ", " + ctes + " " + body


_ENT = """qe as (select lower(id) as eid from en where contains(lower(name), 'skor')), nr as (select source_id as x, target_id as y from er union all select target_id, source_id from er),
 hop as (select distinct y as eid from nr where x in (select eid from qe) and y not in (select eid from qe)), wt as (select eid, 1.0::double as w from qe union all select eid, 0.5::double from hop),
 ec0 as (select memory_id as id, sum(w) as s from (select distinct memory_id, entity_id from me) join wt on entity_id = eid group by 1), ec as (select id, round(s / max(s) over (), 6) as score from ec0)"""
_HEB = """lc as (select * from hl where source_id <> target_id and source_id in (select lower(id) from ft) and target_id in (select lower(id) from ft)), hc0 as (select id, sum(strength) as s from (select source_id as id, strength from lc union all select target_id, strength from lc) group by 1), hc as (select id, round(s / max(s) over (), 6) as score from hc0)"""
_HITS = " + ".join(f"contains(lower(coalesce(content, '')), '{k}')::int" for k in TERMS)
_W = channel_weights("keyword")
_AFF = "case memory_type " + " ".join(f"when '{r[0]}' then {y}::double" for r, y in zip(S.MEMORY_TYPES, AFFINITY["event"])) + " else 1.0::double end"
_HOURS = "((epoch_us(now) // 1000000 - epoch_us(event_time) // 1000000) / 3600.0::double)"


def _combine_sql(w: Sequence[float]) -> str:
    total = f"((case when text is null then 0.0::double else {w[0]}::double end) + {w[2]}::double + {w[3]}::double + {w[4]}::double)"
    value = f"(coalesce(text, 0.0::double) * {w[0]}::double + rec * {w[2]}::double + core_strength * {w[3]}::double + importance * {w[4]}::double)"
    return f"round(case when {total} > 0 then least(greatest({value} / {total}, 0.0::double), 1.0::double) else 0.0::double end, 6)"


_RX = lambda rx: "'" + rx.replace("'", "''") + "'"
_KIND = f"case when regexp_matches(t, {_RX(TEMPORAL)}) then 'temporal' when n <= 4 and regexp_matches(t, {_RX(CODE)}) then 'keyword' when (n >= 5 and regexp_matches(t, {_RX(QUESTION)})) or n >= 7 then 'semantic' else 'general' end"
_INTENT = "case " + " ".join(f"when regexp_matches(t, {_RX(rx)}) then '{k}'" for k, rx in INTENTS) + " else 'general' end"
_QC = "round(((case when sim is null then 0.0::double else 0.55::double / (1 + exp(-10 * (sim - 0.5::double))) end) + (case when ft.id is null then 0.0::double else 0.20::double end) + 0.05::double * exp(-" + _HOURS.replace("event_time", "live.event_time") + " / 8760)) / (case when sim is null then 0.45::double else 1.0::double end), 6)"
SQL = {
    "bm25_topk": _q(_F, "select id, round(score, 6) as score, row_number() over (order by score desc, id) as rank from ft order by score desc, id limit 25"),
    "bm25_documents": "with " + _bm25_sql("ft", "documents", "text", ["snapshot", "replica", "timeline", "audit"]) + " select doc_id as id, round(score, 6) as score, round(least(score / 20, 1.0::double), 6) as bm25_score from ft",
    "vector_topk": "with " + _VEC + " select id, round(cosine, 6) as score, round((cosine + 1) / 2, 6) as vector_score, row_number() over (order by round(cosine, 6) desc, id) as rank from vs order by rank limit 25",
    "hybrid_weighted": _q(_L, "select id, round(vec * 0.7::double + txt * 0.3::double, 6) as score from j order by vec * 0.7::double + txt * 0.3::double desc, id limit 10"),
    "hybrid_adaptive": _q(_L, ", w as (select case when jac >= 0.6 then 0.5::double when jac >= 0.3 then 0.6::double else 0.7::double end as wv from (select count(*) filter (f_rank is not null and v_rank is not null) / count(*) as jac from j)) select id, round(vec * wv + txt * (1 - wv), 6) as score, wv from j, w order by vec * wv + txt * (1 - wv) desc, id limit 10").replace(") , w as", "), w as"),
    "rrf_0based": _q(_L, "select id, round(coalesce(1 / (60.0::double + f_rank - 1), 0) + coalesce(1 / (60.0::double + v_rank - 1), 0), 8) as score from j"),
    "rrf_1based": _q(_L, "select id, round(least(1.0::double, (coalesce(1 / (60.0::double + f_rank), 0) + coalesce(1 / (60.0::double + v_rank), 0)) * 61), 8) as score from j"),
    "combine_live_weights": _q(_LIVE + ", " + _VEC + f", x as (select live.*, greatest(0.0::double, round(cosine, 6)) as text0, vs.id as vid, pow(0.5::double, {_HOURS} / 24 / 365) as rec from live left join vs on live.id = vs.id, now_), y as (select *, case when vid is null then null else text0 end as text from x)", "select id, " + ", ".join(f"{_combine_sql(w)} as {k}" for k, w in FUSION.items()) + " from y"),
    "entity_channel": _q(_ENT, "select id, score from ec"),
    "hebbian_channel": _q(_F + ", " + _HEB, "select id, score from hc"),
    "recall7": _q(
        _F + ", " + _VEC + ", " + _ENT + ", " + _HEB + ", " + A.BASE + f""",
        fs as (select id, round(score / max(score) over (), 6) as fts from ft),
        x as (select b.id, memory_type, coalesce(fts, 0) * {_W['fts']}::double + coalesce(round(greatest(0.0::double, cosine), 6), 0) * {_W['emb']}::double
          + coalesce(1 / (1 + exp(-((base_level + 1.5::double * ({_HITS}) / {len(TERMS)} + importance * 2.0::double - (case when coalesce(contradicted_by, '') <> '' then 3.0::double else 0.0::double end)) + 5.5::double) / 1.5::double)), 0) * {_W['actr']}::double
          + coalesce(ec.score, 0) * {_W['entity']}::double + (0.3::double + 0.4::double * pow(0.5::double, {_HOURS} / 72)) * {_W['temporal']}::double + coalesce(hc.score, 0) * {_W['hebbian']}::double as s
          from b left join fs on fs.id = b.id left join vs on lower(vs.id) = lower(b.id) left join ec on ec.id = lower(b.id) left join hc on hc.id = lower(b.id), now_ where deleted_at is null and coalesce(superseded_by, '') = '')""",
        f"select id, round(round(s * ({_AFF}), 6), 5) as score, memory_type from x order by round(s * ({_AFF}), 6) desc, id limit 30",
    ),
    "classify_queries": sql(f"select {_KIND} as kind, {_INTENT} as intent, count(*) as n from (select coalesce(summary, '') as t, len(list_filter(regexp_split_to_array(trim(coalesce(summary, '')), '\\s+'), lambda w: w <> '')) as n from m) group by 1, 2"),
    "query_confidence": _q(_F + ", " + _VEC + ", v2 as (select id, round(cosine, 6) as sim from vs)", f", z as (select live.id, {_QC} as confidence from live left join v2 on v2.id = live.id left join ft on ft.id = live.id, now_) select id, confidence, {S.label_sql('confidence', S.QUERY_LABELS, 'very low')} as label from z").replace(") , z as", "), z as"),
    "session_probe": _q(_F + ", p as (select list(lower(id)) as p from (select id from ft order by round(score, 6) desc, id limit 3)), w as (select list(memory_id) as w from (select memory_id, max(accessed_at) as t from acc group by 1 order by t desc, memory_id limit 7))", "select round(len(list_intersect(p, w)) / (len(p) + len(w) - len(list_intersect(p, w))), 6) as overlap, len(list_intersect(p, w)) / (len(p) + len(w) - len(list_intersect(p, w))) >= 0.6 as continuous from p, w"),
    "bm25_languages": "select regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') as has_cjk, count(*) as n_docs, sum(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')))::bigint as n_tokens from documents where text is not null group by 1",
}
