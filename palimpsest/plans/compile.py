"""Compiling knowledge: candidates, clusters, pages, and the topics that they replace; a run of the ledger each time."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.common import checkpoint
from palimpsest.operators.components import pairs_within
from palimpsest.operators.vector_join import cosine_join
from palimpsest.plans.graph_store import GraphStore
from palimpsest.plans.plugins import Clusterer, cluster
from palimpsest.operators.knowledge import label_propagation


def candidates(store: GraphStore, namespace: str, least: float = 0.3) -> DataFrame:
    """Live memories of a namespace since the newest one that a run compiled."""
    mark = store.table("runs").filter((F.col("status") == "succeeded") & F.col("high_water").isNotNull()).filter(F.col("id").startswith(f"compile-{namespace}-")).agg(F.max("high_water")).first()[0]
    m = store.live(namespace).filter(F.col("importance") >= least)
    return m if mark is None else m.filter(F.col("created") >= F.lit(mark))


def clusters(store: GraphStore, chosen: DataFrame, closest: float = 0.6, clusterer: Clusterer = label_propagation) -> DataFrame:
    """(id, label) of candidates whose stored vectors lie close."""
    v = store.table("embeddings").select(F.col("memory_id").alias("id"), F.col("embedding").alias("v")).dropDuplicates(["id"]).join(chosen.select("id"), "id", "left_semi")
    return cluster(cosine_join(v, closest).withColumnRenamed("cosine", "score"), clusterer=clusterer)


def pages(chosen: DataFrame, labels: DataFrame, smallest: int = 3) -> DataFrame:
    """(id, title, namespace, sources, content): a page for each cluster, without a language model; the id is a digest of its sources."""
    x = chosen.select("id", "content", "created", "namespace").join(labels, "id")
    g = x.groupBy("label").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("created", "id", "content"))).alias("parts"), F.min("namespace").alias("namespace"), F.min_by("content", F.struct(-F.length("content"), F.col("id"))).alias("longest")).filter(F.col("n") >= smallest)
    sources = F.array_sort(F.transform("parts", lambda p: p["id"]))
    return g.select(F.substring(F.sha2(F.array_join(sources, ","), 256), 1, 16).alias("id"), F.array_join(F.slice(F.split(F.trim("longest"), r"\s+"), 1, 5), " ").alias("title"), "namespace", sources.alias("sources"), F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("content"))


def replaced(store: GraphStore, new: DataFrame, namespace: str, least: float = 0.3) -> DataFrame:
    """(old, new, overlap): live topics whose sources a new page shares to more than ``least``."""
    old = store.topics(namespace, limit=1_000_000).select(F.col("id").alias("topic"), "sources")
    member = old.select("topic", F.explode("sources").alias("m"), F.size("sources").alias("n"), F.lit("old").alias("side")).unionByName(new.select(F.col("id").alias("topic"), F.explode("sources").alias("m"), F.size("sources").alias("n"), F.lit("new").alias("side")))
    keyed = member.select("m", F.concat_ws("|", "side", "topic", "n").alias("t"))
    p = pairs_within(keyed.distinct(), "m", "t").filter(F.col("a").startswith("new|") & F.col("b").startswith("old|")).groupBy("a", "b").agg(F.count("*").alias("both"))
    part = lambda c, i: F.split(c, r"\|")[i]
    overlap = F.col("both") / (part("a", 2).cast("int") + part("b", 2).cast("int") - F.col("both"))
    return p.select(part("b", 1).alias("old"), part("a", 1).alias("new"), overlap.alias("overlap")).filter((F.col("overlap") > least) & (F.col("old") != F.col("new")))


def compile_knowledge(store: GraphStore, namespace: str, *, dry_run: bool = False, closest: float = 0.6, smallest: int = 3, least: float = 0.3, rewrite: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """One run: what was chosen, compiled and replaced. A dry run writes nothing. ``rewrite`` may give pages other titles and texts."""
    chosen = checkpoint(candidates(store, namespace, least))
    new = pages(chosen, clusters(store, chosen, closest), smallest)
    new = checkpoint(rewrite(new) if rewrite else new)
    known = store.topics(namespace, superseded=True, limit=1_000_000).select("id")
    fresh = checkpoint(new.join(known, "id", "left_anti"))
    gone = checkpoint(replaced(store, fresh, namespace))
    report = {"candidates": chosen.count(), "pages": new.count(), "new": fresh.count(), "replaced": gone.select("old").distinct().count()}
    if dry_run:
        return report
    run = f"compile-{namespace}-{store.now.isoformat()}"
    store.begin_run(run)
    store.upsert_topics(fresh)
    to = gone.groupBy("old").agg(F.max_by("new", F.struct("overlap", "new")).alias("by"))
    t = store.table("topics").join(to, F.col("id") == F.col("old")).filter("superseded_by is null")
    store.append("topics", checkpoint(t.withColumn("superseded_by", F.col("by")).drop("old", "by")))
    mark = chosen.agg(F.max("created")).first()[0]
    store.finish_run(run, True, mark if isinstance(mark, datetime.datetime) else None)
    return report
