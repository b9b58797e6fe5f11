"""The writing side of the knowledge graph and of what is derived from memories, on the append-only tables of the store.

Entities, aliases, edges, mentions, vectors, triples, topics, clusters,
promotions, runs and failures. Bulk calls take DataFrames; a call that names one
key takes that key. What a call changes it appends as new versions, so every
call may be repeated; a delta is applied once, by its digest.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.common import checkpoint
from palimpsest.plans.memory_store import KEYS, SCHEMAS, MemoryStore

SCHEMAS |= {
    "entities": "id string, name string, kind string, namespace string, first_seen timestamp_ntz, last_seen timestamp_ntz, merged_into string",
    "aliases": "alias string, namespace string, entity_id string",
    "edges": "id string, subject string, predicate string, object string, confidence double, memory_id string, episode string, recorded_at timestamp_ntz, invalidated_at timestamp_ntz, superseded_by string",
    "mentions": "memory_id string, entity_id string, role string",
    "embeddings": "memory_id string, model string, embedding array<float>",
    "triples": "memory_id string, subject string, predicate string, object string",
    "attempts": "memory_id string, n int",
    "topics": "id string, title string, namespace string, sources array<string>, superseded_by string, at timestamp_ntz",
    "clusters": "memory_id string, cluster string, state string",
    "promotions": "id string, members array<string>, status string",
    "runs": "id string, memory_id string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, high_water timestamp_ntz",
    "failures": "id string, episode string, reason string, resolved boolean",
    "deltas": "digest string, memory_id string, version int",
    "backfill": "memory_id string, attempts int, done boolean",
}
KEYS |= {
    "entities": ["id"], "aliases": ["alias", "namespace"], "edges": ["id"], "mentions": ["memory_id", "entity_id"], "embeddings": ["memory_id", "model"], "triples": ["memory_id", "subject", "predicate", "object"], "attempts": ["memory_id"],
    "topics": ["id"], "clusters": ["memory_id"], "promotions": ["id"], "runs": ["id"], "failures": ["id"], "deltas": ["digest", "memory_id", "version"], "backfill": ["memory_id"],
}


class GraphStore(MemoryStore):
    """A memory store with its graph. See ``MemoryStore``."""

    def _time(self) -> Column:
        return F.lit(self.now).cast("timestamp_ntz")

    def _update(self, name: str, where: Column, **values: Column) -> int:
        """New versions of the rows that match; returns how many."""
        x = self.table(name).filter(where)
        for c, v in values.items():
            x = x.withColumn(c, v.cast(x.schema[c].dataType))
        x = checkpoint(x)
        n = x.count()
        if n:
            self.append(name, x)
        return n

    def _drop(self, name: str, where: Column) -> int:
        x = checkpoint(self.table(name).filter(where))
        n = x.count()
        if n:
            self.append(name, x, removed=True)
        return n

    # entities and edges

    def upsert_entities(self, rows: DataFrame) -> None:
        """rows: id, name, kind, namespace. The first time an entity is seen stays, the last becomes now."""
        old = self.table("entities").select("id", F.col("first_seen").alias("was"))
        x = rows.select("id", "name", "kind", "namespace").dropDuplicates(["id"]).join(old, "id", "left")
        x = x.select("id", "name", "kind", "namespace", F.coalesce("was", self._time()).alias("first_seen"), self._time().alias("last_seen"), F.lit(None).cast("string").alias("merged_into"))
        self.append("entities", checkpoint(x))

    def touch_entity(self, key: str) -> int:
        return self._update("entities", F.col("id") == key, last_seen=self._time())

    def delete_entity(self, key: str) -> int:
        """An entity with its aliases and mentions; its edges are invalidated."""
        self._drop("aliases", F.col("entity_id") == key)
        self._drop("mentions", F.col("entity_id") == key)
        self._update("edges", ((F.col("subject") == key) | (F.col("object") == key)) & F.col("invalidated_at").isNull(), invalidated_at=self._time())
        return self._drop("entities", F.col("id") == key)

    def upsert_aliases(self, rows: DataFrame) -> None:
        self.append("aliases", rows.select(F.lower(F.trim("alias")).alias("alias"), "namespace", "entity_id").dropDuplicates(["alias", "namespace"]))

    def merge_entities(self, redirects: DataFrame) -> int:
        """redirects (loser, winner): losers point to their winner; edges, aliases and mentions move with them. Returns how many losers."""
        r = checkpoint(redirects.filter("loser <> winner").dropDuplicates(["loser"]))
        gone = self.table("entities").join(r, F.col("id") == F.col("loser")).withColumn("merged_into", F.col("winner")).drop("loser", "winner")
        gone = checkpoint(gone)
        self.append("entities", gone)
        to = lambda df, c: df.join(r.select(F.col("loser").alias(c), F.col("winner").alias("_w")), c, "left").withColumn(c, F.coalesce("_w", c)).drop("_w")
        e = self.table("edges")
        moved = e.join(r, (F.col("subject") == F.col("loser")) | (F.col("object") == F.col("loser")), "left_semi")
        self.append("edges", checkpoint(to(to(moved, "subject"), "object")))
        self.append("aliases", checkpoint(to(self.table("aliases").join(r, F.col("entity_id") == F.col("loser"), "left_semi"), "entity_id")))
        old = checkpoint(self.table("mentions").join(r, F.col("entity_id") == F.col("loser"), "left_semi"))
        self.append("mentions", old, removed=True)
        self.append("mentions", to(old, "entity_id").dropDuplicates(["memory_id", "entity_id"]))
        return gone.count()

    def insert_edges(self, rows: DataFrame) -> None:
        """rows: id, subject, predicate, object, confidence, memory_id, episode."""
        none = F.lit(None)
        self.append("edges", rows.select("id", "subject", "predicate", "object", "confidence", "memory_id", "episode", self._time().alias("recorded_at"), none.cast("timestamp_ntz").alias("invalidated_at"), none.cast("string").alias("superseded_by")))

    def invalidate_edge(self, key: str, at: datetime.datetime | None = None) -> int:
        """Once: an edge that is invalid keeps its time."""
        return self._update("edges", (F.col("id") == key) & F.col("invalidated_at").isNull(), invalidated_at=F.lit(at or self.now))

    def supersede_edge(self, key: str, rows: DataFrame) -> int:
        new = rows.select("id").first()["id"]
        self.insert_edges(rows)
        return self._update("edges", (F.col("id") == key) & F.col("invalidated_at").isNull(), invalidated_at=self._time(), superseded_by=F.lit(new))

    def link_memory_entities(self, rows: DataFrame) -> None:
        """rows: memory_id, entity_id, role; entities of one memory are related by ``co_occurs``."""
        self.append("mentions", rows.select("memory_id", "entity_id", "role").dropDuplicates(["memory_id", "entity_id"]))

    def edges_of_memory(self, key: str) -> DataFrame:
        return self.table("edges").filter(F.col("memory_id") == key)

    def in_episode(self, episode: str) -> tuple[DataFrame, DataFrame]:
        """Entities and edges of an episode."""
        e = self.table("edges").filter(F.col("episode") == episode)
        return e.select(F.explode(F.array("subject", "object")).alias("id")).distinct(), e

    def apply_delta(self, memory_id: str, edges: DataFrame, version: int = 1) -> bool:
        """Write a memory's edges once: a delta with the digest of one that was applied is skipped. Returns whether it was written."""
        row = F.concat_ws("|", "id", "subject", "predicate", "object")
        digest = edges.agg(F.bit_xor(F.xxhash64(row)).alias("x"), F.count("*").alias("n")).select(F.concat_ws("-", F.hex("x"), "n").alias("d")).first()["d"]
        if not self.table("deltas").filter((F.col("digest") == digest) & (F.col("memory_id") == memory_id) & (F.col("version") == version)).isEmpty():
            return False
        self.insert_edges(edges)
        self.append("deltas", self._rows("deltas", [(digest, memory_id, version)]))
        return True

    # vectors, triples, backfill

    def store_embeddings(self, rows: DataFrame) -> None:
        self.append("embeddings", rows.select("memory_id", "model", "embedding"))

    def delete_embedding(self, key: str) -> int:
        return self._drop("embeddings", F.col("memory_id") == key)

    def store_triples(self, rows: DataFrame) -> None:
        self.append("triples", rows.select("memory_id", "subject", "predicate", "object").distinct())

    def triples(self, key: str) -> DataFrame:
        return self.table("triples").filter(F.col("memory_id") == key)

    def unenriched(self, most: int = 3) -> DataFrame:
        """Live memories without triples that were tried fewer than ``most`` times."""
        tried = self.table("attempts").filter(F.col("n") >= most)
        return self.live().select("id").join(self.table("triples").select(F.col("memory_id").alias("id")), "id", "left_anti").join(tried.select(F.col("memory_id").alias("id")), "id", "left_anti")

    def tried(self, keys: DataFrame) -> None:
        """keys (id): one more attempt each."""
        old = self.table("attempts")
        x = keys.select(F.col("id").alias("memory_id")).distinct().join(old, "memory_id", "left").select("memory_id", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
        self.append("attempts", checkpoint(x))

    def enqueue_backfill(self, keys: DataFrame) -> int:
        """keys (id): queued unless they are; returns how many are new."""
        new = checkpoint(keys.select(F.col("id").alias("memory_id")).distinct().join(self.table("backfill"), "memory_id", "left_anti").select("memory_id", F.lit(0).alias("attempts"), F.lit(False).alias("done")))
        self.append("backfill", new)
        return new.count()

    def backfill_batch(self, size: int = 100) -> DataFrame:
        return self.table("backfill").filter("not done").orderBy("attempts", "memory_id").limit(size)

    def finish_backfill(self, keys: DataFrame, done: bool = True) -> None:
        x = self.table("backfill").join(keys.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").withColumn("attempts", F.col("attempts") + 1).withColumn("done", F.lit(done))
        self.append("backfill", checkpoint(x))

    # topics, clusters, promotions

    def upsert_topics(self, rows: DataFrame) -> None:
        """rows: id, title, namespace, sources."""
        self.append("topics", rows.select("id", "title", "namespace", F.array_sort("sources").alias("sources"), F.lit(None).cast("string").alias("superseded_by"), self._time().alias("at")))

    def supersede_topic(self, key: str, by: str) -> int:
        return self._update("topics", (F.col("id") == key) & F.col("superseded_by").isNull(), superseded_by=F.lit(by))

    def topics(self, namespace: str, superseded: bool = False, limit: int = 100) -> DataFrame:
        t = self.table("topics").filter(F.col("namespace") == namespace)
        return (t if superseded else t.filter("superseded_by is null")).orderBy(F.desc("at"), "id").limit(limit)

    def replace_clusters(self, rows: DataFrame) -> None:
        """rows (memory_id, cluster): the whole state anew; nothing is pending or dirty after it."""
        self.append("clusters", checkpoint(self.table("clusters")), removed=True)
        self.append("clusters", rows.select("memory_id", "cluster", F.lit("clean").alias("state")))

    def assign(self, rows: DataFrame) -> None:
        """rows (memory_id, cluster): new members; their clusters become dirty. A null cluster leaves a memory pending."""
        new = checkpoint(rows.select("memory_id", "cluster", F.when(F.col("cluster").isNull(), "pending").otherwise("dirty").alias("state")))
        touched = new.filter("cluster is not null").select("cluster").distinct()
        self.append("clusters", new)
        self.append("clusters", checkpoint(self.table("clusters").join(touched, "cluster", "left_semi").select("memory_id", "cluster", F.lit("dirty").alias("state"))))

    def dirty_clusters(self) -> DataFrame:
        return self.table("clusters").filter("state = 'dirty'").select("cluster").distinct()

    def pending(self) -> DataFrame:
        return self.table("clusters").filter("state = 'pending'").select("memory_id")

    def cluster_members(self, cluster: str) -> DataFrame:
        return self.table("clusters").filter(F.col("cluster") == cluster).select("memory_id")

    def stale_clusters(self) -> int:
        """Clusters of which no live memory is left."""
        return self.table("clusters").filter("cluster is not null").join(self.live().select(F.col("id").alias("memory_id")), "memory_id", "left").groupBy("cluster").count().join(
            self.table("clusters").join(self.live().select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("cluster").distinct(), "cluster", "left_anti").count()

    def covered(self, keys: DataFrame) -> float:
        """The share of the memories keys (id) that an insight already stands on."""
        p = self.table("provenance").select(F.col("source_id").alias("id")).distinct().withColumn("in", F.lit(1))
        return keys.select("id").distinct().join(p, "id", "left").agg(F.avg(F.coalesce("in", F.lit(0)))).first()[0] or 0.0

    def insights_of(self, key: str) -> DataFrame:
        return self.table("provenance").filter(F.col("source_id") == key).select("insight_id")

    def promote(self, key: str, members: list[str]) -> bool:
        """Propose a cluster; one with the same members is not proposed twice."""
        same = F.array_sort("members") == F.array(*[F.lit(m) for m in sorted(members)])
        if not self.table("promotions").filter(same).isEmpty():
            return False
        self.append("promotions", self._rows("promotions", [(key, sorted(members), "pending")]))
        return True

    def pending_promotions(self) -> DataFrame:
        return self.table("promotions").filter("status = 'pending'")

    def resolve_promotion(self, key: str, status: str) -> int:
        return self._update("promotions", (F.col("id") == key) & (F.col("status") == "pending"), status=F.lit(status))

    # runs and failures

    def begin_run(self, key: str, memory_id: str | None = None) -> None:
        self.append("runs", self._rows("runs", [(key, memory_id, "running", self.now, None, None)]))

    def finish_run(self, key: str, ok: bool, high_water: datetime.datetime | None = None) -> int:
        return self._update("runs", F.col("id") == key, status=F.lit("succeeded" if ok else "failed"), finished_at=F.lit(self.now), high_water=F.lit(high_water))

    def run_state(self, memory_id: str) -> str:
        """Of a memory's latest run; ``none`` without one."""
        r = self.table("runs").filter(F.col("memory_id") == memory_id).orderBy(F.desc("started_at"), F.desc("id")).first()
        return r["status"] if r else "none"

    def record_failure(self, key: str, episode: str, reason: str) -> None:
        self.append("failures", self._rows("failures", [(key, episode, reason, False)]))

    def resolve_failure(self, key: str) -> int:
        return self._update("failures", F.col("id") == key, resolved=F.lit(True))

    def failed_episodes(self, unresolved: bool = True) -> DataFrame:
        f = self.table("failures")
        return (f.filter("not resolved") if unresolved else f).select("episode").distinct()
