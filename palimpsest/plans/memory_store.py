"""A store of memories with the calls of an agent's memory: add, correct, forget, recall, link, subscribe, consolidate.

Tables are append-only Parquet folders. A change appends the new version of a
row; a reader takes the newest version of each key (merge on read), so writing
never rewrites what is there, and ``compact`` folds the versions when they pile
up. Every call takes its time from ``now``; the clock only orders the writes.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import secrets
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.operators import lifecycle, retrieval

SCHEMAS = {
    "memories": "id string, content string, memory_type string, layer string, created timestamp_ntz, event_time timestamp_ntz, working_strength double, core_strength double, importance double, pinned boolean, consolidation_count int, source string, contradicted_by string, superseded_by string, deleted_at timestamp_ntz, namespace string, metadata string",
    "accesses": "memory_id string, accessed_at timestamp_ntz",
    "links": "a string, b string, namespace string, strength double, coactivation_count int, created timestamp_ntz",
    "quarantine": "id string, content string, reason string, attempts int, at timestamp_ntz",
    "acl": "agent string, namespace string, permission string",
    "subscriptions": "agent string, namespace string, min_importance double",
    "cursors": "agent string, seen timestamp_ntz",
    "provenance": "insight_id string, source_id string, importance double",
    "emotions": "domain string, valence double, ts timestamp_ntz",
}
KEYS = {"memories": ["id"], "links": ["a", "b", "namespace"], "quarantine": ["id"], "acl": ["agent", "namespace"], "subscriptions": ["agent", "namespace"], "cursors": ["agent"]}
#: Tables that hold something of a memory, and by which columns.
OWNED = {"memories": ["id"], "accesses": ["memory_id"], "links": ["a", "b"], "provenance": ["insight_id", "source_id"], "mentions": ["memory_id"], "embeddings": ["memory_id"], "triples": ["memory_id"]}
MAX_CHARS = 1_000_000
LINK_THRESHOLD = 3


class MemoryStore:
    """``path`` is a folder that all executors share; ``extract`` turns a text into facts, ``importance`` a text into a boost."""

    def __init__(self, spark: SparkSession, path: str, now: datetime.datetime, extract: Callable[[str], Sequence[str]] | None = None, boost: Callable[[str], float] | None = None):
        self.spark, self.path, self.now, self.extract, self.boost = spark, path, now, extract, boost

    # tables

    def versions(self, name: str) -> DataFrame:
        schema = SCHEMAS[name] + ", seq bigint, removed boolean"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._has(name) else self.spark.createDataFrame([], schema)

    def _fs(self) -> tuple:
        P = self.spark._jvm.org.apache.hadoop.fs.Path
        return P, P(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        P, fs = self._fs()
        if not fs.exists(P(f"{self.path}/{name}")):
            # a fold that stopped between its two renames: the old versions are still whole
            if fs.exists(P(f"{self.path}/{name}.old")):
                fs.rename(P(f"{self.path}/{name}.old"), P(f"{self.path}/{name}"))
        return fs.exists(P(f"{self.path}/{name}"))

    def table(self, name: str) -> DataFrame:
        """The newest version of each row."""
        v = self.versions(name)
        if name not in KEYS:
            return v.drop("seq", "removed")
        rest = [c for c in v.columns if c not in KEYS[name]]
        one = v.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*KEYS[name], "r.*")
        return one.filter("not removed").drop("seq", "removed")

    def _seq(self, name: str) -> int:
        """A number for this write: the time with random low bits, greater than those this store gave before. No table is read."""
        self._last = max(getattr(self, "_last", 0) + 1, (time.time_ns() // 1000 << 10) + secrets.randbelow(1 << 10))
        return self._last

    def append(self, name: str, rows: DataFrame, removed: bool = False) -> None:
        cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        df = rows.select(*cols).withColumn("seq", F.lit(self._seq(name)).cast("bigint")).withColumn("removed", F.lit(removed))
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[name])

    def compact(self, name: str) -> None:
        """Fold the versions into one. A stop between the renames leaves the old folder, which the next reader takes back."""
        self.table(name).withColumn("seq", F.lit(1).cast("bigint")).withColumn("removed", F.lit(False)).write.mode("overwrite").parquet(f"{self.path}/{name}.new")
        P, fs = self._fs()
        fs.delete(P(f"{self.path}/{name}.old"), True)
        fs.rename(P(f"{self.path}/{name}"), P(f"{self.path}/{name}.old"))
        fs.rename(P(f"{self.path}/{name}.new"), P(f"{self.path}/{name}"))
        fs.delete(P(f"{self.path}/{name}.old"), True)

    # writing

    def _new(self, content: str, memory_type: str, importance: float | None, source: str | None, metadata: dict | None, namespace: str | None, event_time: datetime.datetime | None) -> tuple:
        default = {t[0]: t[1] for t in S.MEMORY_TYPES}.get(memory_type, 0.3)
        value = min(1.0, max(0.0, importance if importance is not None else default) * (self.boost(content) if self.boost else 1.0))
        key = hashlib.sha256(f"{namespace}|{content}|{self.now.isoformat()}".encode()).hexdigest()[:16]
        return (key, content, memory_type, "working", self.now, event_time or self.now, 1.0, 0.0, value, False, 0, source, None, None, None, namespace or "default", json.dumps(metadata) if metadata else None)

    def add(self, content: str, memory_type: str = "factual", importance: float | None = None, source: str | None = None, metadata: dict | None = None, namespace: str | None = None, event_time: datetime.datetime | None = None) -> list[str]:
        """Ids of what was added: the text, or each fact that ``extract`` finds in it."""
        facts = list(self.extract(content)) if self.extract else [content]
        rows = [self._new(f, memory_type, importance, source, metadata, namespace, event_time) for f in facts or [content]]
        self.append("memories", self._rows("memories", rows))
        return [r[0] for r in rows]

    def add_all(self, rows: DataFrame) -> None:
        """Bulk add: rows (content, memory_type, namespace, event_time); ids are digests, blank contents are skipped."""
        t = F.coalesce("memory_type", F.lit("factual"))
        n = F.coalesce("namespace", F.lit("default"))
        ready = rows.filter("trim(content) <> ''").select(
            F.substring(F.sha2(F.concat_ws("|", n, "content", F.lit(self.now.isoformat())), 256), 1, 16).alias("id"), "content", t.alias("memory_type"), F.lit("working").alias("layer"), F.lit(self.now).cast("timestamp_ntz").alias("created"),
            F.coalesce("event_time", F.lit(self.now).cast("timestamp_ntz")).alias("event_time"), F.lit(1.0).alias("working_strength"), F.lit(0.0).alias("core_strength"), S.by_type(t, 1, 0.3).alias("importance"), F.lit(False).alias("pinned"),
            F.lit(0).alias("consolidation_count"), *[F.lit(None).cast("string").alias(c) for c in ("source", "contradicted_by", "superseded_by")], F.lit(None).cast("timestamp_ntz").alias("deleted_at"), n.alias("namespace"), F.lit(None).cast("string").alias("metadata"),
        )
        self.append("memories", ready.dropDuplicates(["id"]))

    def store_raw(self, content: str | None, **kw) -> str:
        """stored, skipped (blank, or the same live text is there) or quarantined (too long)."""
        if content is None or not content.strip():
            return "skipped"
        if len(content) > MAX_CHARS:
            key = hashlib.sha256(content.encode()).hexdigest()[:16]
            self.append("quarantine", self._rows("quarantine", [(key, content, "too_long", 0, self.now)]))
            return "quarantined"
        same = self.live(kw.get("namespace") or "default").filter(F.col("content") == content)
        if not same.isEmpty():
            return "skipped"
        self.add(content, **kw)
        return "stored"

    def count_quarantine(self) -> int:
        return self.table("quarantine").count()

    def purge_quarantine(self, most: int = 3, days: int = 30) -> int:
        """Texts refused ``most`` times go after so many days."""
        old = lifecycle.checkpoint(self.table("quarantine").filter((F.col("attempts") >= most) & (F.col("at") < F.lit(self.now - datetime.timedelta(days=days)))))
        n = old.count()
        if n:
            self.append("quarantine", old, removed=True)
        return n

    def namespaces(self) -> list[str]:
        return sorted(r[0] for r in self.table("memories").select("namespace").distinct().collect())

    def reconcile(self, pairs: DataFrame, dry_run: bool = True) -> dict[str, int]:
        """Near-copies (a, b): the weaker of each pair is superseded by the stronger; nothing is changed on a dry run.

        A memory gives way once, to the best of those it is paired with, and one that gives way takes no other in.
        """
        m = self.live().select("id", "importance")
        p = pairs.select("a", "b").join(m.select(F.col("id").alias("a"), F.col("importance").alias("ia")), "a").join(m.select(F.col("id").alias("b"), F.col("importance").alias("ib")), "b")
        weaker = (F.col("ia") < F.col("ib")) | ((F.col("ia") == F.col("ib")) & (F.col("a") > F.col("b")))
        p = p.select(F.when(weaker, F.col("a")).otherwise(F.col("b")).alias("lost"), F.when(weaker, F.col("b")).otherwise(F.col("a")).alias("won"), F.greatest("ia", "ib").alias("i"))
        best = p.groupBy("lost").agg(F.max_by("won", F.struct("i", "won")).alias("won"))
        best = lifecycle.checkpoint(best.join(best.select(F.col("lost").alias("won")), "won", "left_anti"))
        n = best.count()
        if n and not dry_run:
            new = self.table("memories").join(best.withColumnRenamed("lost", "id"), "id").withColumn("superseded_by", F.col("won")).drop("won")
            self.append("memories", lifecycle.checkpoint(new))
        return {"found": pairs.count(), "merged": 0 if dry_run else n, "would_merge": n}

    def retry_quarantined(self, accept: Callable[[str], bool], most: int = 3) -> dict[str, int]:
        rows = self.table("quarantine").filter(F.col("attempts") < most).limit(1000).collect()  # a bounded batch
        done = [r for r in rows if accept(r["content"])]
        for r in done:
            self.add(r["content"])
        left = [r for r in rows if r not in done]
        if done:
            self.append("quarantine", self._rows("quarantine", [tuple(r) for r in done]), removed=True)
        if left:
            self.append("quarantine", self._rows("quarantine", [(r["id"], r["content"], r["reason"], r["attempts"] + 1, self.now) for r in left]))
        return {"stored": len(done), "left": len(left)}

    def change(self, where: Column, **values) -> int:
        """Append a new version of the rows that match; returns how many."""
        m = self.table("memories").filter(where)
        for c, v in values.items():
            m = m.withColumn(c, v if isinstance(v, Column) else F.lit(v).cast(self.table("memories").schema[c].dataType))
        m = lifecycle.checkpoint(m)
        n = m.count()
        if n:
            self.append("memories", m)
        return n

    def pin(self, key: str, on: bool = True) -> int:
        return self.change(F.col("id") == key, pinned=on)

    def correct(self, old: str, content: str, importance: float | None = None) -> str:
        """A new memory takes the place of an old one, which points to it."""
        r = self.table("memories").filter(F.col("id") == old).first()
        if r is None:
            raise KeyError(old)
        new = self.add(content, r["memory_type"], importance if importance is not None else r["importance"], r["source"], None, r["namespace"])[0]
        self.change(F.col("id") == old, superseded_by=new)
        return new

    def correct_matching(self, query: str, content: str, namespace: str = "default", limit: int = 10) -> tuple[str, int]:
        """One new memory supersedes the best matches of a query."""
        hits = [r["id"] for r in self.recall_text(query, namespace, limit).select("id").collect()]
        new = self.add(content, namespace=namespace)[0]
        return new, self.change(F.col("id").isin(hits), superseded_by=new) if hits else 0

    def unsupersede(self, key: str) -> int:
        return self.change(F.col("id") == key, superseded_by=F.lit(None).cast("string"))

    def forget(self, key: str, soft: bool = True) -> int:
        """Mark a memory as deleted; or, not ``soft``, remove it with its accesses, links, mentions, vectors and provenance, old versions included."""
        if soft:
            return self.change((F.col("id") == key) & F.col("deleted_at").isNull(), deleted_at=F.lit(self.now).cast("timestamp_ntz"))
        n = self.table("memories").filter(F.col("id") == key).count()
        for name, columns in OWNED.items():
            if name in SCHEMAS and self._has(name):
                mine = F.lit(False)
                for c in columns:
                    mine = mine | F.coalesce(F.col(c) == key, F.lit(False))
                self._erase(name, mine)
        return n

    def _erase(self, name: str, gone: Column) -> None:
        """Rewrite a table's versions without some rows, so that no older version keeps what they held."""
        kept = self.versions(name).filter(~gone)
        if kept.count() < self.versions(name).count():
            kept.write.mode("overwrite").parquet(f"{self.path}/{name}.new")
            P, fs = self._fs()
            fs.delete(P(f"{self.path}/{name}.old"), True)
            fs.rename(P(f"{self.path}/{name}"), P(f"{self.path}/{name}.old"))
            fs.rename(P(f"{self.path}/{name}.new"), P(f"{self.path}/{name}"))
            fs.delete(P(f"{self.path}/{name}.old"), True)

    def access(self, keys: Sequence[str]) -> None:
        """Record accesses and the co-activation of every pair; a link forms at the third and then grows to at most 1."""
        self.append("accesses", self._rows("accesses", [(k, self.now) for k in keys]))
        keys = sorted(set(keys))
        pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
        if not pairs:
            return
        ns = self.table("memories").select(F.col("id").alias("a"), "namespace")
        new = self.spark.createDataFrame(pairs, "a string, b string").join(ns, "a")
        old = self.table("links").select("a", "b", "namespace", "strength", "coactivation_count", "created")
        x = new.join(old, ["a", "b", "namespace"], "left")
        n = F.coalesce("coactivation_count", F.lit(0)) + 1
        grown = F.when(n < LINK_THRESHOLD, 0.0).when(n == LINK_THRESHOLD, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("strength", F.lit(0.0)) + 0.1))
        x = x.select("a", "b", "namespace", grown.alias("strength"), n.cast("int").alias("coactivation_count"), F.coalesce("created", F.lit(self.now).cast("timestamp_ntz")).alias("created"))
        self.append("links", lifecycle.checkpoint(x))

    def reward(self, feedback: str, recent: int = 3, magnitude: float = 0.15) -> int:
        """Praise or blame moves the working strength of the memories accessed last."""
        words = feedback.lower()
        sign = sum(w in words for w in S.POSITIVE_WORDS) - sum(w in words for w in S.NEGATIVE_WORDS)
        if not sign:
            return 0
        last = self.table("accesses").groupBy("memory_id").agg(F.max("accessed_at").alias("t")).orderBy(F.desc("t"), "memory_id").limit(recent)
        keys = [r["memory_id"] for r in last.collect()]
        step = magnitude if sign > 0 else -magnitude
        return self.change(F.col("id").isin(keys), working_strength=F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("working_strength") + step)))

    def consolidate(self, days: float = 1.0, preset: str = "default") -> int:
        """One cycle over all live memories."""
        m = lifecycle.checkpoint(lifecycle.consolidate(self.table("memories").filter("deleted_at is null"), days, preset))
        self.append("memories", m)
        return m.count()

    def downscale(self, factor: float = 0.95) -> int:
        return self.change(~F.col("pinned"), working_strength=F.col("working_strength") * factor, core_strength=F.col("core_strength") * factor)

    def purge(self, days: int = 30) -> int:
        """Rows deleted more than ``days`` ago go for good."""
        old = self.table("memories").filter(F.col("deleted_at") < F.lit(self.now - datetime.timedelta(days=days)))
        n = old.count()
        self.append("memories", old, removed=True)
        return n

    def record_insight(self, content: str, sources: Sequence[str], namespace: str = "default") -> str:
        """A synthesised memory over its sources, which lose half of their importance; kept so that it can be undone."""
        rows = self.table("memories").filter(F.col("id").isin(list(sources))).select("id", "importance").collect()
        new = self.add(content, "factual", 0.8, "synthesis", {"is_synthesis": True}, namespace)[0]
        self.append("provenance", self._rows("provenance", [(new, r["id"], r["importance"]) for r in rows]))
        self.change(F.col("id").isin([r["id"] for r in rows]), importance=F.col("importance") * 0.5)
        return new

    def undo_insight(self, insight: str) -> int:
        p = self.table("provenance").filter(F.col("insight_id") == insight).select(F.col("source_id").alias("id"), F.col("importance").alias("was"))
        m = lifecycle.checkpoint(self.table("memories").join(p, "id").withColumn("importance", F.col("was")).drop("was"))
        n = m.count()
        self.append("memories", m)
        self.forget(insight)
        return n

    # reading

    def live(self, namespace: str = "*") -> DataFrame:
        m = self.table("memories").filter("deleted_at is null and superseded_by is null")
        return m if namespace == "*" else m.filter(F.col("namespace") == namespace)

    def recall_text(self, query: str, namespace: str = "*", limit: int = 10) -> DataFrame:
        """(id, content, score, rank) by full text; an empty query has no results."""
        hits = retrieval.bm25(self.live(namespace), "content", retrieval.query_terms(query))
        return retrieval.top(hits, limit).select("id", "content", "score", "rank")

    def recall(self, query: str, namespace: str = "*", limit: int = 10, least: float = 0.0) -> DataFrame:
        """Full text, activation and links together; pinned memories first among equals."""
        f = retrieval.bm25(self.live(namespace), "content", retrieval.query_terms(query))
        f = f.join(F.broadcast(f.agg(F.max("score").alias("best"))))
        age = F.greatest(F.lit(0.001), retrieval.seconds_between(F.lit(self.now), F.col("accessed_at")).cast("double"))
        acc = self.table("accesses").withColumn("t", F.pow(age, F.lit(-0.5))).groupBy(F.col("memory_id").alias("id")).agg(F.log(F.sum("t")).alias("base"))
        l = self.table("links").filter("strength > 0")
        ids = f.select("id")
        both = l.select(F.col("a").alias("id"), F.col("b").alias("o"), "strength").unionByName(l.select(F.col("b").alias("id"), F.col("a").alias("o"), "strength"))
        heb = both.join(ids.withColumnRenamed("id", "o"), "o", "left_semi").groupBy("id").agg(F.least(F.lit(1.0), F.sum("strength")).alias("heb"))
        x = f.join(acc, "id", "left").join(heb, "id", "left")
        score = 0.6 * F.col("score") / F.col("best") + 0.25 * S.normalize_activation(F.col("base")) + 0.10 * F.coalesce("heb", F.lit(0.0)) + 0.05 * F.col("pinned").cast("int")
        return retrieval.top(x.withColumn("score", score).filter(F.col("score") >= least), limit).select("id", "content", "score", "rank")

    def recent(self, namespace: str = "*", n: int = 10) -> DataFrame:
        return self.live(namespace).orderBy(F.desc("created"), "id").limit(n)

    def stats(self) -> DataFrame:
        return self.table("memories").groupBy("namespace", "memory_type", "layer").agg(F.count("*").alias("n"), F.avg("importance").alias("avg_importance"))

    def export(self, path: str, namespace: str = "*") -> None:
        self.live(namespace).write.mode("overwrite").json(path)

    # rights and standing queries

    def grant(self, agent: str, namespace: str, permission: str) -> None:
        if permission not in ("read", "write", "admin"):
            raise ValueError(permission)
        self.append("acl", self._rows("acl", [(agent, namespace, permission)]))

    def may(self, agent: str, namespace: str, permission: str) -> bool:
        """read is part of write, write of admin; a grant on ``*`` holds everywhere."""
        enough = {"read": ["read", "write", "admin"], "write": ["write", "admin"], "admin": ["admin"]}[permission]
        return not self.table("acl").filter((F.col("agent") == agent) & F.col("namespace").isin(namespace, "*") & F.col("permission").isin(enough)).isEmpty()

    def subscribe(self, agent: str, namespace: str = "*", min_importance: float = 0.5) -> None:
        self.append("subscriptions", self._rows("subscriptions", [(agent, namespace, min(1.0, max(0.0, min_importance)))]))

    def unsubscribe(self, agent: str, namespace: str = "*") -> None:
        self.append("subscriptions", self.table("subscriptions").filter((F.col("agent") == agent) & (F.col("namespace") == namespace)), removed=True)

    def notifications(self, agent: str, advance: bool = True) -> DataFrame:
        """What is new for an agent since it last looked, newest first; each memory once."""
        seen = self.table("cursors").filter(F.col("agent") == agent).first()
        s = self.table("subscriptions").filter(F.col("agent") == agent).select(F.col("namespace").alias("want"), "min_importance")
        m = self.live()
        if seen is not None:
            m = m.filter(F.col("created") > F.lit(seen["seen"]))
        hit = m.join(s, ((F.col("want") == "*") | (F.col("want") == F.col("namespace"))) & (F.col("importance") >= F.col("min_importance")))
        out = lifecycle.checkpoint(hit.select("id", "content", "importance", "created").distinct()).orderBy(F.desc("created"), "id")
        if advance:
            self.append("cursors", self._rows("cursors", [(agent, self.now)]))
        return out

    def feel(self, domain: str, valence: float) -> None:
        self.append("emotions", self._rows("emotions", [(domain, max(-1.0, min(1.0, valence)), self.now)]))

    def trends(self) -> DataFrame:
        t = self.table("emotions").groupBy("domain").agg(F.count("*").alias("n"), F.avg("valence").alias("valence"))
        return t.withColumn("needs_update", (F.col("n") >= 10) & (F.col("valence") < -0.5))
