"""Streams: emotional state of each domain, working memory of each session, notifications, co-recall.

State is kept per key by ``applyInPandasWithState``, so it lives in the state
store, is checkpointed with the query and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALPHA = 0.3


def domain_state(signals: DataFrame) -> DataFrame:
    """Exponentially weighted valence, arousal and count of each domain; signals (domain, valence, arousal, ts) in event order a batch.

    Null valences leave the state as it is; valences are clamped to ±1.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        valence, arousal, n = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        for v, a in zip(rows["valence"], rows["arousal"]):
            if v is None or v != v:
                continue
            v, a = max(-1.0, min(1.0, float(v))), 0.0 if a is None or a != a else float(a)
            valence, arousal, n = (1 - ALPHA) * valence + ALPHA * v, (1 - ALPHA) * arousal + ALPHA * a, n + 1
        state.update((valence, arousal, n))
        yield pd.DataFrame({"domain": [key[0]], "valence": [valence], "arousal": [arousal], "n": [n]})

    return signals.groupBy("domain").applyInPandasWithState(fold, "domain string, valence double, arousal double, n long", "valence double, arousal double, n long", "update", GroupStateTimeout.NoTimeout)


def working_memory(recalls: DataFrame, capacity: int = 7, ttl_seconds: int = 300) -> DataFrame:
    """The memories that a session has in mind: the last ``capacity`` recalled within the time to live. recalls: session, memory_id, ts."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times = (list(x) for x in state.get) if state.exists else ([], [])
        held = dict(zip(ids, times))
        now = max(times, default=0.0)
        for r in pd.concat(list(batches)).sort_values("ts").itertuples():
            t = r.ts.timestamp()
            now = max(now, t)
            held.pop(r.memory_id, None)
            held[r.memory_id] = t
        live = sorted(((t, i) for i, t in held.items() if now - t <= ttl_seconds), reverse=True)[:capacity]
        state.update(([i for _, i in live], [t for t, _ in live]))
        yield pd.DataFrame({"session": [key[0]], "memory_ids": [[i for _, i in live]]})

    return recalls.groupBy("session").applyInPandasWithState(keep, "session string, memory_ids array<string>", "ids array<string>, times array<double>", "update", GroupStateTimeout.NoTimeout)


def notify(memories: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """New memories for the standing queries: a stream joined with a small static table; the stream's own offsets are the cursor."""
    m, s = memories.alias("m"), F.broadcast(subscriptions).alias("s")
    hit = m.join(s, (F.col("s.namespace") == "*") | (F.col("s.namespace") == F.coalesce("m.namespace", F.lit("default"))))
    return hit.filter(F.col("m.importance") >= F.col("s.min_importance")).select("s.agent_id", "m.id", "m.importance")


def co_recall(accesses: DataFrame, seconds: int = 30, late: str = "1 minute") -> DataFrame:
    """Pairs of accesses of different memories within the interval: a stream-stream join bounded by watermarks on both sides.

    An access meets those of its own and the two neighbouring time buckets, so the join is one of equal keys.
    """
    bucket = F.floor(F.unix_seconds("ts") / seconds)
    a = accesses.withWatermark("ts", late).select(F.col("memory_id").alias("a"), F.col("ts").alias("ta"), bucket.alias("bucket"))
    b = accesses.withWatermark("ts", late).select(F.col("memory_id").alias("b"), F.col("ts").alias("tb"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("near"))
    return a.join(b, F.expr(f"bucket = near and a < b and tb between ta - interval {seconds} seconds and ta + interval {seconds} seconds")).select("a", "b", "ta", "tb")


def hourly_activity(accesses: DataFrame, late: str = "1 hour") -> DataFrame:
    """Accesses of each memory by hour, with late rows up to the watermark."""
    return accesses.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "memory_id").agg(F.count("*").alias("n"))
