"""Filling fixed-capacity containers with items of varying length.

Method: optimal length buckets. The global histogram of lengths (at most one row
a length, so no more than the capacity) goes to the driver, where dynamic
programming chooses the bucket boundaries that minimise the padding of every
item to its bucket's boundary. Token-budget batches form inside each bucket: a
container takes as many items as their padded lengths allow. What a batch of
long items leaves free is a smaller budget, in which batches of the next shorter
buckets form before a new container is opened (best fit, largest first); without
this an item over half a capacity would waste the rest of its container.

The plan is made on counts only: a few runs of equal containers for each bucket.
Items find their place by their rank within the bucket, which is taken in salted
parts so that a bucket with a third of all items is no single task.

Defined results: an item longer than the capacity is cut into full pieces and a
rest (``piece_no`` from 0), no other item is cut; empty and null texts take no
room and are assigned to container 0 with length 0; null capacities or such
below 1 are ignored; a repeated key is another item. ``offset`` is the place in
the container, items being padded to their boundary.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.common import checkpoint
from palimpsest.llm.tokenize import encode_column


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The at most ``buckets`` boundaries that minimise sum(count * (boundary - length))."""
    sizes = np.array(sorted(histogram), np.int64)
    if len(sizes) <= buckets:
        return sizes.tolist()
    counts = np.array([histogram[s] for s in sizes], np.int64)
    n = np.concatenate([[0], np.cumsum(counts)])
    # padding of a bucket (i, j] to sizes[j - 1] is (n[j] - n[i]) * size less the tokens, which are the same however cut
    best = np.concatenate([[0], n[1:] * sizes])
    came = np.zeros((buckets, len(sizes) + 1), np.int32)
    for k in range(1, buckets):
        new = np.full(len(sizes) + 1, np.iinfo(np.int64).max)
        lo = k
        for j in range(k + 1, len(sizes) + 1):
            cost = best[lo:j] + (n[j] - n[lo:j]) * sizes[j - 1]
            at = int(cost.argmin())
            new[j], came[k, j] = cost[at], lo + at
            lo += at  # the best cut never moves back
        new[: k + 1] = best[: k + 1]
        best = new
    cuts, j = [], len(sizes)
    for k in range(buckets - 1, 0, -1):
        cuts.append(int(sizes[j - 1]))
        if j <= k:
            break
        j = int(came[k, j])
        if j == 0:
            break
    else:
        cuts.append(int(sizes[j - 1]))
    return sorted(set(cuts))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (boundary, first rank, items, items in a container, first container, offset) for padded lengths and their counts."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # free room: groups of (first container, containers)
    order: list[int] = []
    opened = 0

    def free(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                order.insert(bisect_left(order, room), room)
                rooms[room] = []
            rooms[room].append((first, n))

    for b in sorted(counts, reverse=True):
        left, rank = counts[b], 0
        while left:
            at = bisect_left(order, b)
            if at < len(order):
                room = order[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // b))
                opened += n
            each = room // b
            full = min(n, left // each)
            if full:
                runs.append((b, rank, full * each, each, first, capacity - room))
                free(room - each * b, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # the last container of the batch
                runs.append((b, rank, left, left, first + full, capacity - room))
                free(room - left * b, first + full, 1)
                free(room, first + full + 1, n - full - 1)
                left = 0
            else:
                free(room, first + full, n - full)
    return runs


def pack(items: DataFrame, packs: list[tuple[int, int]], *, buckets: int = 128, per_task: int = 20_000) -> DataFrame:
    """(pack_id, key, piece_no, container_id, offset, length) of each item (key, n) for each (pack_id, capacity)."""
    spark = items.sparkSession
    shape = "pack_id int, key " + items.schema["key"].dataType.simpleString() + ", piece_no int, container_id bigint, offset int, length int"
    if not packs:
        return spark.createDataFrame([], shape)
    items = checkpoint(items)
    total = items.count()
    sizes = F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).alias("capacity")) for p, c in packs])
    each = items.select("key", F.coalesce("n", F.lit(0)).alias("n"), F.explode(sizes).alias("p")).select("key", "n", "p.*")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity"))).cast("int")
    cut = each.select("key", "n", "pack_id", "capacity", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    cut = cut.select("key", "pack_id", "piece_no", F.least("capacity", F.col("n") - F.col("piece_no") * F.col("capacity")).cast("int").alias("length"))
    # one row for each capacity and length: at most the sum of the capacities
    histogram: dict[int, dict[int, int]] = {}
    for r in cut.filter("length > 0").groupBy("pack_id", "length").agg(F.count("*").alias("n")).toLocalIterator():
        histogram.setdefault(r["pack_id"], {})[r["length"]] = r["n"]
    steps, runs = [], []
    for p, c in packs:
        h = histogram.get(p, {})
        bounds = boundaries(h, buckets) if h else []
        padded: dict[int, int] = {}
        for s, n in h.items():
            b = bounds[bisect_left(bounds, s)]
            padded[b] = padded.get(b, 0) + n
            steps.append((p, s, b))
        runs += [(p, *map(int, r)) for r in plan(padded, c)]
    step = spark.createDataFrame(steps, "pack_id int, length int, bucket int")
    run = spark.createDataFrame(runs, "pack_id int, bucket int, first_rank bigint, items bigint, each int, first_container bigint, base int")
    # both tables are bounded by the capacities and the number of buckets, not by the items
    put = cut.filter("length > 0").join(F.broadcast(step), ["pack_id", "length"])
    salts = max(8, -(-total // per_task))
    put = put.withColumn("salt", F.pmod(F.xxhash64("key", "piece_no"), F.lit(salts)).cast("int"))
    counts = put.groupBy("pack_id", "bucket", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("pack_id", "bucket").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("pack_id", "bucket", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(W.partitionBy("pack_id", "bucket", "salt").orderBy("key", "piece_no")) - 1
    ranked = put.withColumn("inner", inner).join(starts, ["pack_id", "bucket", "salt"]).withColumn("rank", F.col("start") + F.col("inner"))
    placed = ranked.join(F.broadcast(run), ["pack_id", "bucket"]).filter("rank >= first_rank and rank < first_rank + items")
    at = F.col("rank") - F.col("first_rank")
    out = placed.select(
        "pack_id", "key", "piece_no",
        (F.col("first_container") + F.floor(at / F.col("each"))).cast("bigint").alias("container_id"),
        (F.col("base") + (at % F.col("each")) * F.col("bucket")).cast("int").alias("offset"),
        "length",
    )
    empty = cut.filter("length <= 0").select("pack_id", "key", "piece_no", F.lit(0).cast("bigint").alias("container_id"), F.lit(0).alias("offset"), F.lit(0).alias("length"))
    return out.unionByName(empty)


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = encode_column(docs, "doc_id", "text", counts_only=True).select(F.col("doc_id").alias("key"), F.col("n_tokens").alias("n"))
    table = spark.read.parquet(f"{sf_dir}/pack_sizes.parquet").filter("pack_id is not null and capacity >= 1").groupBy("pack_id").agg(F.max("capacity").alias("capacity"))
    packs = sorted((r["pack_id"], r["capacity"]) for r in table.collect())  # a fixed table of three rows
    return pack(sizes, packs).withColumnRenamed("key", "doc_id"), packs


def p9_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of room used, for each capacity."""
    placed, packs = _packed(spark, sf_dir)
    size = F.create_map(*[F.lit(x) for p in packs for x in p])[F.col("pack_id")] if packs else F.lit(1)
    one = placed.groupBy("pack_id", "container_id").agg(F.sum("length").alias("used"))
    return one.groupBy("pack_id").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens")).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * size), 6))
