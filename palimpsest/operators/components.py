"""Connected components of an edge table, by alternating stars.

Each round points every node at the smallest neighbour (large star, then small
star), so long chains contract in about log(n) rounds. A hub's edges are reduced
by partial aggregation before they move; every round is checkpointed, so a lost
executor costs one round at most. Self-loops and null ends are ignored; an empty
edge table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.common import checkpoint, release, unbroadcast


def _mins(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the component is its smallest node."""
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = checkpoint(e)
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(unbroadcast(_mins(both)), F.col("u") == F.col("mu")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        m = down.join(unbroadcast(_mins(down)), F.col("u") == F.col("mu"))
        small = m.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, e = e, checkpoint(small)
        release(before)
        new = _state(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def pairs_within(rows: DataFrame, group: str, item: str, a: str = "a", b: str = "b", block: int = 256) -> DataFrame:
    """(group, a, b): all pairs of different items of a group, a < b. ``rows``: group and item, distinct.

    The items of a group are cut into blocks and each two blocks meet in a key
    of their own, so a large group is spread over tasks; small groups are one
    block. Groups of one item give nothing.
    """
    blocks = rows.groupBy(group).agg(F.count("*").alias("n")).filter("n > 1").select(group, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    x = rows.select(group, F.col(item).alias("x")).join(unbroadcast(blocks), group).withColumn("k", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    low = x.select(group, F.col("k").alias("i"), F.explode(F.sequence("k", F.col("blocks") - 1)).alias("j"), F.col("x").alias("y"))
    high = x.select(group, F.explode(F.sequence(F.lit(0), "k")).alias("i"), F.col("k").alias("j"), F.col("x").alias("z"))
    met = low.join(unbroadcast(high), [group, "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("y") < F.col("z")))
    return met.select(group, F.least("y", "z").alias(a), F.greatest("y", "z").alias(b))
