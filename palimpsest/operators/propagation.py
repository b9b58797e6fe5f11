"""Weighted label propagation over a graph that is packed once; its rounds move labels only.

Nodes get numbers in the order of their ids, in ranges. The edges from one range
to another are one row, those from a range lie in one file, and that file is read
whole by one task. A round joins each row with the labels of the range that it
leads to, so a task has all votes of its range: no edge and no vote is shuffled.
A task reads the labels of all ranges, eight bytes a node.

Rows without an id at either end are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.common import checkpoint, partitions_for, release, unbroadcast

#: Nodes and directed edges of a range on average.
NODES, EDGES = 200_000, 400_000
#: Bits of a number below its range (of ``monotonically_increasing_id``).
PLACE = 33
#: Each file is a partition of its own; rows are large.
WHOLE = {"spark__sql__files__maxPartitionBytes": str(1 << 40), "spark__sql__files__openCostInBytes": str(1 << 40), "spark__sql__execution__arrow__maxRecordsPerBatch": "8"}


class _Range:
    """The edges of one range, as they come with the labels of the ranges they lead to; those to the range itself come first."""

    def __init__(self, i: int, moves: np.ndarray, own: np.ndarray):
        self.i, self.moves, self.own = i, moves, own

    def add(self, a: np.ndarray, w: np.ndarray, label: np.ndarray) -> None:
        """Edges from the places ``a`` with the labels at their other end."""

    def result(self) -> pa.RecordBatch:
        """What is known of the range."""


def _sums(a: np.ndarray, label: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of w for each a and label, in this order."""
    at = np.lexsort((label, a))
    a, label, w = a[at], label[at], w[at]
    head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (label[1:] != label[:-1])]) if len(a) else np.array([], np.int64)
    return a[head], label[head], np.add.reduceat(w, head) if len(head) else w


class _Votes(_Range):
    round = 0

    def __init__(self, i: int, moves: np.ndarray, own: np.ndarray):
        super().__init__(i, (moves >> self.round & 1).astype(bool), own)
        place = np.flatnonzero(self.moves)
        self.held = [(place, own[place], np.full(len(place), 1e-9))]  # the own label wins a tie

    def add(self, a: np.ndarray, w: np.ndarray, label: np.ndarray) -> None:
        some = self.moves[a]
        self.held.append(_sums(a[some], label[some], w[some]))

    def result(self) -> pa.RecordBatch:
        a, label, w = _sums(*(np.concatenate(x) for x in zip(*self.held)))
        at = np.lexsort((label, -np.round(w, 9), a))
        a, label = a[at], label[at]
        head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.array([], np.int64)
        new = self.own.copy()
        new[a[head]] = label[head]
        return pa.RecordBatch.from_arrays([pa.array([self.i], pa.int32()), pa.array([new.tobytes()], pa.binary())], ["j", "labels"])


class _Inside(_Range):
    def __init__(self, i: int, moves: np.ndarray, own: np.ndarray):
        super().__init__(i, moves, own)
        self.s, self.c = np.zeros(len(own)), np.zeros(len(own), np.int64)

    def add(self, a: np.ndarray, w: np.ndarray, label: np.ndarray) -> None:
        same = self.own[a] == label
        self.s += np.bincount(a[same], w[same], len(self.s))
        self.c += np.bincount(a[same], minlength=len(self.c))

    def result(self) -> pa.RecordBatch:
        k = np.arange(len(self.own), dtype=np.int64) + (self.i << PLACE)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k, self.own, self.s, self.c)], ["k", "label", "s", "c"])


class Graph:
    """``edges`` (a, b, score), each given once and valid in both directions, packed for ``rounds`` rounds."""

    def __init__(self, edges: DataFrame, rounds: int = 12):
        if not 0 <= rounds < 63:
            raise ValueError("rounds must be under 63")
        e = edges.filter("a is not null and b is not null").select("a", "b", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        ids = checkpoint(e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct())
        self.rounds, self.nodes = rounds, ids.count()
        ranges = max(partitions_for(self.nodes, NODES, 1), partitions_for(2 * e.count(), EDGES, 1))
        #: (id, k): the number of each node.
        self.numbers = checkpoint(ids.repartitionByRange(ranges, "id").sortWithinPartitions("id").withColumn("k", F.monotonically_increasing_id()))
        release(ids)
        end = lambda s: unbroadcast(self.numbers.select(F.col("id").alias(s), F.col("k").alias(f"k{s}")))
        coded = checkpoint(e.join(end("a"), "a").join(end("b"), "b").select("ka", "kb", "score"))
        # half of the nodes move in a round, by a hash of node and round
        moves = sum((F.when(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0, F.lit(1 << r)).otherwise(F.lit(0)).cast("bigint") for r in range(rounds)), F.lit(0).cast("bigint"))
        none = F.lit(None).cast("bigint")
        rows = coded.select("ka", "kb", "score", none.alias("moves")).unionByName(coded.select(F.col("kb").alias("ka"), F.col("ka").alias("kb"), "score", none.alias("moves")))
        rows = rows.unionByName(self.numbers.select(F.col("k").alias("ka"), F.col("k").alias("kb"), F.lit(0.0).alias("score"), moves.alias("moves")))
        of = lambda k: F.shiftright(k, PLACE).cast("int")
        at = lambda k: F.col(k).bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
        rows = rows.select(of("ka").alias("i"), of("kb").alias("j"), at("ka").alias("a"), at("kb").alias("b"), "score", "moves")
        rows = rows.repartitionById(ranges, "i").sortWithinPartitions("i", F.col("i") != F.col("j"), "j", "a")
        self.packed = checkpoint(rows.mapInArrow(_pack, "i int, j int, a binary, b binary, w binary, moves binary"), spark__sql__parquet__compression__codec="zstd")
        release(coded)

    def _fold(self, labels: DataFrame, kind: Callable[..., _Range], schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = None
            for batch in batches:
                for r in batch.to_pylist():
                    label = np.frombuffer(r["labels"], np.int64)
                    if r["i"] == r["j"]:
                        if state is not None:
                            yield state.result()
                        state = kind(r["i"], np.frombuffer(r["moves"], np.int64), label)
                    state.add(np.frombuffer(r["a"], np.int32), np.frombuffer(r["w"], np.float64), label[np.frombuffer(r["b"], np.int32)])
            if state is not None:
                yield state.result()

        to = labels.select(F.col("j").alias("to"), "labels").coalesce(1)
        both = self.packed.hint("shuffle_replicate_nl").join(to, F.col("j") == F.col("to")).select("i", "j", "a", "b", "w", "moves", "labels")
        return checkpoint(both.mapInArrow(run, schema), **WHOLE)

    def labels(self) -> DataFrame:
        """(j, labels): the labels of each range after all rounds."""

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [(np.arange(len(m) // 8, dtype=np.int64) + (i << PLACE)).tobytes() for i, m in zip(batch["i"].to_pylist(), batch["moves"].to_pylist())]
                yield pa.RecordBatch.from_arrays([batch["i"], pa.array(own, pa.binary())], ["j", "labels"])

        lab = checkpoint(self.packed.filter("i = j").select("i", "moves").mapInArrow(start, "j int, labels binary"))
        for i in range(self.rounds):
            before, lab = lab, self._fold(lab, type("Votes", (_Votes,), {"round": i}), "j int, labels binary")
            release(before)
        return lab

    def members(self) -> DataFrame:
        """(k, label, s, c): each node's label after all rounds, both as numbers, with the sum and count of the scores to nodes of its label."""
        lab = self.labels()
        out = self._fold(lab, _Inside, "k bigint, label bigint, s double, c bigint")
        release(lab)
        release(self.packed)
        return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, a, b, score, moves), sorted by the first two, as a row for each i and j; rows with ``moves`` are nodes."""
    key, held = None, []

    def one() -> pa.RecordBatch:
        i, j, a, b, w, m = (x.combine_chunks() for x in pa.Table.from_batches(held).columns)
        node = m.is_valid().to_numpy(zero_copy_only=False)
        a, b, w, edge = a.to_numpy(), b.to_numpy(), w.to_numpy(), ~node
        moves = None
        if node.any():
            moves = np.zeros(int(node.sum()), np.int64)
            moves[a[node]] = m.drop_null().to_numpy()
            moves = moves.tobytes()
        kept = [pa.array([x], t) for x, t in ((key[0], pa.int32()), (key[1], pa.int32()), (a[edge].tobytes(), pa.binary()), (b[edge].tobytes(), pa.binary()), (w[edge].tobytes(), pa.binary()), (moves, pa.binary()))]
        return pa.RecordBatch.from_arrays(kept, ["i", "j", "a", "b", "w", "moves"])

    for batch in batches:
        i, j = batch["i"].to_numpy(), batch["j"].to_numpy()
        edge = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True]) if len(i) else []
        for lo, hi in zip(edge[:-1], edge[1:]):
            if held and key != (int(i[lo]), int(j[lo])):
                yield one()
                held = []
            key = (int(i[lo]), int(j[lo]))
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield one()
