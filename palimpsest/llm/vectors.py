"""The most similar vectors of every vector, by additive quantisation.

Method. Vectors are normalised and split into cells by a coarse codebook; what
is left of a vector after its cell's centre is encoded additively: ``books``
full-dimensional codebooks, each fitted to the residuals of those before it, of
which a beam search keeps the ``beam`` best partial sums. Stored are the codes
and the norm of the decoded vector. A query is compared with the vectors of the
``probes`` nearest cells by lookup tables (one product of the query with all
codewords, then ``books`` table reads a vector), and the ``rerank`` best go on
to the exact cosine in double precision.

The codebooks are fitted on the driver on at most ``fit_rows`` vectors, the only
bound; every row is encoded, is searched and searches. The number of cells grows
with the collection, so a cell keeps some ``per_cell`` vectors: where the fit
cannot give enough centres, each cell is cut by a codebook of its residuals, and
a cell is a pair of words (up to 2,048 by 256 of them, for 200 million vectors). Exact copies are
one class and only the smallest k + 1 of its ids can be neighbours, so copies
cannot make a hot cell; a full cell is cut into blocks, and its many askers into turns, each a task of its own.

Defined results: rows of another model or length, with null or NaN entries or
all zero are not used; of a repeated id the smallest vector counts; equal
similarities go by the smaller id; fewer than k other vectors give fewer pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.common import checkpoint, unbroadcast


def usable_vectors(df: DataFrame, model: str, dimension: int) -> DataFrame:
    """(id, v): one usable vector for each memory, as stored."""
    v = F.col("embedding")
    ok = (F.col("model") == model) & (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return df.filter(ok).filter("memory_id is not null").select(F.col("memory_id").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by Lloyd's rounds; an empty cell takes the worst-served vector."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, cost = np.empty(len(x), np.int32), np.empty(len(x), np.float32)
        half = (c * c).sum(1) / 2
        for lo in range(0, len(x), 4096):
            s = x[lo : lo + 4096] @ c.T - half
            near[lo : lo + 4096] = s.argmax(1)
            cost[lo : lo + 4096] = -s.max(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
        for j, w in zip(np.flatnonzero(n == 0), np.argsort(-cost)):
            c[j] = x[w]
    return c


class AdditiveQuantiser:
    """Coarse centres and residual codebooks of full dimension."""

    def __init__(self, sample: np.ndarray, cells: int, books: int, words: int, seed: int = 5, rounds: int = 8, parts: int = 1):
        rng = np.random.default_rng(seed)
        x = sample.astype(np.float32)
        self.centres = kmeans(x, cells, rounds, rng)
        self.parts = np.zeros((1, x.shape[1]), np.float32)
        rest = x - self.centre_of(self.cells_of(x, 1)[:, 0])
        if parts > 1:
            self.parts = kmeans(rest, parts, rounds, rng)
            rest = x - self.centre_of(self.cells_of(x, 1)[:, 0])
        self.books = []
        for _ in range(books):
            book = kmeans(rest, words, rounds, rng)
            self.books.append(book)
            rest = rest - book[(rest @ book.T - (book * book).sum(1) / 2).argmax(1)]
        self.flat = np.concatenate(self.books)

    def centre_of(self, cell: np.ndarray) -> np.ndarray:
        return self.centres[cell // len(self.parts)] + self.parts[cell % len(self.parts)]

    def cells_of(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells, nearest first; of cut cells the nearest parts of the nearest four times as many."""
        s = x @ self.centres.T - (self.centres * self.centres).sum(1) / 2
        n = len(self.parts)
        wide = min(probes if n == 1 else 4 * probes, s.shape[1])
        top = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
        s = np.take_along_axis(s, top, 1)
        if n > 1:
            cells = (top[:, :, None] * n + np.arange(n)).reshape(len(x), -1)
            cross = (self.centres @ self.parts.T)[top]
            s = (s[:, :, None] + (x @ self.parts.T)[:, None, :] - cross - (self.parts * self.parts).sum(1) / 2).reshape(len(x), -1)
            keep = np.argpartition(-s, min(probes, s.shape[1]) - 1, axis=1)[:, :probes]
            top, s = np.take_along_axis(cells, keep, 1), np.take_along_axis(s, keep, 1)
        return np.take_along_axis(top, np.argsort(-s, axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, cell: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search over the codebooks, and the squared norm of each decoded vector."""
        target = x - self.centre_of(cell)
        n = len(x)
        kept = np.zeros((n, 1, x.shape[1]), np.float32)
        codes = np.zeros((n, 1, 0), np.int16)
        for book in self.books:
            rest = target[:, None, :] - kept
            gain = 2 * rest @ book.T - (book * book).sum(1)  # the error that each word takes away
            error = (rest * rest).sum(2)[:, :, None] - gain
            width = min(beam, error.shape[1] * error.shape[2])
            flat = error.reshape(n, -1)
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            path, word = best // len(book), (best % len(book)).astype(np.int16)
            rows = np.arange(n)[:, None]
            kept = kept[rows, path] + book[word]
            codes = np.concatenate([codes[rows, path], word[:, :, None]], axis=2)
        error = ((target[:, None, :] - kept) ** 2).sum(2)
        at = np.arange(n), error.argmin(1)
        whole = kept[at] + self.centre_of(cell)
        return codes[at], (whole * whole).sum(1)

    def scores(self, q: np.ndarray, cell: np.ndarray, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Approximate cosines of queries with encoded vectors of any cells, by lookup tables."""
        # word-major tables: a code reads one contiguous row with its products with all queries
        table = self.flat @ q.T
        own, back = np.unique(cell, return_inverse=True)
        out = (self.centre_of(own) @ q.T)[back]
        at = 0
        for m, book in enumerate(self.books):
            out += table[at + codes[:, m]]
            at += len(book)
        return out.T / np.sqrt(norm)


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -sims))[:k]


def _matrix(column: pa.Array, unit: bool = True) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles, of length one if ``unit``."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x


def _lists(a: np.ndarray, dtype: type) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(a).ravel().astype(dtype)))


def fit(reps: DataFrame, total: int, per_cell: int, books: int, words: int, fit_rows: int, seed: int) -> AdditiveQuantiser:
    """The quantiser, fitted on at most ``fit_rows`` vectors chosen by hash."""
    share = int(min(1.0, 1.2 * fit_rows / total) * 1_000_000) + 1
    mark = F.xxhash64("c", F.lit(seed))
    chosen = reps.filter(F.pmod(mark, F.lit(1_000_000)) < share).orderBy(mark).limit(fit_rows).select("v").toArrow()
    if not chosen.num_rows:
        chosen = reps.select("v").limit(1).toArrow()
    sample = _matrix(chosen.column(0).combine_chunks())
    wanted = max(1, total // per_cell)
    cells = max(1, min(wanted, len(sample) // 8))
    return AdditiveQuantiser(sample, cells, books, min(words, len(sample)), seed, parts=min(-(-wanted // cells), words, len(sample)))


def nearest(
    vectors: DataFrame, k: int = 5, *, per_cell: int = 400, probes: int = 4, books: int = 8, words: int = 256, beam: int = 4, rerank: int = 256, fit_rows: int = 16_384, block: int = 4_000, seed: int = 5
) -> DataFrame:
    """(id, other, cosine): the k most similar others of each id of ``vectors`` (id, v)."""
    spark = vectors.sparkSession
    keyed = checkpoint(vectors.select("id", "v", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256).alias("c")))
    reps = checkpoint(keyed.groupBy("c").agg(F.min("id").alias("rep"), F.first("v").alias("v"), F.count("*").alias("n")))
    total = reps.count()
    if total == 0:
        return spark.createDataFrame([], "id string, other string, cosine double")
    shared = spark.sparkContext.broadcast(fit(reps, total, per_cell, books, words, fit_rows, seed))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                x = _matrix(part.column(1)).astype(np.float32)
                near = q.cells_of(x, probes)
                codes, norm = q.encode(x, near[:, 0], beam)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(near, np.int32), _lists(codes, np.int16), pa.array(norm.astype(np.float32))], ["rep", "v", "cells", "codes", "norm"])

    coded = checkpoint(reps.select("rep", "v").mapInArrow(encode, "rep string, v array<float>, cells array<int>, codes array<smallint>, norm float"))
    # a full cell is cut into blocks, and those who ask it into turns; each turn meets each block in a task of its own
    fill = coded.groupBy(F.element_at("cells", 1).alias("cell")).agg(F.count("*").alias("n"))
    crowd = coded.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("asked"))
    cut = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    fill = checkpoint(crowd.join(fill, "cell").select("cell", cut(F.col("n")).alias("blocks"), cut(F.col("asked") / 4).alias("turns")))
    base = coded.select("rep", "v", "codes", "norm", F.element_at("cells", 1).alias("cell")).join(fill, "cell")
    base = base.select("cell", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "rep", "v", "codes", "norm")
    asks = coded.select("rep", "v", F.explode("cells").alias("cell")).join(fill, "cell")
    asks = asks.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("rep", "cell"), F.col("turns")).cast("int").alias("turn"), "rep", "v")

    def search(key: tuple, base: pa.Table, asks: pa.Table) -> pa.Table:
        q = shared.value
        reps, others, sims = [], [], []
        if base.num_rows and asks.num_rows:
            b, ids = _matrix(base["v"].combine_chunks()), np.array(base["rep"].to_pylist())
            codes = _matrix(base["codes"].combine_chunks(), False).astype(np.int64)
            norm, cell = base["norm"].to_numpy(), np.full(len(b), key[0].as_py())
            for lo in range(0, asks.num_rows, 256):
                part = asks.slice(lo, 256)
                x, own = _matrix(part["v"].combine_chunks()), np.array(part["rep"].to_pylist())
                near = q.scores(x.astype(np.float32), cell, codes, norm)
                width = min(rerank, near.shape[1])
                top = np.argpartition(-near, width - 1, axis=1)[:, :width]
                exact = np.einsum("ij,ikj->ik", x, b[top])
                names = ids[top]
                exact[names == own[:, None]] = -9
                order = np.lexsort((names, -exact), axis=1)[:, :k]  # cosine down, then id up
                reps.append(np.repeat(own, order.shape[1]))
                others.append(np.take_along_axis(names, order, 1).ravel())
                sims.append(np.take_along_axis(exact, order, 1).ravel())
        whole = lambda parts, t: np.concatenate(parts) if parts else np.array([], t)
        out = pa.table({"rep": pa.array(whole(reps, str).tolist(), pa.string()), "other": pa.array(whole(others, str).tolist(), pa.string()), "cosine": pa.array(whole(sims, float), pa.float64())})
        return out.filter(pa.compute.greater(out["cosine"], -5))

    again = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    hits = again(base).groupBy("cell", "block", "turn").cogroup(again(asks).groupBy("cell", "block", "turn")).applyInArrow(search, "rep string, other string, cosine double")
    hits = hits.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), F.col("other").alias("id")))), 1, k).alias("near"))
    hits = checkpoint(hits)
    # the smallest k + 1 ids of each class, first within salts so that no task sorts a whole hot class
    salted = keyed.select("c", "id", F.pmod(F.xxhash64("id"), F.lit(16)).alias("salt"))
    first = lambda df, keys: df.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).filter(F.col("r") <= k + 1).drop("r")
    firsts = first(first(salted, ["c", "salt"]), ["c"]).groupBy("c").agg(F.collect_list("id").alias("ids"))
    named = checkpoint(reps.select("c", "rep").join(unbroadcast(firsts), "c"))
    far = hits.select("rep", F.explode("near").alias("x")).select("rep", "x.far", F.col("x.id").alias("other"))
    far = far.join(unbroadcast(named.select(F.col("rep").alias("other"), F.col("ids"))), "other").select("rep", "far", F.explode("ids").alias("id"))
    own = named.select("rep", F.lit(-1.0).alias("far"), F.explode("ids").alias("id"))
    pool = far.unionByName(own).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("far", "id"))).alias("pool"))
    pool = named.select("c", "rep").join(unbroadcast(pool), "rep").select("c", "pool")
    out = keyed.select("id", "c").join(unbroadcast(pool), "c")
    mine = F.slice(F.filter("pool", lambda x: x["id"] != F.col("id")), 1, k)
    return out.select("id", F.explode(mine).alias("x")).select("id", F.col("x.id").alias("other"), (-F.col("x.far")).alias("cosine"))


MODEL, DIMENSION = "nimbus-embed-64", 64


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_vectors(spark.read.parquet(f"{sf_dir}/memory_embeddings.parquet"), MODEL, DIMENSION)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(_vectors(spark, sf_dir))
    return near.select(F.least("id", "other").alias("memory_id_a"), F.greatest("id", "other").alias("memory_id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable memory with its five most similar ones, their rank and cosine."""
    near = nearest(_vectors(spark, sf_dir))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return near.select(F.col("id").alias("memory_id"), rank.alias("rank"), F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))
