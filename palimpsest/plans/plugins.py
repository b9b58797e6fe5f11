"""What a user may supply: extractors, embedders, clusterers, summarisers, rerankers, classifiers and sinks, and how they run in Spark.

Each is a plain callable on a batch of values; it runs in Arrow batches on the
executors. None is shipped but the small defaults below, which need no model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.common import checkpoint
from palimpsest.operators.knowledge import label_propagation
from palimpsest.plans import dispatch


@runtime_checkable
class FactExtractor(Protocol):
    """Texts to the facts in each."""

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[str]]: ...


@runtime_checkable
class TripleExtractor(Protocol):
    """Texts to (subject, predicate, object) in each."""

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[tuple[str, str, str]]]: ...


@runtime_checkable
class Embedder(Protocol):
    """Texts to vectors of one length; None where there is none."""

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float] | None]: ...


@runtime_checkable
class Clusterer(Protocol):
    """Weighted pairs (a, b, score) to (id, label)."""

    def __call__(self, edges: DataFrame) -> DataFrame: ...


@runtime_checkable
class EdgeWeight(Protocol):
    """Pairs (a, b, ...) to (a, b, score)."""

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


@runtime_checkable
class Summarizer(Protocol):
    """Lists of texts to a (title, text) each."""

    def __call__(self, groups: Sequence[Sequence[str]]) -> Sequence[tuple[str, str]]: ...


@runtime_checkable
class IntentClassifier(Protocol):
    """A question to an intent, or None."""

    def __call__(self, question: str) -> str | None: ...


@runtime_checkable
class Sink(Protocol):
    """Takes rows, such as counters or events."""

    def __call__(self, rows: DataFrame) -> None: ...


def _batched(df: DataFrame, columns: list[str], text: str, run: Callable[[Sequence[str]], Sequence], name: str, kind: str, arrow: pa.DataType, size: int = 256) -> DataFrame:
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + f", `{name}` {kind}"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                out = run([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(out), arrow)], [*columns, name])

    return df.select(*columns, F.col(text).alias("_text")).mapInArrow(go, schema)


def embed(df: DataFrame, key: str, text: str, model: Embedder) -> DataFrame:
    """(key, embedding) of each row."""
    return _batched(df, [key], text, lambda t: [None if v is None else [float(x) for x in v] for v in model(t)], "embedding", "array<float>", pa.list_(pa.float32()))


def extract_facts(df: DataFrame, key: str, text: str, model: FactExtractor) -> DataFrame:
    """(key, place, fact): a text without a fact is its own."""
    x = _batched(df, [key, text], text, lambda t: [list(f) or [s] for f, s in zip(model(t), t)], "facts", "array<string>", pa.list_(pa.string()))
    return x.select(key, F.posexplode("facts").alias("place", "fact"))


#: Words between a subject and an object, with their predicate.
PLAIN_TRIPLES = [(r"uses", "uses"), (r"depends on", "depends_on"), (r"is part of", "part_of"), (r"leads to", "leads_to"), (r"is caused by", "caused_by"), (r"works at", "works_at")]


def plain_triples(texts: Sequence[str]) -> list[list[tuple[str, str, str]]]:
    """Triples by words: a capitalised name, the words of a predicate, a capitalised name."""
    name = r"((?!The )[A-Z][\w-]*(?: [A-Z][\w-]*)*)"
    return [[(m[1], p, m[2]) for rx, p in PLAIN_TRIPLES for m in re.finditer(rf"\b{name} {rx} (?:the )?{name}", t)] for t in texts]


def extract_triples(df: DataFrame, key: str, text: str, model: TripleExtractor = plain_triples) -> DataFrame:
    """(key, subject, predicate, object), distinct."""
    x = _batched(df, [key], text, lambda t: [["\u0001".join(s) for s in r] for r in model(t)], "triples", "array<string>", pa.list_(pa.string()))
    x = x.select(key, F.explode("triples").alias("t")).select(key, F.split("t", "\u0001").alias("t"))
    return x.select(key, F.col("t")[0].alias("subject"), F.col("t")[1].alias("predicate"), F.col("t")[2].alias("object")).distinct()


def cluster(pairs: DataFrame, weigh: EdgeWeight | None = None, clusterer: Clusterer = label_propagation) -> DataFrame:
    """(id, label) of pairs (a, b, score), weighed anew if a strategy is given."""
    return clusterer(checkpoint(weigh(pairs) if weigh else pairs))


def classify(question: str, entities: set[str], model: IntentClassifier | None = None) -> dispatch.Plan:
    """The plan by patterns; a model is asked only where they point nowhere, and what it says against a strong signal does not count."""
    plan = dispatch.route(question, entities)
    s = dispatch.signals(question, entities)
    if model is None or max(s[k] for k in ("factual", "temporal", "abstract", "affective")) >= dispatch.STRONG:
        return plan
    said = model(question)
    if said not in dispatch.FALLBACK or said == "hybrid":
        return plan
    return dispatch.Plan(said, [said], [], dispatch.FALLBACK[said])


def parquet_sink(path: str) -> Sink:
    """A sink that appends rows to a folder."""
    return lambda rows: rows.write.mode("append").parquet(path)
