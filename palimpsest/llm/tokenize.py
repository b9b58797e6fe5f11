"""Encoding a corpus with a public byte-level BPE vocabulary.

Method: prefix dynamic programming. Within a pre-token, every byte prefix has
exactly one valid encoding, so one *last token* is stored for each prefix: the
token that ends there and forms a valid pair with the last token of the prefix
before it. The ids follow by walking back. Cost is linear in the length of a
pre-token however long it is (no quadratic merging on long runs), appended text
continues the table, and an edit is encoded again only up to the point where
its pre-tokens meet the old ones.

Pre-tokens follow Zipf's law, so each Python worker keeps a table of those it
has encoded. Batches arrive and leave as Arrow, without a shuffle.

Defined results: an empty or null text gives an empty list; the key column may
be null and is passed on; other columns are dropped, so clashing names cannot
arise. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import array
import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-token pattern of the public byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII only, in the faster standard library.
ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
ANY = regex.compile(PATTERN).findall
MAX_KEPT = 400_000


def split(text: str) -> list[str]:
    """The pre-tokens of a text; joined they are the text."""
    return ASCII(text) if text.isascii() else ANY(text)


class PrefixEncoder(dict):
    """Ids of pre-tokens, encoded when first looked up."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.endings = {k[i:] for k in ranks for i in range(len(k))}
        self.split = split
        self.valid_pair = lru_cache(maxsize=1 << 20)(self._valid_pair)
        self.valid_token = lru_cache(maxsize=1 << 17)(lambda t: self.merge(self.bytes_of[t]) == [t])

    def merge(self, piece: bytes) -> list[int]:
        """Plain byte-pair merging, lowest rank first; only used on one or two tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _valid_pair(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def last_tokens(self, piece: bytes, table: list[int] | None = None) -> list[int]:
        """The last token of each non-empty prefix; continues a table of a shorter piece."""
        table = table if table is not None else []
        ranks = self.ranks
        endings = self.endings
        for end in range(len(table) + 1, len(piece) + 1):
            # tokens that end here, shorter ones first; nothing longer can follow what ends no token
            found = []
            for start in range(end - 1, -1, -1):
                part = piece[start:end]
                if part not in endings:
                    break
                if part in ranks:
                    found.append((start, ranks[part]))
            for start, t in reversed(found):
                if self.valid_token(t) and (start == 0 or self.valid_pair(table[start - 1], t)):
                    table.append(t)
                    break
        return table

    def walk(self, table: list[int]) -> tuple[int, ...]:
        out, at = [], len(table)
        while at:
            out.append(table[at - 1])
            at -= len(self.bytes_of[table[at - 1]])
        return tuple(reversed(out))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None and self.valid_token(whole) else self.walk(self.last_tokens(raw))
        if len(self) >= MAX_KEPT:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []

    def append(self, pieces: list[str], more: str) -> list[str]:
        """Pre-tokens of a longer text: only the last two can change."""
        return pieces[:-2] + self.split("".join(pieces[-2:]) + more)

    def edit(self, pieces: list[str], start: int, end: int, new: str) -> tuple[list[str], int]:
        """Pre-tokens after text[start:end] became ``new``, and how many were split again."""
        at, first = 0, 0
        while first < len(pieces) and at + len(pieces[first]) < start:
            at += len(pieces[first])
            first += 1
        first = max(0, first - 2)
        head = sum(map(len, pieces[:first]))
        last, pos = first, head
        while last < len(pieces) and pos < end:
            pos += len(pieces[last])
            last += 1
        inner = "".join(pieces[first:last])
        inner = inner[: start - head] + new + inner[end - head :]
        # widen to the right until splitting again meets the old pre-tokens
        grow = 1
        while True:
            stop = min(len(pieces), last + grow)
            again = self.split(inner + "".join(pieces[last:stop]))
            if stop == len(pieces) or (len(again) > 3 and stop - last >= 3 and again[-3:] == pieces[stop - 3 : stop]):
                return pieces[:first] + again + pieces[stop:], len(again)
            grow *= 2


_ENCODERS: dict[str, PrefixEncoder] = {}


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def encoder(raw: bytes) -> PrefixEncoder:
    key = hashlib.sha1(raw).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(parse_ranks(raw))
    return _ENCODERS[key]


def encode_column(df: DataFrame, key: str, text: str, *, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", counts_only: bool = False) -> DataFrame:
    """``key`` and ``ids`` (or ``n_tokens``) of each row. The vocabulary, some 1 MB, is read on the driver and broadcast."""
    with open(vocabulary, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    one = df.select(F.col(key).alias(key), F.col(text).alias("_text"))
    kind = one.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        get, split = enc.__getitem__, enc.split
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 500):
                part = texts.slice(lo, 500)
                flat, offsets = array.array("i"), array.array("i", [0])
                for t in part.to_pylist():
                    if t:
                        flat.extend(chain.from_iterable(map(get, split(t))))
                    offsets.append(len(flat))
                starts = pa.array(memoryview(offsets), pa.int32())
                if counts_only:
                    out = pa.compute.subtract(starts.slice(1), starts.slice(0, len(offsets) - 1))
                else:
                    out = pa.ListArray.from_arrays(starts, pa.array(memoryview(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 500), out], [key, "n_tokens" if counts_only else "ids"])

    return one.mapInArrow(run, f"`{key}` {kind}, n_tokens int" if counts_only else f"`{key}` {kind}, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
