import os
import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import packing
from palimpsest.llm import tokenize as tk

VOCAB = f"{tk.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    with open(VOCAB, "rb") as f:
        raw = f.read()
    return tk.encoder(raw), tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=tk.parse_ranks(raw), special_tokens={})


HARD = ["", " ", "\n\n  x", "don't we'll I'VE", "a" * 5000, "####" * 900, "日本語のテキスト", "naïve café", "👩‍💻🙂", "1234567890" * 30, "<|endoftext|>", "\r\n\t mixed     spaces", "0x7bd897611ae86000", "é" * 700]


def test_against_the_library(both):
    mine, lib = both
    for t in HARD:
        assert mine.encode(t) == lib.encode_ordinary(t), t[:30]
    assert mine.encode(None) == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_any_text(both, text):
    mine, lib = both
    text = text.encode("utf-8", "replace").decode()
    assert mine.encode(text) == lib.encode_ordinary(text)


def test_prefix_tables_append_and_edit(both):
    mine, _ = both
    piece = b" tokenisation"
    table = mine.last_tokens(piece)
    assert len(table) == len(piece)
    for n in range(1, len(piece) + 1):
        assert list(mine.walk(table[:n])) == mine.merge(piece[:n])
    assert mine.last_tokens(piece, table[:5]) == table
    rng = random.Random(1)
    text = "It's a test, isn't it?  We'll see:\n\n 12 ticks 'n' more -- ok. " * 6
    for _ in range(200):
        a = rng.randint(0, len(text))
        b = min(len(text), a + rng.randint(0, 6))
        new = rng.choice(["", "x", " ", "'s", "\n", "12"])
        pieces, again = mine.edit(mine.split(text), a, b, new)
        assert pieces == mine.split(text[:a] + new + text[b:]) and again < 60
        assert mine.append(mine.split(text[:a]), text[a:]) == mine.split(text)


def test_frame(spark):
    df = spark.createDataFrame([(1, "", 0), (2, None, 0), (3, "hello world", 0), (None, "x", 0), (3, "hello world", 0)], "doc_id bigint, text string, ids int")
    got = sorted(((r["doc_id"], r["ids"]) for r in tk.encode_column(df, "doc_id", "text").collect()), key=repr)
    assert (1, []) in got and (2, []) in got and sum(g[0] == 3 for g in got) == 2 and len(got) == 5
    assert tk.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert {(r["doc_id"], r["n_tokens"]) for r in tk.encode_column(df, "doc_id", "text", counts_only=True).collect()} == {(1, 0), (2, 0), (3, 2), (None, 1)}


def test_boundaries_are_optimal():
    for seed in range(25):
        r = random.Random(seed)
        h = {x: r.randint(1, 9) for x in r.sample(range(1, 40), 9)}
        cost = lambda b: sum(n * (min(z for z in b if z >= s) - s) for s, n in h.items())  # noqa: E731, B023
        for buckets in (1, 2, 3, 4, 9, 12):
            got = packing.boundaries(h, buckets)
            best = min(cost({*c, max(h)}) for k in range(min(buckets, 9)) for c in combinations(h, k))
            assert len(got) <= buckets and cost(got) == best


def test_pack(spark):
    r = random.Random(3)
    items = [(i, r.choice([0, 1, 7, 50, 99, 100, 101, 250, 63, None])) for i in range(900)] + [(0, 40), (None, 30)]
    df = spark.createDataFrame(items, "key bigint, n int").selectExpr("*", "1 as capacity", "2 as bucket")
    rows = packing.pack(df.select("key", "n"), [(1, 100), (2, 64)], buckets=4).collect()
    for p, cap in ((1, 100), (2, 64)):
        used, total = {}, 0
        for x in (x for x in rows if x["pack_id"] == p):
            total += x["length"]
            assert x["length"] <= cap and x["offset"] + x["length"] <= cap
            if x["length"]:
                used.setdefault(x["container_id"], []).append((x["offset"], x["length"]))
        assert total == sum(n or 0 for _, n in items)
        for spans in used.values():
            spans.sort()
            assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sorted(used) == list(range(len(used))) and total / (len(used) * cap) > 0.85
        whole = [x for x in rows if x["pack_id"] == p and x["piece_no"] == 0]
        assert len(whole) == len(items)
        assert all(x["length"] == cap for x in rows if x["pack_id"] == p and (n := dict(items[:900]).get(x["key"])) and n > cap and x["piece_no"] < n // cap and x["key"] != 0)
    assert packing.pack(df.select("key", "n").limit(0), [(1, 100)]).count() == 0
    assert packing.pack(df.select("key", "n"), []).count() == 0
