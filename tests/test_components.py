import random

from palimpsest.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_random_chain_and_star(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 80):03d}", f"n{rng.randint(0, 80):03d}") for _ in range(60)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("h", f"s{i:03d}") for i in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges + [("x", "x"), (None, "y")], "src string, dst string")).collect()}
    assert got == brute(edges)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
