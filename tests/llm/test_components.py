import random

from panelspark.llm.common import Scratch
from panelspark.llm.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return sorted((x, find(x)) for x in root)


def test_chains_stars_and_random_graphs(spark):
    random.seed(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    back = [(300 - i, 301 - i) for i in range(30)]
    star = [(1000, 400 + i) for i in range(50)]
    some = [(random.randrange(2000, 2060), random.randrange(2000, 2060)) for _ in range(40)]
    edges = chain + back + star + [(a, b) for a, b in some if a != b]
    df = spark.createDataFrame([*edges, *edges, (7, 7), (None, 3)], "src long, dst long")
    got = sorted((r.node, r.component) for r in connected_components(df, Scratch(spark)).collect())
    assert got == brute(edges)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark)).count() == 0
