"""Connected components over links against a plain union-find."""

import random

import numpy as np

from pulsegrid.llm.components import components, local_components


def plain(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_paths_stars_loops_and_repeats(spark):
    rng = random.Random(4)
    path = [(10_000 + k, 10_001 + k) for k in range(300)]
    order = list(range(30_000, 30_200))
    rng.shuffle(order)
    pairs = path + list(zip(order, order[1:], strict=False)) + [(50_000, 50_001 + k) for k in range(20_000)] + [(k, rng.randrange(400)) for k in range(300)] + [(7, 7), (90_001, 90_000), (90_000, 90_001), (-5, 3)]
    rng.shuffle(pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(6)).collect()}
    want = plain([p for p in pairs if p[0] != p[1]])
    assert got == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1), (None, 2), (3, None)], "a long, b long")).where("node = 1").count() == 0


def test_local_components():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 20), (400, 390), (1000, 3000)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = plain(zip(a.tolist(), b.tolist(), strict=True))
        assert local_components(n, a, b).tolist() == [want.get(i, i) for i in range(n)]
    chain = np.arange(999)
    assert (local_components(1000, chain, chain + 1) == 0).all()
