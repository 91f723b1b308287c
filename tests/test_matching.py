"""Matches of descriptors: right by brute force, and without a row for each pair."""

import re

import numpy as np

from veritile.operators import matching
from veritile.plans.registry import QUERIES


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(8)
    words = r.integers(-(1 << 62), 1 << 62, 30)
    rows = [(g, 1000 * g + i, int(words[r.integers(30)] ^ (1 << int(r.integers(60)))), int(x), int(y)) for g in range(3) for i, (x, y) in enumerate(r.integers(0, 60, (300, 2)))]
    df = spark.createDataFrame([*rows, (5, 1, 7, 0, 0), (6, 1, None, 0, 0), (None, 2, 7, 0, 0)], "g long, id long, w long, x int, y int").repartition(5)
    got = {tuple(q) for q in matching.nearest_two(df, "g", 24, 0.95, apart=10, same_place=5).collect()}
    want: dict = {}
    for g, a, w, x, y in rows:
        others = sorted(((w ^ v) & (1 << 64) - 1).bit_count() * 100_000 + b for h, b, v, p, q in rows if h == g and b != a and (p - x) ** 2 + (q - y) ** 2 >= 100)
        d, b = divmod(others[0], 100_000)
        place = {i: (p, q) for h, i, _, p, q in rows if h == g}
        away = [o // 100_000 for o in others if o % 100_000 != b and (place[o % 100_000][0] - place[b][0]) ** 2 + (place[o % 100_000][1] - place[b][1]) ** 2 >= 25]
        if d <= 24 and d < 0.95 * min([64, *away]):
            pair = (g, min(a, b), max(a, b))
            want[pair] = min(d, want.get(pair, 64))
    assert got == {(*k, d) for k, d in want.items()} and got


def test_pairs_are_no_rows(spark):
    """A window over all pairs of an image took memory of a task with the square of its rows."""
    plan = QUERIES["hamming_knn_ratio"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Window|Join", plan)
