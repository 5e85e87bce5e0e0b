"""Tilts and targets against plain numpy, and rows with every awkward column name."""

import math
from collections import Counter

import numpy as np
from helpers import prose

from chiweave.llm.mixing import mix, targets, tilts


def bisected(sizes, target, cap, scale):
    """The tilt at which the rates of ``sizes`` take ``target`` words, by bisection."""
    low, high = -1e6, 1e6
    for _ in range(300):
        mid = (low + high) / 2
        z = np.clip(mid * sizes / scale - math.log(cap - 1), -700, 700)
        low, high = (mid, high) if (cap / (1 + np.exp(-z)) * sizes).sum() < target else (low, mid)
    return (low + high) / 2


def test_tilts_equal_bisection(spark):
    rng = np.random.default_rng(3)
    sizes = {s: rng.integers(1, 400, 200) for s in range(1, 6)}
    goal = {1: 1.7, 2: 0.4, 3: 1.0, 4: 2.9, 5: 0.05}
    hist = spark.createDataFrame([(s, int(x), n) for s, v in sizes.items() for x, n in Counter(v.tolist()).items()], "sid int, size long, n long")
    goals = spark.createDataFrame([(s, int(v.sum()), float(goal[s] * v.sum())) for s, v in sizes.items()], "sid int, source_size long, target double")
    for r in tilts(hist, goals, 3).collect():
        v = sizes[r["sid"]].astype(float)
        want = bisected(v, goal[r["sid"]] * v.sum(), 3, r["scale"])
        assert abs(r["tilt"] - want) <= 1e-4 * max(1, abs(want)), r["sid"]


def test_targets_refill_by_weight(spark):
    sizes = {"a": 10, "b": 1000, "c": 3000, "d": 5, "e": 40, "f": 9, None: 70}
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), (5.0, 2.0, 1.0), 3).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, open_, left, want = dict(zip(order, (5, 2, 1) * 3)), set(order), float(sum(sizes.values())), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        want |= {s: 3.0 * sizes[s] if s in above else level * weight[s] for s in (above or open_)}
        left -= sum(want[s] for s in above)
        open_ = open_ - above if above else set()
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_every_other_column_comes_through(spark):
    df = spark.createDataFrame([(i, prose(i, 5 + i % 30), f"s{i % 3}") for i in range(200)] + [(None, None, None)], "doc_id long, text string, source string")
    names = ("s", "settled", "class", "edge", "key", "sid", "tilt", "scale", "chosen", "row", "lack", "items")
    wide = df.selectExpr("*", *(f"'own {c}' AS `{c}`" for c in names), "7 AS size", "'x' AS copies")
    got = mix(wide)
    assert got.columns == ["doc_id", "text", "source", *names, "size", "source_size", "target", "rate", "copies"]
    rows = got.collect()
    assert len(rows) == 201 and all(r[c] == f"own {c}" for r in rows for c in names)
    plain = {r["doc_id"]: (r["size"], r["copies"]) for r in mix(df).collect()}
    assert {r["doc_id"]: (r["size"], r["copies"]) for r in rows} == plain
