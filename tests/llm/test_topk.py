"""Exact top-k against brute force."""

import math
import random

import numpy as np

from pyspark.sql import functions as F

from textguard.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score string, ID string"


def plain(rows, every, k=5):
    """All scores in whole numbers, by loops."""
    whole = set()
    for i, v in {(r[0], None if r[1] is None else tuple(r[1])) for r in rows}:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(256 * x) < topk.REACH for x in v):
            whole.add((i, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, v in whole:
        if i % every:
            continue
        scores = sorted({(-sum(a * b for a, b in zip(v, w)), j, w) for j, w in whole if j != i and len(w) == len(v)})
        out += [(i, n, j, -s) for n, (s, j, _) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, every, k=5, parts=5):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in topk.top(frame, F.col("id") % every == 0, k).collect())


def test_against_loops(spark):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(1500):
        centre, length = rng.choice(centres), rng.paretovariate(1.5)
        v = [length * (c + rng.gauss(0, 0.1)) for c in centre]
        rows.append((i, v, "x", "y"))
    rows += [(2000 + i, [1.0] * 8, "x", None) for i in range(300)]  # a common vector
    assert found(spark, rows, 50) == plain(rows, 50)


def test_edges(spark):
    bad = [None, [1.0, None], [1.0, math.nan], [math.inf, 1.0], [1e9, 0.0]]
    rows = [(100 + i, v, None, None) for i, v in enumerate(bad)] + [(None, [1.0, 2.0], None, None)]
    rows += [(0, [0.0, 0.0], "s", "i"), (2, [-1.0, 0.5], "s", "i"), (3, [200.0, -3.0], None, "i")] * 2
    rows += [(4, [1.0, 2.0, 3.0], None, None), (5, [1.0, 2.0, 3.0], None, None), (6, [], None, None), (8, [], None, None)]
    rows += [(2, [0.25, 0.5], None, None), (7, [0.0, 0.0], None, None), (9, [-0.001, 0.001], None, None)]
    assert found(spark, rows, 1) == plain(rows, 1)
    assert found(spark, rows, 1, k=1) == plain(rows, 1, k=1)
    assert found(spark, rows[:5], 1) == [] and found(spark, [], 1) == []
    assert found(spark, [(0, [1.0], None, None)], 1) == []


def test_large_products_are_exact(spark):
    rng = random.Random(3)
    top = topk.REACH / 256 - 1
    rows = [(i, [top - rng.random() for _ in range(40)], None, None) for i in range(60)]
    assert found(spark, rows, 7) == plain(rows, 7)


def test_ways(monkeypatch):
    """Each way gives all that reaches the threshold, and pruning leaves work out."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(24, 16))
    p = centre[rng.integers(0, 24, 3000)] + rng.normal(size=(3000, 16)) * 0.05
    p = np.floor(256 * p / np.sqrt((p * p).sum(1, keepdims=True)))
    p = p[np.argsort(-(p * p).sum(1), kind="stable")]
    ids = np.arange(len(p))
    q = p[::100]
    want = np.sort(np.where(ids[::100][:, None] == ids, -(1 << 60), (q @ p.T)), axis=1)[:, -5:]
    pairs = []
    plain = topk._paired
    monkeypatch.setattr(topk, "_paired", lambda a, b: pairs.append(len(a)) or plain(a, b))
    for least in (0.5, 2.0):  # with coordinates, and by lengths alone
        monkeypatch.setattr(topk, "COORDINATES", least)
        search = topk.Search(ids[::100], q, 5, (ids[:64], p[:64]))
        for at in range(0, len(p), 512):
            search.meet(ids[at : at + 512], p[at : at + 512])
        got = search.best[2].reshape(len(q), 5)[:, ::-1]
        assert (got == want).all()
    assert 0 < sum(pairs) < len(q) * len(p) / 4
