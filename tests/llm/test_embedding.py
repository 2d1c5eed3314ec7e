"""Near-duplicate embeddings against brute force."""

import numpy as np

from textguard.llm import embedding, queries


def brute(rows, threshold=0.93):
    """Rows of (key, vector, label): links of each row, and the least key each reaches."""
    unit = []
    for key, v, label in rows:
        a = np.array([np.nan if c is None else c for c in v or []], float)
        good = key is not None and label is not None and len(a) and np.isfinite(a).all() and np.abs(a).max() > 0
        unit.append(a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()) if good else None)
    near = [set() for _ in rows]
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                near[i].add(j)
                near[j].add(i)
    least = [r[0] for r in rows]
    for _ in rows:
        for i, others in enumerate(near):
            for j in others:
                least[i] = min(least[i], least[j])
    return [(r[0], len(n), c, r[0] is not None and r[0] == c) for r, n, c in zip(rows, near, least)]


def test_least_count():
    rng = np.random.default_rng(0)
    inside = np.abs(rng.standard_normal((200_000, 8))) <= embedding.HALF_WINDOW
    for k in range(8):
        share = (inside.sum(1) >= k).mean()
        assert (embedding.least_count(8, embedding.HALF_WINDOW, share + 0.01) or 0) <= k
    assert 20 <= embedding.least_count(96, 0.75, embedding.RECALL) <= 40


def test_near_pairs():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 24))
    x = np.concatenate([base + s * rng.standard_normal(base.shape) for s in (0, 0.1, 0.25, 0.35, 0.4, 0.45)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {(a, b) for i, j in embedding.near_pairs(x, None, 0.93) for a, b in zip(i.tolist(), j.tolist())}
    cosines = x @ x.T
    assert got == {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if cosines[a, b] >= 0.93}
    got = {(a, b) for i, j in embedding.near_pairs(x[:90], x[90:], 0.93) for a, b in zip(i.tolist(), j.tolist())}
    assert got == {(a, b) for a in range(90) for b in range(150) if cosines[a, 90 + b] >= 0.93}


def test_rows(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        v = rng.standard_normal(16)
        for k in range(rng.integers(1, 6)):
            rows.append([int(rng.integers(10_000)), (v + 0.2 * k * rng.standard_normal(16)).tolist(), int(i % 3)])
    rows += [[5000 + i, rows[3][1], rows[3][2]] for i in range(30)] + [[7, [3 * c for c in rows[3][1]], rows[3][2]]]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0]]
    rows += [[20_000 + i, v, 0] for i, v in enumerate(odd)]
    rows += [[None, rows[3][1], rows[3][2]], [20_050, rows[3][1], None], [20_060, [1e-300, 2e-300], 0], [20_061, [1e200, 2e200], 0]]
    rows += [[9, rows[0][1], rows[0][2]], [9, rows[0][1], rows[0][2]], [9, rows[40][1], rows[40][2]]]
    want = sorted(brute(rows), key=repr)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, kept string, n_links int")
    for block in (embedding.BLOCK, 20):
        got = sorted(map(tuple, embedding.near_duplicates(frame, block=block).collect()), key=repr)
        # The key 9 stands for two vectors, which do not link and so stay apart.
        assert [g for g in got if g[0] != 9] == [w for w in want if w[0] != 9]
        assert [g[:2] for g in got] == [w[:2] for w in want]
    assert embedding.near_duplicates(frame.limit(0)).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.op4_embedding(spark, folder).collect())
    assert got == sorted(brute(rows))
