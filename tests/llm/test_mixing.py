"""Mixing against a plain water filling, and limits on copies."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textguard.llm import mixing, queries


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        unit = sum(weight[s] for s in names if s not in full)
        got = {s: 3 * sizes[s] if s in full else left * weight[s] / unit for s in names}
        above = {s for s in names if s not in full and got[s] > 3 * sizes[s]}
        if not above:
            return got
        full |= above


def check(rows, near):
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    want = plain_targets(sizes)
    for s in sizes:
        assert goal[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - want[s]) <= near(want[s])
    assert {r.source_size for r in rows} == set(sizes.values())


def test_mix(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        source = rng.choice(["a"] * 30 + ["b", "é", "z", "", None, "Q", "q", "rare"])
        rows.append((i, "w " * int(rng.paretovariate(1.1) * 5), source, "x"))
    rows += [(7, "same words here", "a", "x")] * 400 + [(None, None, "b", "x"), (8, "", None, "x"), (9, None, "void", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(7)
    mix = mixing.mixed(docs, ["doc_id"])
    got = mix.select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(rows)
    check(got, lambda goal: max(12, 0.002 * goal))
    again = mixing.mixed(docs.repartition(3), ["doc_id"]).select(*got[0].asDict()).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    named = docs.withColumn("Size", F.concat(F.lit("s"), F.col("doc_id").cast("string"))).withColumn("copies", F.lit(1.5))
    copies = mixing.repeated(named, ["doc_id"])
    assert copies.schema == named.schema
    assert all(r.target == "x" and r.copies == 1.5 and r.Size == (r.doc_id is not None and f"s{r.doc_id}" or None) for r in copies.collect())
    assert copies.count() == sum(r.copies for r in got)
    assert mixing.mixed(docs.limit(0), ["doc_id"]).count() == 0


def test_rates_are_tilted(spark):
    """The solved dual against a plain search for the same tilt."""
    rng = random.Random(5)
    sizes = {s: [int(rng.paretovariate(1.2) * 6) for _ in range(400)] for s in "abc"}
    aims = {"a": 0.4, "b": 2.5, "c": 1.0}
    rows = [(s, size, 1) for s in sizes for size in sizes[s]]
    counts = spark.createDataFrame(rows, "__mix_source string, __mix_size long, n long")
    counts = counts.groupBy("__mix_source", "__mix_size").agg(F.sum("n").alias("n"))
    goals = [(s, sum(sizes[s]), aims[s] * sum(sizes[s])) for s in sizes]
    goals = spark.createDataFrame(goals, "__mix_source string, __mix_source_size long, __mix_target double")
    found = {r["__mix_source"]: r for r in mixing.tilts(counts, goals).collect()}
    for s, all_sizes in sizes.items():
        mean = sum(all_sizes) / len(all_sizes)

        def words(tilt):
            return sum(x * min(3.0, math.exp(min(2.0, tilt * x / mean))) for x in all_sizes)

        low, high = -200.0, 200.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if words(middle) < aims[s] * sum(all_sizes) else (low, middle)
        assert found[s].mean == pytest.approx(mean)
        assert found[s].tilt == pytest.approx(low, abs=1e-5)
        assert abs(found[s].tilt) < 1e-6 if s == "c" else abs(found[s].tilt) > 0.01


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op9_mixing(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.size == len((r.text or "").encode().split())
    check(rows, lambda goal: max(25, 0.002 * goal))
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    tilted = 0
    for some in by_source.values():
        some.sort(key=lambda r: r.size)
        third = len(some) // 3
        short, long = (sum(r.copies for r in part) / third for part in (some[:third], some[-third:]))
        ratio = some[0].target / some[0].source_size
        if ratio < 0.7 or 1.4 < ratio < 2.5:
            assert (long < short) == (ratio < 1)  # long documents go, or come, first
            tilted += 1
    assert tilted > 4
