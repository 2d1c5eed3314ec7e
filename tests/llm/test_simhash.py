"""SimHash groups against brute force."""

import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from textguard.llm import queries, simhash
from textguard.llm.components import components


def plain_print(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints, distance):
    least = dict(zip(ids, ids))
    unsigned = np.array(prints, np.uint64)
    while True:
        changed = False
        for i, a in enumerate(ids):
            near = np.bitwise_count(unsigned ^ unsigned[i]) <= distance
            best = min(least[ids[j]] for j in np.flatnonzero(near))
            if best < least[a]:
                least[a], changed = best, True
        if not changed:
            return least


def test_fingerprint():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 30, 700):
        text = " \n".join(rng.choice(["Ab", "é", "the", "X1", "zz"]) for _ in range(n))
        for k in (1, 3, 5):
            assert simhash.fingerprints(text, k)[0] & (1 << 64) - 1 == plain_print(text, k)
    assert simhash.fingerprints("a b " * 70_000, 3)[0] & (1 << 64) - 1 == plain_print("a b " * 70_000, 3)


def test_near_pairs(spark):
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        for flips in (0, 1, 2, 3, 3, 4, 5):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), flips)))
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fingerprint long")
    for distance in (0, 1, 2, 3):
        got = {frozenset((r.a, r.b)) for r in simhash.near_pairs(frame, distance).collect()}
        want = {
            frozenset((a[0], b[0]))
            for i, a in enumerate(signed)
            for b in signed[:i]
            if bin((a[0] ^ b[0]) & (1 << 64) - 1).count("1") <= distance
        }
        assert got == want
    kinds = frame.withColumn("kind", F.abs(F.col("fingerprint") % 2) + 1)
    mixed = {(r.kind, frozenset((r.a, r.b))) for r in simhash.near_pairs(kinds).collect()}
    assert mixed == {(min(p) % 2 + 1, p) for p in want if len({x % 2 for x in p}) == 1}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (7, 6), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    least = list(range(300))
    for _ in range(300):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: least[i] for ab in links if ab[0] != ab[1] for i in ab}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(spark):
    rows = [(3, None), (1, ""), (None, " \n"), (5, "x y z"), (5, "x y z"), (None, "only nulls here"), (9, "q " * 9000)]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, component_id string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect())
    assert got == [(False, 1, ""), (False, 5, "x y z"), (False, 9, "q " * 9000), (True, None, "only nulls here")]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_more_prints_find_more(spark):
    rng = random.Random(8)
    rows, kept_most = [], 0
    for i in range(120):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
        rows.append((10 * i, " ".join(words)))
        words[rng.randrange(300)] = "changed"
        words[rng.randrange(300)] = "changed"
        rows.append((10 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for prints in (1, 8):
        kept = {r.doc_id for r in simhash.one_of_each(docs, prints=prints).collect()}
        assert {10 * i for i in range(120)} <= kept
        kept_most, before = len(kept), kept_most
    assert kept_most < before - 20


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_print(r.text or "", 3) for r in docs]
    least = groups([r.doc_id for r in docs], prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, folder).collect()}
    assert got == {r.doc_id: (f"{p:016x}", least[r.doc_id]) for r, p in zip(docs, prints)}
    assert len({c for _, c in got.values()}) < len(got)
