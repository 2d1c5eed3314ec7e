"""The audit of sources against plain counting, and the perfect hashes alone."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textguard.llm import divergence

SCHEMA = "text string, lang string, source string, item string, VALUE long"


def plain(rows, least, top=50):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        df[lang].update(set(found))
        n[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]

        def rates(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: rates(n[lang, s]) for s in sources}
        q = rates(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {
                "pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s],
                "term": [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def found(spark, rows, least, parts=4, **how):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in divergence.audit(frame, least, **how).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    words = ["The", "the", "naïve", "日本", "a-b", "x1y", "É", "é", "[z]"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for _ in range(900):
        weights = [1 / (i + 1) for i in range(len(words))]
        lang = rng.choice(["en", "en", "en", "fr", "", None])
        source = rng.choice(["a"] * 5 + ["b", "ä", "", None, "z"])
        text = " ".join(rng.choices(words, weights, k=rng.randint(0, 40))) + (" odd" * 3 if source == "b" else "")
        rows.append((text, lang, source))
    return rows + [("rare words only", "xx", s) for s in ("a", "b")] + [(None, "en", "void"), ("", "yy", "alone"), ("...", "fr", "void")]


def test_against_counting(spark, rows):
    want = plain(rows, 8)
    assert found(spark, rows, 8) == want and len(want) > 300
    assert found(spark, rows, 8, parts=1, top=3) == plain(rows, 8, 3)


def test_small_shards_lots_blocks_and_tiles(spark, rows, monkeypatch):
    """Several shards, passes, blocks and tiles, and tables handed on early."""
    for name, value in (("SHARD", 9), ("LOT", 900), ("BLOCK", 16), ("TILE", 2), ("DENSE", 500), ("ENTRIES", 40)):
        monkeypatch.setattr(divergence, name, value)
    assert found(spark, rows, 4) == plain(rows, 4)


def test_empty(spark):
    assert found(spark, [], 1) == []
    assert found(spark, [(None, None, None)], 1) == []
    assert found(spark, [("one", "l", "s"), (None, "l", "t")], 1) == plain([("one", "l", "s"), (None, "l", "t")], 1)


def test_perfect_hash():
    for n in (1, 2, 3, 7, 64, 1000, 9000):
        keys = [b"key%d" % i for i in range(n)]
        hashes = divergence._hashes(keys)
        made = divergence.PerfectHash.of(hashes)
        assert sorted(made(hashes).tolist()) == list(range(n))
        strange = made(divergence._hashes([b"other%d" % i for i in range(100)]))
        assert strange.min() >= 0 and strange.max() < n
    with pytest.raises(ValueError):
        divergence.PerfectHash.of(np.array([5, 5, 5], np.uint64))


def test_strangers_are_told_by_the_stored_key():
    keys = [b"a", b"bb", b"ccc"]
    made = divergence.PerfectHash.of(divergence._hashes(keys))
    ordered = [k for _, k in sorted(zip(made(divergence._hashes(keys)).tolist(), keys))]
    ends = np.cumsum([0, *map(len, ordered)]).astype(np.int32)
    row = {"lang": "l", "shard": 0, "base": 10, "n": 3, "shards": 1, "moves": made.moves.tobytes(), "offsets": ends.tobytes(), "keys": b"".join(ordered)}
    asked = [b"bb", b"no", b"ccc", b"a", b""]
    slots = divergence.Lookup([row])("l", np.zeros(5, np.int64), pa.array(asked, pa.binary()), divergence._hashes(asked))
    assert [ordered[s] if s >= 0 else None for s in slots.tolist()] == [b"bb", None, b"ccc", b"a", None]
