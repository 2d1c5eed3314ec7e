"""Phrases against plain counting of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from textguard.llm import collocation

SCHEMA = "text string, lang string, phrase string, N long, rank string"


def plain(rows, least, longest=5, covered=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        held = Counter()
        for p, a in good.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    held[p[i : i + size]] = max(held[p[i : i + size]], a)
        ranked = []
        for p, a in good.items():
            if p in held and 100 * held[p] >= covered * a:
                continue
            cuts = [(1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(spark, rows, parts=4, **how):
    frame = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in collocation.collocations(frame, **how).collect())


def test_against_counting(spark):
    rng = random.Random(12)
    vocabulary = ["the", "of", "The", "é", "naïve", "new", "york", "x y", "日本", "a\x1cb"] + [f"w{i}" for i in range(12)]
    fixed = "in the new york of naïve 日本 w1 w2 w3"
    rows = []
    for _ in range(400):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]) for w in words)
        rows.append((text + (fixed if rng.random() < 0.4 else ""), rng.choice(["en", "en", "en", "fr", "", None])))
    rows += [("same same same same same same", "en")] * 30 + [(None, "en"), ("", None), (" .,\t", "fr")]
    for how in ({"least": 20}, {"least": 5, "top": 7}, {"least": 8, "covered": 80}):
        want = plain(rows, **how)
        assert found(spark, rows, **how) == want and len(want) > 5
    assert {r[0] for r in plain(rows, 8)} >= {"en", "fr", "und", ""}


def test_sieve_by_chance(spark, monkeypatch):
    """A sieve so small that nearly all phrases pass changes nothing."""
    rng = random.Random(1)
    rows = [(" ".join(rng.choices("abcdefgh", k=30)), "en") for _ in range(100)]
    real = collocation.sieve_of
    monkeypatch.setattr(collocation, "sieve_of", lambda f, size: real(f, size, bits=64))
    assert found(spark, rows, least=4) == plain(rows, 4)


def test_long_and_empty(spark):
    rows = [("a b c " * 20000, "en"), ("z" * 300_000, "en"), ("q " * 50_000, "fr")]
    assert found(spark, rows, least=100) == plain(rows, 100)
    assert found(spark, [], least=1) == [] and found(spark, [(None, None)], least=1) == []


def test_chunks_own_each_start_once():
    rng = random.Random(4)
    words = [rng.choice(["a", "b", "c", "dd", "e", "f%d" % rng.randint(0, 999)]) for _ in range(9000)]

    def cut(words):
        made = collocation.Words(" ".join(words).encode())
        return made, *collocation.chunks_of(made, 5)

    made, first, owned, whole = cut(words)
    assert len(made) == 9000 and first.tolist() == [0, *owned[:-1]] and owned[-1] == 9000
    assert whole.tolist() == [min(9000, o + 4) for o in owned] and len(first) > 50
    # Equal passages are cut alike, up to their first and last chunk.
    again, *spans = cut(["x"] * 7 + words[100:3000] + ["y"] * 3)
    texts = set(made.spans(first, whole))
    assert len(texts & set(again.spans(spans[0], spans[2]))) >= len(set(again.spans(spans[0], spans[2]))) - 4


def test_words():
    made = collocation.Words(b"  ab\n\nc  d \n e")
    assert made.text == b"ab c d e " and made.spans(np.array([0, 1]), np.array([1, 3])) == [b"ab", b"c d"]
    assert len(set(made.piece.tolist())) == 3
    for empty in (b"", b" ", b"\n \n"):
        assert len(collocation.Words(empty)) == 0 and len(collocation.chunks_of(collocation.Words(empty), 5)[0]) == 0


def test_phrases_of_many_words_are_told_apart():
    """Codes are narrowed before they could pass 62 bits."""
    rng = random.Random(9)
    words = collocation.Words(" ".join(f"w{rng.randint(0, 40000)}" for _ in range(90000)).encode())
    text = words.text.decode().split()
    example, which = collocation._same(words, np.arange(len(words) - 4), 5)
    assert all(text[example[w] : example[w] + 5] == text[i : i + 5] for i, w in enumerate(which.tolist()))
    assert len(example) == len({tuple(text[i : i + 5]) for i in range(len(words) - 4)})


def test_slots():
    words = np.array([3, 5, 3, 5, 3], np.uint64)
    assert collocation._slots(words, 2, 1 << 20)[[0, 1]].tolist() == collocation._slots(words, 2, 1 << 20)[[2, 3]].tolist()
    assert len(collocation._slots(words, 6, 64)) == 0
