"""Toxicity: swaps, the penalty, and held-out accuracy."""

import zlib

import numpy as np

from textguard.llm import queries, toxicity


def test_swaps_stay_within_a_kind():
    found = toxicity.words("The Muslim woman met a gay man.")
    turned = toxicity.swapped(found)
    assert len(turned) == len(found) and turned != found
    for a, b in zip(found, turned):
        assert a == b or (b in toxicity._KIND[a] and a != b)
    assert toxicity.swapped(["nothing", "here"]) is None
    assert toxicity.swapped(found) == turned


def row(text, label, swap=True):
    found = toxicity.words(text)
    turned = toxicity.swapped(found)
    buckets = lambda w: np.array(sorted(toxicity.word_buckets(set(w))), int)
    return buckets(found), buckets(turned) if turned and swap else None, label


def test_the_penalty_keeps_neutral_mentions_low():
    texts = [("you gay scum", 1)] * 30 + [("filthy scum", 1)] * 10 + [("gay idiot", 1)] * 20
    texts += [("a nice day", 0)] * 40 + [("some straight talk", 0)] * 40 + [("my gay friend", 0)] * 3
    plain = toxicity.train([row(t, y, swap=False) for t, y in texts])
    fair = toxicity.train([row(t, y) for t, y in texts])
    gap = lambda m: abs(m.score("a gay person") - m.score("a straight person"))
    assert gap(fair) < 0.3 * gap(plain)
    assert fair.score("you scum") > 0.5 > fair.score("a gay person")


def test_held_out_rows_and_edges(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op3_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    right, found = [], []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and r.doc_id in labels:
            right.append(r.predicted == labels[r.doc_id])
            if labels[r.doc_id]:
                found.append(r.predicted)
    assert np.mean(right) > 0.97 and np.mean(found) > 0.85
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "x " * 90_000, 1), (2, "idiot", 1)], "doc_id long, text string, SCORE int")
    model = toxicity.Model(-1.0, {next(iter(toxicity.word_buckets({"idiot"}))): 5.0})
    got = toxicity.scored(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    assert sorted(r.predicted for r in got.collect()) == [0, 0, 0, 1]
    assert toxicity.scored(docs.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 < toxicity.fit(docs, none).score("anything") <= 0.5


def test_repeated_ids_fit_the_same_model_in_any_order(spark):
    rows = [(i, f"{'idiot' if i % 2 else 'friend'} number {n} of {i}") for i in range(60) for n in range(6)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    fits = [
        toxicity.fit(spark.createDataFrame(some, "doc_id long, text string").repartition(parts), labels)
        for some, parts in ((rows, 1), (rows[::-1] + rows, 7))
    ]
    for text in ("idiot", "friend number 3", ""):
        assert fits[0].score(text) == fits[1].score(text)
