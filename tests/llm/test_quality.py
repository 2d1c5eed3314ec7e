"""Quality rules: counts against plain loops, the chain model, and labelled documents."""

import itertools
import random

import numpy as np

from textguard.llm import quality, queries


def plain(text):
    words = text.encode().split()
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, run in enumerate(runs):
        if runs.count(run) > 1:
            covered |= set(range(i, i + 8))
    lines = text.split("\n")
    copies = sum(bool(line.strip(" \t\n\v\f\r")) and line in lines[:i] for i, line in enumerate(lines))
    chars = sum(c not in " \t\n\v\f\r" for c in text)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), copies, len(covered)


def test_counts():
    rng = random.Random(1)
    texts = ["", " \n ", "a", "a b\na b\n\n\n", "\xa0x y z", "w " * 40, " ".join("abcdefghi"), " ".join("abcdefgh" * 2)]
    for n in (10, 30, 200):
        for _ in range(15):
            text = " ".join(rng.choice(["a", "é#", "the", "b|", "c\n"]) for _ in range(n))
            texts += [text, text + " " + text[: n // 2]]
    for text in texts:
        found = quality.verdict(text, quality.Crf())
        assert found[:5] == plain(text), text
        n, _, _, _, repeated = found[:5]
        assert found[6] == (n < 20 or 100 * repeated > 30 * n)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 8):
        model = quality.Crf(rng.standard_normal((2, len(quality.FEATURES))), rng.standard_normal((2, 2)), rng.standard_normal(2))
        lines = rng.standard_normal((n, len(quality.FEATURES)))
        scores = lines @ model.emit.T

        def total(path):
            steps = sum(model.step[a, b] for a, b in zip(path, path[1:]))
            return model.start[path[0]] + steps + sum(scores[i, k] for i, k in enumerate(path))

        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert tuple(model.viterbi(lines)) == best
    assert quality.Crf().viterbi(np.zeros((0, len(quality.FEATURES)))) == []


def test_training_tells_lines_apart():
    rng = np.random.default_rng(2)
    documents = []
    for i in range(200):
        label = i % 2
        x = rng.standard_normal((rng.integers(1, 90), len(quality.FEATURES)))
        x[:, 4] += 3 * label - 1.5
        documents.append((x, label))
    model = quality.train(documents)
    right = [np.mean(np.array(model.viterbi(x)) == y) for x, y in documents]
    assert np.mean(right) > 0.98
    assert quality.train([(x, 1) for x, _ in documents]).viterbi(documents[0][0]) == [1] * len(documents[0][0])


def test_lines_of_mixed_texts(spark):
    """Texts glued from held-out documents of both labels are told apart line by line."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("quality IN (0, 1)")
    rows = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id").orderBy("doc_id").collect()
    known = [(quality.line_features((r.text or "").split("\n")), r.quality) for r in rows]
    model = quality.train(known[::2])
    some = [[x for x, label in known[1::2] if label == which and 3 <= len(x) < 60] for which in (0, 1)]
    assert min(map(len, some)) > 10
    rng, right, one = random.Random(3), [], 0
    for i in range(200):
        order = [(0, 1), (1, 0), (1, 0, 1)][i % 3]
        parts = [(rng.choice(some[label]), label) for label in order]
        truth = np.concatenate([np.full(len(x), label) for x, label in parts])
        found = np.array(model.viterbi(np.concatenate([x for x, _ in parts])))
        right.append((found == truth).mean())
        one += len(set(found)) == 1
    assert np.mean(right) > 0.93 and one < 20


def test_glued_chains():
    rows = lambda n, v: np.full((n, len(quality.FEATURES)), float(v))
    chains = quality.glued([(rows(3, 1), 0), (rows(50, 2), 1), (rows(2, 3), 1), (rows(0, 9), 1)])
    assert [y.tolist() for _, y in chains] == [[1] * 21 + [0] * 3 + [1] * 2, [0] * 3 + [1] * 21 + [0] * 3]
    assert all(len(x) == len(y) <= quality.CHAIN for x, y in chains)
    assert quality.glued([(rows(3, 1), 0)]) == [] == quality.glued([(rows(0, 1), 0), (rows(3, 1), 1)])


def test_whole_table_and_edges(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op7_quality(spark, folder).collect()}
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        if len(docs[i]) < 4000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(docs[i])
        assert not (r.kept and r.base_failed)
    known = [(r.kept, labels[i]) for i, r in rows.items() if i in labels and not r.base_failed]
    assert np.mean([k == bool(y) for k, y in known]) > 0.98
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "word " * 70_000, "x")], "doc_id long, text string, KEPT string")
    assert quality.judged(odd, quality.Crf()).filter("kept").count() == 0
    assert quality.keep(odd, quality.Crf()).columns == ["doc_id", "text", "KEPT"]
    text = " ".join(map(str, range(30)))
    clash = spark.createDataFrame([("b", text, 7, "a"), ("b", text, 7, "a")], "__1 string, text string, __0 int, n_words string")
    assert [tuple(r) for r in quality.keep(clash, quality.Crf()).collect()] == [("b", text, 7, "a")] * 2
    assert quality.judged(odd.limit(0), quality.Crf()).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(odd, none).viterbi(quality.line_features(["a"])) == [1]


def test_repeated_ids_fit_the_same_model_in_any_order(spark):
    rows = [
        (i, f"good words number {n} of {i}\n[menu] [{n}] {'#' * (n + i)}") for i in range(40) for n in range(6)
    ]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fits = [
        quality.fit(spark.createDataFrame(some, "doc_id long, text string").repartition(parts), labels)
        for some, parts in ((rows, 1), (rows[::-1] + rows, 7))
    ]
    lines = quality.line_features(["good words number 3", "[menu] [3] ####", ""])
    assert all(np.array_equal(a, b) for a, b in zip(vars(fits[0]).values(), vars(fits[1]).values()))
    assert fits[0].viterbi(lines) == fits[1].viterbi(lines)
    many = spark.createDataFrame([(0, "a\n" * 40_000), (1, "b c\n" * quality.SAMPLE_LINES)], "doc_id long, text string")
    assert quality.fit(many, labels).viterbi(lines) == [1, 1, 1]  # as with no documents at all
