"""The pipeline: order, columns, and each stage's decisions."""

import re

import corpus_pipeline
from textguard.llm import mixing


def test_pipeline(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixing_sources", "tokens"]
    rows = {0: docs.collect()}
    frame = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        frame = corpus_pipeline.written(stage(spark, frame, folder), name)
        rows[i] = frame.collect()
        if i < 5:
            assert frame.columns == docs.columns
    good, one, clean, mix, ids = (rows[i] for i in range(1, 6))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert not any(labels.get(r.doc_id) == 0 for r in good)
    long = [r for r in rows[0] if labels.get(r.doc_id) == 1 and len(r.text.split()) >= 40]
    assert len({r.doc_id for r in long} - {r.doc_id for r in good}) <= 0.01 * len(long)
    assert len({r.text for r in one}) == len(one) < len(good)
    assert {r.text for r in one} <= {r.text for r in good}
    assert {r.doc_id for r in clean} == {r.doc_id for r in one}
    assert any(a.text != b.text for a, b in zip(sorted(one), sorted(clean)))
    assert not any(re.search(r"\b9807915762804490\b", r.text) for r in clean) and all(r.n_chars == len(r.text) for r in clean)
    assert {r.doc_id for r in mix} <= {r.doc_id for r in clean} and len(mix) != len(clean)
    assert len(ids) == len(mix) and all(r.lossless and r.n_tokens == len(r.ids) for r in ids)


def test_empty(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert mixing.MOST == 3


def test_nulls_repeats_and_clashing_names(spark):
    """Stages keep columns of any name as they are, and take null, empty, long and repeated texts."""
    folder = "/root/testdata/sf0.001"
    long = " ".join(f"word{i} of a long and plain text." for i in range(4000))
    texts = [None, "", " \n", "same text twice " * 9, "same text twice " * 9, long]
    texts += [f"A plain line of text, the number {i} of some, with words of its own like w{i} and v{i}, to be read and kept by all." for i in range(40)]
    rows = [(i if i != 7 else None, t, ("en", None)[i % 2], f"s{i % 3}" if i % 5 else None, 1, f"t{i}", float(i), "x") for i, t in enumerate(texts)]
    rows.append(rows[9])
    schema = "doc_id long, text string, lang string, source string, n_chars long, target string, Size double, copies string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.written(stage(spark, docs, folder), name)
        if name != "tokens":
            assert made.schema.simpleString() == docs.schema.simpleString(), name
        assert all(r.target == f"t{int(r.Size)}" and r.copies == "x" for r in made.collect()), name
        own = made.collect()
        if name == "near_duplicates":
            assert sum(r.text is not None and r.text.startswith("same") for r in own) == 1
            assert sum(not (r.text or "").split() for r in own) == 1
        if name == "personal_data":
            assert len(own) == len(rows)
        if name == "tokens":
            assert all(r.lossless and r.n_tokens == len(r.ids) for r in own)
