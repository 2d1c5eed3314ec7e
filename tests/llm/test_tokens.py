"""BPE and token counts against the libraries they must agree with."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textguard.llm import bpe, queries, splitting, token_count
from textguard.llm.merging import RankQueue

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = "aabcde  the ing\n\t'sé中😀.!?123\x85\xa0 "
    made = ["".join(rng.choices(letters, k=k)) for k in (1, 2, 7, 60, 900) for _ in range(60)]
    made += ["".join(rng.choices("abcdehilnorst", k=k)) for k in (5, 80, 20000)]
    made += [s * k for s in ("a", "ab", "=-", " ", "\n", "é", "😀") for k in (1, 2, 3, 17, 400)]
    made += ["", "x<|endoftext|>y <|endoftext|>", "it's we'll I'VE", "՘࢏ a\U000323b0b 1\U00012550"]
    return made


def test_every_character(library):
    encoder = bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    points = [c for c in range(0x34000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 23):
        text = "".join(f"a{c}b {c}{c} 1{c}2  {c} " for c in map(chr, points[at : at + 23]))
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_encode_and_count_as_the_libraries(library, texts):
    encoder = bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    decoder = bpe.Decoder(open(RANKS, "rb").read())
    data = open(FILE, "rb").read()
    counter = token_count.Counter(data, token_count.prove_whole(data))
    other = Tokenizer.from_file(FILE)
    counts = counter.count(texts)
    for text, ids, count in zip(texts, encoder.encode(texts), counts, strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert decoder.decode(ids) == text.encode()
        assert count == len(other.encode(text, add_special_tokens=False).ids)


def test_whole_tokens_are_proven():
    data = open(FILE, "rb").read()
    library = Tokenizer.from_file(FILE)
    whole = token_count.prove_whole(data)
    assert len(whole) > 40_000
    for word in random.Random(1).sample(sorted(whole), 3000):
        # A vocabulary string alone may still be several pre-tokens; only single ones are asked.
        if len(splitting.Splitter(token_count.PATTERN)(word)) == 1:
            assert len(library.encode(word, add_special_tokens=False).ids) == 1


def test_latin_pattern_agrees(texts):
    import regex

    both = splitting.Splitter(public_tokenizers.PATTERN)
    plain = regex.compile(public_tokenizers.PATTERN)
    for text in texts[:200]:
        assert both(text) == plain.findall(text)
    assert splitting.latin_pattern(r"\w+") is None


def test_rank_queue():
    queue, waiting = RankQueue(70_000), {}
    rng = random.Random(3)
    for i in range(500):
        rank = rng.choice((rng.randrange(70_000), rng.randrange(100)))
        queue.push(rank, np.array([i]))
        waiting.setdefault(rank, []).append(i)
        if i % 7 == 0:
            rank, at = queue.pop()
            assert rank == min(waiting) and at.tolist() == waiting.pop(rank)
    ranks = []
    while entry := queue.pop():
        ranks.append(entry[0])
    assert ranks == sorted(waiting)


def test_frames(spark, library):
    rows = [(1, "a b", "x"), (None, None, None), (3, "", "y"), (1, "a b", "x"), (4, "word " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    checked = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, lossless="ok")
    assert checked.columns == ["doc_id", "text", "ids", "ok"] and checked.filter("NOT ok").isEmpty()
    encoded = bpe.decode(checked.drop("ok"), RANKS)
    assert encoded.columns == ["doc_id", "text", "ids", "decoded"]
    for row in encoded.collect():
        assert row.ids == library.encode_ordinary(row.text or "")
        assert row.decoded == (row.text or "").encode()
    counted = token_count.with_limit(token_count.count_tokens(docs, FILE), 512)
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in counted.orderBy("n_bytes").collect()][:2] == [(0, 0, False)] * 2
    empty = docs.limit(0)
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_count.count_tokens(empty, FILE).count() == 0


def test_whole_table(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op1_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = np.array(library.encode_ordinary(texts[row.doc_id]), "<u4")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    other = Tokenizer.from_file(FILE)
    for row in queries.op8_token_counts(spark, folder).collect():
        text = texts[row.doc_id]
        n = len(other.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 512)
    assert queries.op1_bpe(spark, folder).filter(F.col("n_tokens") < 0).count() == 0
