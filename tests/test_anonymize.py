import random
import time

from pyspark.sql import functions as F

from tests import brute
from textguard.functions import anonymize

PARTS = ["/home/", "~/", "a", ".json", ".env", " ", "\t", "\x1d", "\xa0", "\xe9", "_", "b.json", "/",
         "\u2003", "\xb2", "\u0301", "!", "x.env", "\n"]


def test_known_queries(spark):
    queries = [
        "why does ~/notes/draft.md crash with app.json on my machine",
        ".env", "", " \t",
    ]
    rows = spark.createDataFrame([(q,) for q in queries], "q string").select(
        anonymize.secured_query("q")
    ).collect()
    assert [r[0] for r in rows] == [
        "why does  crash with  on my machine documentation context",
        ".env documentation context", " documentation context", " documentation context",
    ]


def test_same_as_plain_python(spark):
    rnd = random.Random(2)
    queries = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    rows = spark.createDataFrame([(q,) for q in queries], "q string").select(
        "q", anonymize.secured_query("q")
    ).collect()
    assert not [(q, s) for q, s in rows if s != brute.secured(q)]


def test_long_gap_stays_linear(spark):
    query = "a" + " " * 1_000_000 + "x" + "\t" * 100_000
    start = time.perf_counter()
    row = spark.createDataFrame([(query,)], "q string").select(
        F.length(anonymize.secured_query("q"))
    ).first()
    assert row[0] == 1_000_002 + len(" documentation context")
    assert time.perf_counter() - start < 20
