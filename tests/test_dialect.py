import random
import re

import pytest
from pyspark.sql import functions as F

from textguard.functions.dialect import to_java

PATTERNS = (
    r"a\s+b", r"\S+", r"[^\s)]+", r"\w+\.x", r"\bkey\b", r"\Bkey", r"[\w.-]+@", r"(?i)[a-z]+k",
    r"[[]x", r"[]a]+", r"[^]a]+", r"a&&b", r"[a&&b]", r"x.y", r"(?P<n>ab)(?P=n)", r"end\Z",
    r"\W", r"\d+", r"(?s)a.b", r"[\]\[]",
)
PARTS = ["a", "b", " ", "\x1d", "\xa0", "\u0085", "\xe9", "\xb2", "\u0301", "key", ".x", "@", "[", "]",
         "&", "&&", "x", "y", "\r", "\n", "\u2028", "ab", "end", "\u212a", "\u017f", "-", "\u0663", "_", ")"]


def test_matches_are_those_of_python(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 9))) for _ in range(4000)]
    columns = [
        F.regexp_replace("t", F.lit(to_java(p)), F.lit("#")).alias(str(i))
        for i, p in enumerate(PATTERNS)
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *columns).collect()
    for i, p in enumerate(PATTERNS):
        wrong = [(r.t, r[i + 1]) for r in rows if re.sub(p, "#", r.t) != r[i + 1]]
        assert not wrong, (p, to_java(p), wrong[:3])


def test_negated_escape_in_a_class_is_refused():
    with pytest.raises(ValueError):
        to_java(r"[a\S]")
