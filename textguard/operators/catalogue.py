"""Block lists and rule catalogues of thousands of entries, in one pass over each text.

One replacement or one column per entry costs a pass over the text each. Here an Aho-Corasick
automaton of the entries' words reads each text once, in Arrow batches, and names the few entries
that can match; Spark's own functions then do the exact work for those alone. The results are
those of the plain forms, ``inbound.scrub`` and ``findings.findings``.

The automaton is built once per task. A list is cut into lots of at most ``LOT`` letters, so that
no automaton grows with the list; every lot costs one more pass. What is named is handed back in
batches of at most ``GIVEN`` entries or so, however many texts came together. Workers need
``pyahocorasick``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from operator import itemgetter
from re import _parser as regex_parser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import egress, fixed, inbound
from textguard.session import ship_package
from textguard.sources.rules import DLP, Rule

#: Letters of the words of one automaton.
LOT = 4_000_000
#: Entries handed back at once; a text that names more is a batch of its own.
GIVEN = 20_000


def _lots(entries: Iterable, letters: Callable, lot: int) -> list[list]:
    """The entries in order, in lists of at most ``lot`` letters (one entry at least)."""
    lots, room = [], 0
    for entry in entries:
        if not lots or letters(entry) > room:
            lots.append([])
            room = lot
        lots[-1].append(entry)
        room -= letters(entry)
    return lots


def _finder(words: Iterable[str]) -> Callable[[str | None], set[int]]:
    """Which of the words, by number, does a text hold? Overlaps count."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    words = list(words)
    if not words:
        return lambda text: set()
    for number, word in enumerate(words):
        automaton.add_word(word, number)
    automaton.make_automaton()
    return lambda text: set(map(itemgetter(1), automaton.iter(text))) if text else set()


def _held(
    spark: SparkSession, text: Column, words: Sequence[str], entries: Sequence[tuple], kind: str,
    pick: Callable[[set[int]], Iterable[int]], view: Callable[[str], str] = str,
) -> Column:
    """The entries that ``pick`` names by the words a text holds, as an array of ``kind``.

    ``view`` makes of a text what is searched. Words and entries go to each executor once, in a
    broadcast of at most ``LOT`` letters or so.
    """
    shared = spark.sparkContext.broadcast((list(words), list(entries)))

    @F.pandas_udf(f"array<{kind}>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, entries = shared.value
        found = _finder(words)
        for texts in batches:
            rows, given = [], 0
            for t in texts:
                named = [entries[i] for i in sorted(pick(found(t and view(t))))]
                if rows and given + len(named) > GIVEN:
                    yield pd.Series(rows, dtype=object)
                    rows, given = [], 0
                rows.append(named)
                given += len(named)
            if rows:
                yield pd.Series(rows, dtype=object)

    return held(text)


def _beside(frame: DataFrame, columns: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """The frame with working columns whose names it does not have, in any letter case."""
    taken = {c.lower() for c in frame.columns}
    names = [f"__held_{n}" for n in range(len(columns) + len(taken)) if f"__held_{n}" not in taken]
    names = names[: len(columns)]
    return frame.withColumns(dict(zip(names, columns))), names


# --- phrases --------------------------------------------------------------------------------

_AT = "struct<at:int,phrase:string>"


def scrub_phrases(frame: DataFrame, text: str, phrases: Sequence[str], lot: int = LOT) -> DataFrame:
    """Replace every occurrence of each phrase in ``text``, phrase by phrase in their order.

    Equal to ``inbound.scrub`` with the whole list on every row. The first phrase to change a text
    is one that the text holds as it came. From then on a phrase may also be found where a marker
    stands: it is then a part of the marker or has one of the marker's two end letters, since
    wherever a piece of a marker meets a text or another piece there is such a letter. Those
    phrases are tried on every text that holds any phrase, the others only where they are held.

    NULL stays NULL. Empty and NULL phrases are passed over; without phrases the frame is as it
    was. Other columns are kept whatever their names.
    """
    listed = [p for p in phrases if p]
    if not listed:
        return frame
    spark = frame.sparkSession
    ship_package(spark)
    ends = {fixed.MARKER[0], fixed.MARKER[-1]}
    meets = [(i, p) for i, p in enumerate(listed) if p in fixed.MARKER or ends & set(p)]
    first: dict[str, int] = {}
    for i, p in enumerate(listed):
        first.setdefault(p, i)
    lots = _lots(first, len, lot)
    frame_with, names = _beside(
        frame,
        [
            _held(spark, F.col(text), part, [(first[p], p) for p in part], _AT, lambda found: found)
            for part in lots
        ],
    )
    always = F.from_json(F.lit(json.dumps([{"at": i, "phrase": p} for i, p in meets])), f"array<{_AT}>")
    held = F.concat(*names)
    ordered = F.array_sort(F.array_union(held, always))
    scrubbed = inbound.scrub(text, F.transform(ordered, lambda e: e["phrase"]))
    changed = F.when(F.size(held) > 0, scrubbed).otherwise(F.col(text))
    return frame_with.withColumn(text, changed).drop(*names)


def sanitize_phrases(
    frame: DataFrame, text: str, phrases: Sequence[str], rules: Sequence[Rule] | None = None
) -> DataFrame:
    """The ordered rules, then the block list: as ``sanitize`` with ``rules.blocklist_rules``."""
    return scrub_phrases(frame.withColumn(text, inbound.sanitize(text, rules)), text, phrases)


# --- rules ----------------------------------------------------------------------------------

_RULE = "struct<kind:string,rule_id:string,java:string>"


def _runs(pattern: str, gaps: bool) -> tuple[str, ...]:
    """Runs of lower-case ASCII letters that every match of the pattern holds; maybe none.

    Only what stands outside alternatives, classes, options and assertions counts. With ``gaps``
    one or more characters that are surely no part of a word stand for a blank in a run.
    """
    words, run = [], []

    def close() -> None:
        words.append("".join(run))
        run.clear()

    def is_gap(items: Iterable) -> bool:
        """Is what the items match always one character that is no part of a word?"""
        kinds = [(str(op), arg) for op, arg in items]
        if len(kinds) == 1 and kinds[0][0] == "IN":
            kinds = [(str(op), arg) for op, arg in kinds[0][1]]
        elif len(kinds) != 1:
            return False
        return all(
            (name == "LITERAL" and arg < 128 and not chr(arg).isalnum())
            or (name == "CATEGORY" and str(arg) == "CATEGORY_SPACE")
            for name, arg in kinds
        )

    def walk(items: Iterable) -> None:
        for op, arg in items:
            name = str(op)
            if gaps and is_gap([(op, arg)]):
                run.append(" ")
            elif name == "LITERAL" and arg < 128:
                run.append(chr(arg).lower())
            elif name == "SUBPATTERN":
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                if gaps and is_gap(arg[2]):
                    run.append(" ")
                    continue
                close()
                walk(arg[2])
                close()
            elif name != "AT":  # a place has no letters and parts none
                close()

    walk(regex_parser.parse(pattern))
    close()
    return tuple(dict.fromkeys(w for w in words if w))


def required_words(pattern: str) -> tuple[str, ...]:
    """Lower-case runs of ASCII letters that every match of the pattern holds; maybe none.

    Only what stands outside alternatives, classes, options and assertions counts.
    """
    return _runs(pattern, False)


def _seen(text: str) -> str:
    """A text as rules are looked up in it: lower-case, a blank for all that parts two words.

    The non-ASCII letters that a case-insensitive match takes for an ASCII one become that one.
    """
    low = text.replace("\u0130", "i").lower().replace("\u0131", "i").replace("\u017f", "s")
    return re.sub(r"[\W_]+", " ", low)


def _indexed(rule: Rule) -> list[str]:
    """What ``_seen`` shows of every text that the rule matches, the longer the better; maybe none.

    Words that a pattern parts by blanks or signs are one piece, so a rule of common words, or of
    words of a letter or two, is named by texts that hold them side by side alone.
    """
    runs = (*_runs(rule.pattern, True), *rule.words)
    return list(dict.fromkeys(w for w in map(_seen, runs) if w.strip()))


def findings(
    frame: DataFrame, key: str, text: str, rules: Sequence[Rule], lot: int = LOT
) -> DataFrame:
    """As ``findings.findings``, for catalogues of thousands of rules.

    A rule is indexed by the longest words in a row that all its matches hold; a text names its
    rules by what it holds, a rule stays if the text holds the others too, and only those are
    matched. A rule whose matches need no word is matched on every text. The built-in leak detectors, which
    have forms of their own, are columns as before. NULL and empty texts find nothing. Rows come
    in no order.
    """
    spark = frame.sparkSession
    ship_package(spark)
    enabled = [r for r in rules if r.enabled]
    builtin = {(r.rule_id, r.pattern) for r in DLP}
    own = [(r.rule_id, r.pattern) in builtin for r in enabled]
    counts = egress.match_counts(text, [r for r, b in zip(enabled, own) if b])
    indexed = [(r, _indexed(r)) for r, b in zip(enabled, own) if not b]
    columns = list(counts.values())
    for part in _lots(indexed, lambda e: sum(map(len, e[1])) + len(e[0].java), lot):
        columns.append(_candidates(spark, F.col(text), part))
    narrow = frame.select(key, text)
    held, names = _beside(narrow, columns)
    kinds = {r.rule_id: r.kind for r in enabled}
    found = [egress.kept({i: F.col(n) for i, n in zip(counts, names)}, kind=kinds)]
    for name in names[len(counts) :]:
        counted = F.transform(
            name,
            lambda c: F.struct(
                c["kind"].alias("kind"),
                c["rule_id"].alias("type"),
                F.regexp_count(F.col(text), c["java"]).cast("bigint").alias("matches"),
            ),
        )
        found.append(F.filter(counted, lambda c: c["matches"] > 0))
    listed = held.select(key, F.inline(F.concat(*found)))
    return listed.withColumnRenamed("type", "rule_id")


def _candidates(spark: SparkSession, text: Column, part: Sequence[tuple[Rule, list[str]]]) -> Column:
    numbers: dict[str, int] = {}
    by_word: dict[int | None, list[tuple[int, frozenset[int]]]] = {}
    for i, (_, needles) in enumerate(part):
        ids = [numbers.setdefault(n, len(numbers)) for n in needles]
        longest = max(zip(map(len, needles), ids), default=(0, None))[1]
        by_word.setdefault(longest, []).append((i, frozenset(ids)))

    def pick(found: set[int]) -> Iterator[int]:
        return (i for w in (None, *found) for i, ids in by_word.get(w, ()) if ids <= found)

    entries = [(r.kind, r.rule_id, r.java) for r, _ in part]
    return _held(spark, text, list(numbers), entries, _RULE, pick, _seen)
