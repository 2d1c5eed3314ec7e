"""Inbound sanitising: an ordered chain of regex replacements over a text column.

Every function takes and returns a ``Column``, so the work stays inside Spark's generated
code. Almost all rows of a large corpus hold none of the phrases. A rule therefore carries
the words every match must contain, and a byte search for them on the lower-cased text
decides whether the regex chain runs on that row at all; the test can pass for a row that
has no match but never fails for a row that has one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import fixed
from textguard.functions.dialect import PREFIX, to_java
from textguard.sources.rules import Rule, injection_rules


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


# Non-ASCII letters that a case-insensitive regex takes for these, and lower() leaves alone.
_TWINS = {"i": "\u0131\u0130", "k": "\u212a", "s": "\u017f"}


def _needles(rule: Rule) -> list[str]:
    # Words are cut at letters that have such a twin; only the other pieces are searched.
    pieces = [p for w in rule.words for p in re.split("[sik]", w) if len(p) > 2]
    return list(dict.fromkeys(pieces))


def maybe_hit(text: Column | str, rules: Sequence[Rule], low: Column | None = None) -> Column | None:
    """False only where no rule can match; None when some rule gives nothing to search for."""
    needles = [_needles(r) for r in rules]
    if not all(needles):
        return None
    low = F.lower(_column(text)) if low is None else low
    return reduce(
        or_, (reduce(and_, (F.contains(low, F.lit(n)) for n in ns)) for ns in needles), F.lit(False)
    )


def _when_maybe(text: Column, rules: Sequence[Rule], low: Column | None, then: Column, other: Column):
    guard = maybe_hit(text, rules, low)
    return then if guard is None else F.when(guard, then).otherwise(other)


def sanitize(
    text: Column | str, rules: Sequence[Rule] | None = None, low: Column | None = None
) -> Column:
    """Replace all matches of each rule, in order, on the previous rule's output.

    NULL gives the empty string. ``low`` may pass in ``lower(text)`` where the caller
    already has it.
    """
    rules = injection_rules(rules)
    text = _column(text)
    chain = reduce(
        lambda acc, r: F.regexp_replace(acc, F.lit(r.java), F.lit(fixed.MARKER)), rules, text
    )
    return F.coalesce(_when_maybe(text, rules, low, chain, text), F.lit(""))


def sanitize_content(
    text: Column | str, rules: Sequence[Rule] | None = None, low: Column | None = None
) -> Column:
    """As ``sanitize``, but an empty or NULL content is handed through as it is."""
    text = _column(text)
    return F.when(F.length(text) > 0, sanitize(text, rules, low)).otherwise(text)


def sanitize_with(text: Column | str, patterns: Column | str) -> Column:
    """Sanitise with a pattern list held in the row; NULL or empty means the built-in rules.

    The list holds Java patterns (see ``dialect.to_java``) applied in array order.
    """
    text, patterns = _column(text), _column(patterns)
    own = F.aggregate(
        patterns,
        F.coalesce(text, F.lit("")),
        lambda acc, p: F.regexp_replace(acc, p, F.lit(fixed.MARKER)),
    )
    return F.when(F.size(patterns) > 0, own).otherwise(sanitize(text))


def scrub(text: Column | str, phrases: Column | str) -> Column:
    """Replace every occurrence of each phrase of a row's block list, taken literally."""
    return F.aggregate(
        F.coalesce(_column(phrases), F.array().cast("array<string>")),
        _column(text),
        lambda acc, p: F.coalesce(F.replace(acc, p, F.lit(fixed.MARKER)), acc),
    )


def flagged(text: Column | str) -> Column:
    """Does a sanitised text show a marker? Text that arrives with one counts too."""
    return F.coalesce(F.contains(_column(text), F.lit(fixed.MARKER_PREFIX)), F.lit(False))


def _any_of(rules: Sequence[Rule]) -> str | None:
    """One pattern that is found where any of the rules is; None where they cannot be joined."""
    patterns = [r.pattern for r in rules]
    if any(re.search(r"\\[1-9]|\(\?P", p) for p in patterns):
        return None  # group numbers and names belong to one pattern
    joined = to_java("|".join(f"(?:{p})" for p in patterns)).removeprefix(PREFIX)
    starts = [r.words[0][:3] if r.words else "" for r in rules]
    # Cheaper than trying every rule at every letter: can a rule begin with these letters?
    first = "".join(
        "[" + "".join(c + c.upper() + _TWINS.get(c, "") for c in sorted(set(letters))) + "]"
        for letters in zip(*starts)
    )
    return f"{PREFIX}(?={first})(?:{joined})" if first else f"{PREFIX}(?:{joined})"


def matched(text: Column | str, rules: Sequence[Rule] | None = None) -> Column:
    """Does any rule match the text as it arrived?

    The text is named once, so this is also right for a filter, where Spark does not share
    common subexpressions.
    """
    rules = injection_rules(rules)
    if not rules:
        return F.lit(False)
    text, pattern = _column(text), _any_of(rules)
    if pattern:
        found = F.rlike(text, F.lit(pattern))
    else:
        found = reduce(or_, (F.rlike(text, F.lit(r.java)) for r in rules))
    return F.coalesce(found, F.lit(False))


def hit(text: Column | str, rules: Sequence[Rule] | None = None) -> Column:
    """``flagged(sanitize(text))`` without running the replacement chain.

    The first rule to match sees the original text and the last one leaves its marker
    behind, so testing the rules against the original text gives the same answer. Filter on
    this: a filter on the replaced text would run the whole chain a second time.
    """
    return matched(text, rules) | flagged(text)


def rule_hits(text: Column | str, rule: Rule) -> Column:
    """Number of matches of one rule in the original text."""
    text = _column(text)
    n = F.regexp_count(text, F.lit(rule.java))
    return F.coalesce(_when_maybe(text, [rule], None, n, F.lit(0)), F.lit(0)).cast("bigint")


def open_for_model(sanitized: Column | str) -> Column:
    """Texts the second pass looks at: not empty and without the full marker."""
    sanitized = _column(sanitized)
    return (F.length(sanitized) > 0) & ~F.contains(sanitized, F.lit(fixed.MARKER))
