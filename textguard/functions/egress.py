"""Outbound leak detection: match counts per detector, the violations, the decision.

Three detectors backtrack badly on hostile text when used as written: one long row could
hold up a task for hours. Each has a form here that gives the same matches in time linear in
the text, so whole texts are scanned and no length limit is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import fixed
from textguard.functions.dialect import PREFIX, SPACE, to_java
from textguard.functions.inbound import rule_hits
from textguard.sources.rules import DLP, Rule

# A key word can only begin with one of these letters; testing that first is cheaper.
_KEY = PREFIX + "(?=[sSpPkKtT\u017f\u212a])" + to_java(fixed.API_KEY).removeprefix(PREFIX)

# Only the first cloud prefix of a run of [A-Z_] can begin a match: a later one needs the
# same '=' behind the same run. The atomic group settles on it, so a run is read once.
_ENV_STARTS = ("AWS_", "AZURE_", "STRIPE_", "GITHUB_")
_ENV = (
    f"{PREFIX}(?<![A-Z_])(?>[A-Z_]*?(?:{'|'.join(_ENV_STARTS)}))[A-Z_]++=[^{SPACE}]+"
)

# A host match takes the last listed domain of its run, so it only ever begins a run.
_DNS_ENDS = (".canarytokens.com", ".burpcollaborator.net", ".interactsh.com")
_DNS = f"{PREFIX}(?<![a-zA-Z0-9.-]){fixed.DNS_EXFILTRATION}"

# A pixel is an image start and then, on the same line, the first link that works: a run
# without whitespace that holds an image ending, and a ')' after it. The loop takes up what
# is no such link and never gives anything back: a run without an image ending whole, as no
# later link start of that run can do better, and the rest of the line where no ')' follows.
# An image start that nothing answers thus uses up its line, with an empty link.
_LINK = r"\]\((https?://"
_IMAGE = rf"(?>[^{SPACE})]+?\.(?:png|jpg|gif)\?)[^)\n]*+"
_NO_LINK = _LINK.replace("(https", "https")
_PIXEL = (
    rf"{PREFIX}(?i)\!\[(?:[^\]\n]++|\](?!\(https?://)"
    rf"|{_NO_LINK}(?!{_IMAGE})[^{SPACE})]*+|{_NO_LINK}{_IMAGE}(?!\)))*+"
    rf"(?:{_LINK}{_IMAGE})\))?+"
)


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _contains_any(text: Column, parts) -> Column:
    return reduce(or_, (F.contains(text, F.lit(p)) for p in parts))


def _may_hold_pixel(text: Column) -> Column:
    return F.contains(text, F.lit("![")) & F.contains(text, F.lit("]("))


def pixel_urls(text: Column | str) -> Column:
    """The link of every tracking-pixel image, in text order."""
    text = _column(text)
    found = F.array_remove(F.regexp_extract_all(text, F.lit(_PIXEL), F.lit(1)), "")
    return F.when(_may_hold_pixel(text), found).otherwise(F.array().cast("array<string>"))


def _count(n: Column) -> Column:
    return F.coalesce(n, F.lit(0)).cast("bigint")


def _builtin(rule: Rule) -> bool:
    """Is this a detector as it came? One that was changed is used as it is written."""
    return any(rule.rule_id == r.rule_id and rule.pattern == r.pattern for r in DLP)


def match_counts(text: Column | str, rules: Sequence[Rule] = DLP) -> dict[str, Column]:
    """Non-overlapping matches of each enabled rule, by id in the given order.

    NULL text counts nothing.
    """
    text = _column(text)
    found = {
        "api_key": F.regexp_count(text, F.lit(_KEY)),
        "env_variable": F.when(
            _contains_any(text, _ENV_STARTS), F.regexp_count(text, F.lit(_ENV))
        ),
        "dns_exfiltration": F.when(
            _contains_any(text, _DNS_ENDS), F.regexp_count(text, F.lit(_DNS))
        ),
        "markdown_pixel": F.when(_may_hold_pixel(text), F.size(pixel_urls(text))),
    }
    return {
        r.rule_id: _count(found[r.rule_id]) if _builtin(r) else rule_hits(text, r)
        for r in rules
        if r.enabled
    }


def kept(counts: dict[str, Column], **more: dict[str, str]) -> Column:
    """``array<struct<type, matches>>`` of the counts above zero, in their order.

    ``more`` adds fields that depend on the type. The counts are named twice: pass columns.
    """
    names = "".join(f"{field}:string," for field in more)
    parts = [F.array().cast(f"array<struct<{names}type:string,matches:bigint>>")]
    for name, n in counts.items():
        fields = [F.lit(values[name]).alias(field) for field, values in more.items()]
        entry = F.array(F.struct(*fields, F.lit(name).alias("type"), n.alias("matches")))
        parts.append(F.when(n > 0, entry).otherwise(parts[0]))
    return F.concat(*parts)


def leaks(text: Column | str, rules: Sequence[Rule] = DLP) -> Column:
    """Does any enabled rule match? Cheap tests are made first and the first hit ends it."""
    text = _column(text)
    found = {
        "dns_exfiltration": _contains_any(text, _DNS_ENDS) & F.rlike(text, F.lit(_DNS)),
        "env_variable": _contains_any(text, _ENV_STARTS) & F.rlike(text, F.lit(_ENV)),
        "markdown_pixel": _may_hold_pixel(text) & (F.size(pixel_urls(text)) > 0),
        "api_key": F.rlike(text, F.lit(_KEY)),
    }
    builtin = {r.rule_id for r in rules if r.enabled and _builtin(r)}
    tests = [test for name, test in found.items() if name in builtin]
    tests += [
        F.rlike(text, F.lit(r.java)) for r in rules if r.enabled and not _builtin(r)
    ]
    return F.coalesce(reduce(or_, tests, F.lit(False)), F.lit(False))


def action(unsafe: Column) -> Column:
    return F.when(unsafe, F.lit(fixed.BLOCK)).otherwise(F.lit(fixed.ALLOW))


def with_dlp_report(
    frame: DataFrame,
    payload: str,
    rules: Sequence[Rule] = DLP,
    enabled: Column | None = None,
) -> DataFrame:
    """Add ``safe``, ``violations`` and ``action``, and ``is_null`` for a missing payload.

    Rows where ``enabled`` is false are let through unread.
    """
    counts = match_counts(payload, rules)
    if enabled is not None:
        counts = {k: F.when(enabled, n).otherwise(0) for k, n in counts.items()}
    # In steps, so that each count is made once.
    counted = frame.withColumns({f"_n_{k}": n for k, n in counts.items()})
    columns = {k: F.col(f"_n_{k}") for k in counts}
    unsafe = reduce(or_, (n > 0 for n in columns.values()), F.lit(False))
    return counted.select(
        *frame.columns,
        kept(columns).alias("violations"),
        (~unsafe).alias("safe"),
        action(unsafe).alias("action"),
        F.col(payload).isNull().alias("is_null"),
    )
