"""Rules as data: the built-in catalogue, user rules, switches, and a check before the job."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import fixed
from textguard.functions.dialect import to_java

RULES_SCHEMA = (
    "rule_id string, ord int, kind string, module string, pattern string, enabled boolean"
)


@dataclass(frozen=True)
class Rule:
    """One pattern. ``words`` are lower-case words every match contains, the first at its start."""

    rule_id: str
    ord: int
    kind: str
    module: str
    pattern: str
    enabled: bool = True
    words: tuple[str, ...] = ()

    @cached_property
    def java(self) -> str:
        return to_java(self.pattern)


INJECTION = (
    Rule("ignore_previous", 1, "injection", "indirect_injection", fixed.IGNORE_PREVIOUS,
         words=("ignore", "previous", "instructions")),
    Rule("system_override", 2, "injection", "indirect_injection", fixed.SYSTEM_OVERRIDE,
         words=("system", "override")),
    Rule("delete_files", 3, "injection", "destructive_commands", fixed.DELETE_FILES,
         words=("delete", "files")),
    Rule("persona_override", 4, "injection", "jailbreaks", fixed.PERSONA_OVERRIDE,
         words=("you", "are", "now", "agent")),
    Rule("respond_only", 5, "injection", "indirect_injection", fixed.RESPOND_ONLY,
         words=("respond", "only")),
    Rule("sudo_rm", 6, "injection", "destructive_commands", fixed.SUDO_RM,
         words=("sudo", "rm", "-rf")),
)
DLP = (
    Rule("api_key", 1, "dlp", "pii_leak_prevention", fixed.API_KEY),
    Rule("env_variable", 2, "dlp", "pii_leak_prevention", fixed.ENV_VARIABLE),
    Rule("dns_exfiltration", 3, "dlp", "pii_leak_prevention", fixed.DNS_EXFILTRATION),
    Rule("markdown_pixel", 4, "dlp", "pii_leak_prevention", fixed.MARKDOWN_PIXEL),
)


def injection_rules(rules: Sequence[Rule] | None = None) -> tuple[Rule, ...]:
    """The enabled rules in order. None or an empty list stands for the built-in ones.

    Rules that are all switched off are a choice, not an empty list: the result is empty
    only where the caller passed rules and disabled each of them.
    """
    return tuple(sorted((r for r in (rules or INJECTION) if r.enabled), key=lambda r: r.ord))


def custom_rules(patterns: Iterable[str], module: str = "custom") -> tuple[Rule, ...]:
    """User patterns as rules. They take the place of the built-in rules."""
    return tuple(
        Rule(f"custom_{i}", i, "injection", module, p) for i, p in enumerate(patterns, 1)
    )


def blocklist_rules(phrases: Iterable[str], after: Sequence[Rule] = INJECTION) -> tuple[Rule, ...]:
    """``after`` followed by one literal rule per phrase."""
    start = max((r.ord for r in after), default=0)
    kept = [p for p in phrases if p]
    return tuple(after) + tuple(
        Rule(f"blocked_{i}", start + i, "injection", "blocklist", re.escape(p))
        for i, p in enumerate(kept, 1)
    )


def toggle(rules: Sequence[Rule], **enabled: bool) -> tuple[Rule, ...]:
    """Switch rules on or off by id."""
    unknown = set(enabled) - {r.rule_id for r in rules}
    if unknown:
        raise KeyError(f"no such rule: {sorted(unknown)}")
    return tuple(replace(r, enabled=enabled.get(r.rule_id, r.enabled)) for r in rules)


def check_rules(spark: SparkSession, rules: Sequence[Rule]) -> None:
    """Compile every pattern before the job and refuse those that match the empty string.

    One query asks all of them; only if it fails is each asked alone, to name the bad one.
    """

    def empties(some: Sequence[Rule]) -> list[bool]:
        asked = F.array(*(F.rlike(F.lit(""), F.lit(r.java)) for r in some))
        return spark.range(1).select(asked).first()[0]

    if not rules:
        return
    try:
        found = empties(rules)
    except Exception:
        for rule in rules:
            try:
                empties([rule])
            except Exception as error:
                raise ValueError(f"rule {rule.rule_id}: {rule.pattern!r} does not compile") from error
        raise
    for rule, empty in zip(rules, found):
        if empty:
            raise ValueError(f"rule {rule.rule_id}: {rule.pattern!r} matches the empty string")


def rules_frame(spark: SparkSession, rules: Sequence[Rule] = INJECTION + DLP) -> DataFrame:
    """The catalogue as a DataFrame, to store it or to edit it in SQL."""
    return spark.createDataFrame(
        [(r.rule_id, r.ord, r.kind, r.module, r.pattern, r.enabled) for r in rules], RULES_SCHEMA
    )


def rules_from_frame(frame: DataFrame, kind: str = "injection") -> tuple[Rule, ...]:
    """Rules from a rules table. A catalogue holds patterns, not data, so it is read whole."""
    known = {(r.rule_id, r.pattern): r.words for r in INJECTION + DLP}
    rows = frame.filter(F.col("kind") == kind).select(*RULES_SCHEMA.replace(",", "").split()[::2])
    found = [
        Rule(r.rule_id, r.ord, r.kind, r.module, r.pattern, r.enabled,
             known.get((r.rule_id, r.pattern), ()))
        for r in rows.collect()
    ]
    return tuple(sorted(found, key=lambda r: (r.ord, r.rule_id)))
