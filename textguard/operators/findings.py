"""Findings and counts over a table of texts.

Rules are columns here, not a joined table: each text is read once, the counts of all rules
stand side by side, and rows are only made for what was found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions import egress, inbound
from textguard.sources.rules import DLP, INJECTION, Rule


def findings(
    frame: DataFrame, key: str, text: str, rules: Sequence[Rule] = INJECTION + DLP
) -> DataFrame:
    """One row per text and rule that matched: ``key``, ``kind``, ``rule_id``, ``matches``."""
    counts = egress.match_counts(text, rules)
    kinds = {r.rule_id: r.kind for r in rules}
    counted = frame.select(key, *(n.alias(f"_n_{i}") for i, n in counts.items()))
    found = egress.kept({i: F.col(f"_n_{i}") for i in counts}, kind=kinds)
    return counted.select(key, F.inline(found)).withColumnRenamed("type", "rule_id")


def rule_monitor(
    frame: DataFrame, text: str, rules: Sequence[Rule] = INJECTION + DLP, by: Sequence[str] = ()
) -> DataFrame:
    """Hits and texts hit per rule, also for rules that never matched.

    One aggregation carries all rules at once and is combined before the shuffle; the rules
    become rows only after it.
    """
    counts = egress.match_counts(text, rules)
    kinds = {r.rule_id: r.kind for r in rules}
    counted = frame.select(*by, *(n.alias(f"n_{i}") for i, n in counts.items()))
    totals = counted.groupBy(*by).agg(
        *(F.coalesce(F.sum(f"n_{i}"), F.lit(0)).alias(f"hits_{i}") for i in counts),
        *(F.count_if(F.col(f"n_{i}") > 0).alias(f"texts_{i}") for i in counts),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(kinds[i]).alias("kind"),
                F.lit(i).alias("rule_id"),
                F.col(f"hits_{i}").alias("hits"),
                F.col(f"texts_{i}").alias("texts_hit"),
            )
            for i in counts
        )
    )
    return totals.select(*by, F.inline(rows))


def overview(
    frame: DataFrame,
    inbound_text: str,
    outbound_text: str,
    rules: Sequence[Rule] | None = None,
    dlp_rules: Sequence[Rule] = DLP,
    by: Sequence[str] = (),
) -> DataFrame:
    """Requests seen, injections blocked and leak events, overall or per group."""
    return frame.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.count_if(inbound.hit(inbound_text, rules)).alias("injections_blocked"),
        F.count_if(egress.leaks(outbound_text, dlp_rules)).alias("dlp_events"),
    )
