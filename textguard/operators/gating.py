"""Protection settings applied row by row: switches, modules, block lists."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import fixed, inbound
from textguard.functions.dialect import to_java
from textguard.session import ship_package, written
from textguard.sources.rules import INJECTION, Rule, custom_rules


def with_settings(frame: DataFrame, settings: DataFrame, profile_id: str) -> DataFrame:
    """Join each row's settings (from ``with_defaults``); rows of no known profile get the defaults.

    Spark sends few settings to the rows; where there are many it splits a profile that most rows
    share, which a left join allows.
    """
    renamed = settings.withColumnRenamed("profile_id", profile_id)
    joined = frame.join(renamed, profile_id, "left")
    return joined.withColumns(
        {
            "protected": F.coalesce("protected", F.lit(True)),
            "security_profile": F.coalesce("security_profile", F.lit(fixed.DEFAULT_PROFILE)),
            **{
                name: F.coalesce(name, F.lit(default))
                for name, default in fixed.MODULE_DEFAULTS.items()
            },
            "use_model": F.coalesce("use_model", F.lit(False)),
            "model_name": F.coalesce("model_name", F.lit(fixed.DEFAULT_MODEL)),
            "blocklist": F.coalesce("blocklist", F.array().cast("array<string>")),
        }
    )


def gated_sanitize(text: Column | str, rules: Sequence[Rule] = INJECTION) -> Column:
    """Sanitise by the settings columns that ``with_settings`` added.

    A switched-off module's matches are replaced by themselves (``$0``), which leaves each
    pattern a literal that is compiled once. With protection off the text is not touched.
    """
    text = F.col(text) if isinstance(text, str) else text
    off = F.lit("$0")

    def step(acc: Column, rule: Rule) -> Column:
        marker = F.lit(fixed.MARKER)
        if rule.module in fixed.MODULE_DEFAULTS:
            marker = F.when(F.col(rule.module), marker).otherwise(off)
        return F.regexp_replace(acc, F.lit(rule.java), marker)

    enabled = [r for r in rules if r.enabled]
    chain = reduce(step, enabled, text)
    guard = inbound.maybe_hit(text, enabled)
    ruled = chain if guard is None else F.when(guard, chain).otherwise(text)
    scrubbed = inbound.scrub(F.coalesce(ruled, F.lit("")), "blocklist")
    return F.when(F.col("protected"), scrubbed).otherwise(text)


#: Lists of patterns that become replacement chains of their own; more are joined to the rows.
CHAINS = 64


def sanitize_by_lists(
    frame: DataFrame, text: str, patterns: str, chains: int = CHAINS
) -> DataFrame:
    """Sanitise each row by the list of patterns in its ``patterns`` column.

    Lists hold patterns as users write them. Every different list is translated and compiled
    once before the job; a row whose list has a pattern that does not compile, or that matches
    the empty string, is treated by the built-in rules and says so in ``reason``. An empty or
    NULL list stands for the built-in rules. Few lists become literal chains, each compiled once;
    of many, the translation is joined to the rows. Both are checked in the same way.
    """
    spark = frame.sparkSession
    lists = frame.select(F.to_json(F.struct(patterns)).alias("_list"), F.col(patterns).alias("own"))
    lists = lists.filter(F.size("own") > 0).distinct()
    few = lists.limit(chains + 1).collect()
    key = F.to_json(F.struct(patterns))
    if len(few) > chains:
        known = _compiled(_translated(lists))
        joined = frame.withColumn("_list", key).join(known, "_list", "left")
        own = inbound.sanitize_with(text, "_java")
        return joined.withColumn(text, own).drop("_list", "_java")
    result, reason = inbound.sanitize(text), F.lit(None).cast("string")
    if few:
        made = spark.createDataFrame([(r["_list"], *_java(r["own"])) for r in few], _TRANSLATED)
        against = {r["_list"]: r["reason"] for r in _compiled(made).collect()}
        for r in few:
            same, bad = key == F.lit(r["_list"]), against[r["_list"]]
            if bad:
                reason = F.when(same, F.lit(bad)).otherwise(reason)
            else:
                result = F.when(same, inbound.sanitize(text, custom_rules(r["own"]))).otherwise(result)
    return frame.withColumns({text: result, "reason": reason})


_TRANSLATED = "_list string, _java array<string>, reason string"


def _java(own: list[str | None]) -> tuple[list[str] | None, str | None]:
    """A list of patterns for Spark, or the reason why it cannot be used."""
    try:
        if any(p is None for p in own):
            return None, "pattern missing"
        if any(re.search(p, "") for p in own):
            return None, "pattern matches the empty string"
        return [to_java(p) for p in own], None
    except (ValueError, OverflowError, RecursionError, re.error) as error:
        return None, f"pattern does not compile: {error}"


def _translated(lists: DataFrame) -> DataFrame:
    """``_list`` with ``_java``, its patterns for Spark, or a ``reason`` against it."""
    ship_package(lists.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [_java(list(own)) for own in batch["own"]]
            yield pd.DataFrame(
                {"_list": batch["_list"], "_java": [m[0] for m in made], "reason": [m[1] for m in made]}
            )

    return lists.mapInPandas(run, _TRANSLATED)


def _compiled(made: DataFrame) -> DataFrame:
    """The lists, with a ``reason`` also for those that Java refuses or that match the empty string there."""
    made = written(made, "translated-lists")
    each = made.select("_list", F.explode("_java").alias("p"))
    each = each.withColumn("fine", F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("p")).isNotNull())
    each = written(each, "compiled-patterns")
    empty = F.when(F.col("fine"), F.rlike(F.lit(""), F.col("p"))).otherwise(False)
    asked = each.groupBy("_list").agg(F.bool_and("fine").alias("_fine"), F.bool_or(empty).alias("_empty"))
    refused = (
        F.when(~F.col("_fine"), "pattern does not compile in Java")
        .when(F.col("_empty"), "pattern matches the empty string")
        .otherwise(F.col("reason"))
    )
    joined = made.join(asked, "_list", "left").withColumn("reason", refused)
    return joined.select("_list", F.when(F.col("reason").isNull(), F.col("_java")).alias("_java"), "reason")
