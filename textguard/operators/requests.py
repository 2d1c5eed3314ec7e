"""Request-level results.

A request that comes as one row with its items in an array is answered inside that row. When
items come as rows of their own, a request may be of any size: its flag is an aggregate that
is combined before the shuffle, and its items are put back together in pages of a fixed
number of items, so that no task ever holds a whole request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import egress, fixed, inbound, model
from textguard.operators.gating import gated_sanitize
from textguard.operators.second_pass import condemned, parted, text_hash
from textguard.session import written
from textguard.sources.rules import DLP, Rule


def sanitize_items(
    items: Column | str, rules: Sequence[Rule] | None = None, search: bool = False
) -> Column:
    """Sanitise the content of each item of an array; title and url are handed through.

    ``search`` keeps an empty or missing content as it is instead of making it ''.
    """
    items = F.col(items) if isinstance(items, str) else items
    clean = inbound.sanitize_content if search else inbound.sanitize
    # The lower-cased content is made in a step of its own, to be made once per item.
    lowered = F.transform(
        items, lambda i: F.struct(i.alias("item"), F.lower(i["content"]).alias("low"))
    )
    return F.transform(
        lowered,
        lambda x: F.struct(
            x["item"]["title"].alias("title"),
            clean(x["item"]["content"], rules, x["low"]).alias("content"),
            x["item"]["url"].alias("url"),
        ),
    )


def gated_items(items: Column | str, rules: Sequence[Rule], search: bool = False) -> Column:
    """Sanitise the content of each item by the row's own settings (from ``with_settings``).

    ``search`` keeps an empty or missing content as it is.
    """

    def content(text: Column) -> Column:
        clean = gated_sanitize(text, rules)
        return F.when(F.length(text) > 0, clean).otherwise(text) if search else clean

    return F.transform(
        items,
        lambda i: F.struct(
            i["title"].alias("title"), content(i["content"]).alias("content"), i["url"].alias("url")
        ),
    )


def any_flagged(items: Column | str) -> Column:
    """Is any (sanitised) item flagged? False for a request without items."""
    items = F.col(items) if isinstance(items, str) else items
    return F.coalesce(F.exists(items, lambda i: inbound.flagged(i["content"])), F.lit(False))


def with_request_report(requests: DataFrame, items: str = "results") -> DataFrame:
    """``status`` and ``threat_intercepted`` beside the sanitised items of each request."""
    return requests.withColumns(
        {"status": F.lit(fixed.PROCESSED), "threat_intercepted": any_flagged(items)}
    )


def asked_items(
    requests: DataFrame,
    items: str = "results",
    enabled: Column | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """Requests of sanitised items, written with a number for each and their items' hashes.

    Numbers tell requests apart, so repeated or NULL ids do no harm, and what made the items runs
    once. An item that no model is asked about has no hash; ``enabled`` says which requests a
    model is asked about, ``model_name`` names the column with its name where they differ.
    """

    def hashed(item: Column) -> Column:
        whole = item["content"]
        if model_name:
            whole = F.concat(F.coalesce(F.col(model_name), F.lit("")), F.lit("\0"), whole)
        return F.when(inbound.open_for_model(item["content"]), text_hash(whole))

    hashes = F.transform(items, hashed)
    if enabled is not None:
        hashes = F.when(enabled, hashes)
    numbered = requests.withColumns({"_hashes": hashes, "_request": F.monotonically_increasing_id()})
    return written(numbered, "requests")


def item_texts(asked: DataFrame, items: str = "results", model_name: str | None = None) -> DataFrame:
    """``content`` and ``text_hash`` of all items of ``asked_items``, for ``second_pass.candidates``."""
    pair = F.arrays_zip(F.col("_hashes").alias("text_hash"), F.col(f"{items}.content").alias("content"))
    named = [model_name] if model_name else []
    return asked.select(*named, F.inline(pair))


def apply_verdicts_to_items(asked: DataFrame, verdicts: DataFrame, items: str = "results") -> DataFrame:
    """Replace the condemned items inside each array of ``asked_items``.

    Hashes meet the verdicts; only the places of condemned items are joined to the requests, and
    only to those that may hold one. The others stay where they lie.
    """
    places = asked.select("_request", F.posexplode("_hashes").alias("_pos", "text_hash"))
    bad = (
        places.filter("text_hash IS NOT NULL").join(condemned(verdicts), "text_hash")
        .groupBy("_request")  # at most the positions of one array
        .agg(F.collect_set("_pos").alias("_bad"))
    )
    bad = written(bad, "condemned-items")
    clear, maybe = parted(asked, "_request", bad)
    clear = clear.withColumn("_bad", F.lit(None).cast("array<int>"))
    replaced = F.transform(
        items,
        lambda item, pos: F.struct(
            item["title"].alias("title"),
            model.apply_verdict(
                item["content"], F.coalesce(F.array_contains("_bad", pos), F.lit(False))
            ).alias("content"),
            item["url"].alias("url"),
        ),
    )
    joined = clear.unionByName(maybe.join(bad, "_request", "left"))
    judged = joined.withColumn(items, replaced)
    return judged.select(*(c for c in asked.columns if c not in ("_hashes", "_request")))


def threat_by_request(
    items: DataFrame,
    request_id: str,
    flag: Column,
    requests: DataFrame | None = None,
) -> DataFrame:
    """``threat_intercepted`` and ``n_items`` per request from item rows.

    With ``requests`` (their ids, each once) those without items are reported as well.
    """
    found = items.groupBy(request_id).agg(
        F.bool_or(flag).alias("threat_intercepted"), F.count("*").alias("n_items")
    )
    if requests is not None:
        found = requests.select(request_id).join(found, request_id, "left").select(
            request_id,
            F.coalesce("threat_intercepted", F.lit(False)).alias("threat_intercepted"),
            F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        )
    return found.withColumn("status", F.lit(fixed.PROCESSED))


def item_pages(
    items: DataFrame, request_id: str, rank: str, columns: Sequence[str], page_size: int = 256
) -> DataFrame:
    """Item rows back in arrays in rank order: ``request_id``, ``page``, ``results``.

    Ranks are unique within a request and count from 0, so a page holds ``page_size`` items
    at most and a large request is spread over many tasks. A request that fits in one page is
    one row.
    """
    page = F.floor(F.col(rank) / page_size)
    collected = F.sort_array(F.collect_list(F.struct(rank, *columns)))
    without_rank = F.transform(
        collected, lambda i: F.struct(*(i[c].alias(c) for c in columns))
    )
    return items.groupBy(request_id, page.alias("page")).agg(without_rank.alias("results"))


def pair_report(
    pairs: DataFrame, rules: Sequence[Rule] | None = None, dlp_rules: Sequence[Rule] = DLP
) -> DataFrame:
    """Inbound verdict, outbound report and the agent's status for each pair of texts.

    One projection over one scan.
    """
    reported = egress.with_dlp_report(
        pairs.withColumn("sanitized_inbound_preview", inbound.sanitize("incoming_content", rules)),
        "outbound_intent",
        dlp_rules,
    )
    return with_agent_status(reported)


def with_agent_status(reported: DataFrame) -> DataFrame:
    """The report's columns from ``sanitized_inbound_preview`` and a leak report."""
    hit = inbound.flagged("sanitized_inbound_preview")
    return reported.withColumn("inbound_threat_detected", hit).select(
        *(
            c for c in reported.columns
            if c not in ("incoming_content", "outbound_intent", "is_null",
                         "safe", "violations", "action", "sanitized_inbound_preview")
        ),
        F.lit(fixed.COMPLETED).alias("simulation_status"),
        "inbound_threat_detected",
        "sanitized_inbound_preview",
        F.struct("safe", "violations", "action").alias("outbound_dlp_report"),
        F.when(F.col("inbound_threat_detected") | ~F.col("safe"), fixed.ISOLATED)
        .otherwise(fixed.SECURE).alias("agent_status"),
    )
