"""Search requests and landed provider responses.

Responses are read from where a fetcher put them, one JSON object per line. Items are read
as maps, since a missing key and an explicit null mean different things: the first gives an
empty string, the second stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import fixed
from textguard.functions.anonymize import secured_query

# Items are kept as JSON text, so that one that is no object does not lose the others.
BODY_SCHEMA = "results array<string>, web struct<results: array<string>>"
LANDED_SCHEMA = (
    f"request_id string, provider string, fetch_status int, {BODY_SCHEMA}, _corrupt string"
)
ITEM_TYPE = "map<string,string>"
ITEMS_TYPE = "array<struct<title:string,content:string,url:string>>"
SEARXNG, BRAVE = "searxng", "brave"


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses. A line that is not JSON stays, with its text in ``_corrupt``."""
    return (
        spark.read.schema(LANDED_SCHEMA)
        .option("columnNameOfCorruptRecord", "_corrupt").json(path)
    )


def parse_body(frame: DataFrame, body: str = "body") -> DataFrame:
    """The same shape from a column that holds the provider's JSON text, parsed once.

    A body that is no JSON, is cut off, or has something else where the results should be stays
    in ``_corrupt``.
    """
    parsed = F.from_json(body, f"{BODY_SCHEMA}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    read = frame.withColumn("_body", parsed)
    none = F.when(F.col("_body").isNull(), F.col(body))  # an empty body is no JSON either
    return read.select(
        *(c for c in frame.columns if c != body), "_body.results", "_body.web",
        F.coalesce("_body._corrupt", none).alias("_corrupt"),
    )


def _parsed(results: Column) -> Column:
    """Each item as a map; NULL for an item that is no object."""
    return F.transform(
        results, lambda i: F.when(F.startswith(F.ltrim(i), F.lit("{")), F.from_json(i, ITEM_TYPE))
    )


def _items(results: Column, content_key: Column | str) -> Column:
    """The items before the first that is no object, as a provider client would read them."""

    def value(item: Column, key: Column | str) -> Column:
        key = F.lit(key) if isinstance(key, str) else key
        return F.when(F.map_contains_key(item, key), item[key]).otherwise(F.lit(""))

    # The array is wrapped, so that it is parsed once and not where each part is used.
    shaped = F.transform(
        F.array(_parsed(results)),
        lambda items: F.transform(
            F.slice(
                items,
                F.lit(1),
                F.coalesce(
                    F.nullif(F.array_position(F.transform(items, F.isnull), True), F.lit(0)) - 1,
                    F.size(items),
                ).cast("int"),
            ),
            lambda item: F.struct(
                value(item, "title").alias("title"),
                value(item, content_key).alias("content"),
                value(item, "url").alias("url"),
            ),
        ),
    )
    return F.element_at(shaped, 1)


def _all_objects(results: Column) -> Column:
    return F.coalesce(F.forall(_parsed(results), F.isnotnull), F.lit(True))


def searxng_items(results: Column | str = "results") -> Column:
    return _items(F.col(results) if isinstance(results, str) else results, "content")


def brave_items(results: Column | str = "web.results") -> Column:
    return _items(F.col(results) if isinstance(results, str) else results, "description")


def provider_name(provider: Column | str = "provider") -> Column:
    provider = F.col(provider) if isinstance(provider, str) else provider
    return F.lower(F.coalesce(provider, F.lit(SEARXNG)))


def normalize(landed: DataFrame, brave_key: bool = True) -> DataFrame:
    """Both providers in one row shape: ``items`` in place of the provider's own results.

    A failed fetch, an unknown provider, and Brave without a key have no items. The fetch
    status stays beside them, so that a failure does not pass for an empty result. ``parse_ok``
    is false where an item was no object; the items before it are kept. It is also false where
    ``_corrupt`` says that the body was damaged, which has no items.
    """
    provider, ok = provider_name(), F.col("fetch_status") == 200
    results = F.when(ok & (provider == SEARXNG), F.col("results"))
    key = F.lit("content")
    if brave_key:
        results = results.when(ok & (provider == BRAVE), F.col("web.results"))
        key = F.when(provider == BRAVE, "description").otherwise(key)
    kept = [c for c in landed.columns if c not in ("results", "web")]
    whole = F.col("_corrupt").isNull() if "_corrupt" in landed.columns else F.lit(True)
    return landed.select(
        *kept,
        F.coalesce(_items(F.when(whole, results), key), F.array().cast(ITEMS_TYPE)).alias("items"),
        (whole & _all_objects(results)).alias("parse_ok"),
    )


def item_rows(frame: DataFrame, items: str = "items") -> DataFrame:
    """One row per item with its ``rank``; a row without items gives none."""
    kept = [c for c in frame.columns if c != items]
    # An outer explode: for a plain one Spark would test the array, and so make it, once more.
    rows = frame.select(*kept, F.posexplode_outer(items).alias("rank", "_item"))
    return rows.filter("rank IS NOT NULL").select(
        *kept, "rank", "_item.title", "_item.content", "_item.url"
    )


def union_items(searxng: DataFrame, brave: DataFrame) -> DataFrame:
    """Items of separately landed providers in one table; equal items are all kept."""
    return searxng.unionByName(brave)


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a query, with ``secured_query`` beside the raw one, and the refused ones."""
    missing = F.coalesce(F.col("q"), F.lit("")) == ""
    refused = requests.filter(missing).select(
        "request_id", F.lit(400).alias("status"), F.lit(fixed.MISSING_QUERY).alias("error")
    )
    return requests.filter(~missing).withColumn("secured_query", secured_query("q")), refused
