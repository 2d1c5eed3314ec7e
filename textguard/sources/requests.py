"""Sanitise requests and inbound/outbound pairs, with invalid ones set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST_SCHEMA = (
    "request_id string, results array<struct<title:string,content:string,url:string>>"
)
PAIR_SCHEMA = "pair_id string, incoming_content string, outbound_intent string"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA).json(path)


def split_valid_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests whose items have all three fields, and the rest with a ``reason``."""
    broken = F.exists(
        "results",
        lambda r: r.isNull() | r["title"].isNull() | r["content"].isNull() | r["url"].isNull(),
    )
    reason = F.when(F.col("results").isNull(), "results missing").when(
        broken, "item field missing"
    )
    checked = requests.withColumn("reason", reason)
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )


def split_valid_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with both texts, and the rest with a ``reason``."""
    reason = F.when(F.col("incoming_content").isNull(), "incoming_content missing").when(
        F.col("outbound_intent").isNull(), "outbound_intent missing"
    )
    checked = pairs.withColumn("reason", reason)
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )
