"""Sinks for the reports. Responses keep explicit nulls, as the callers of the service see them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _write(frame: DataFrame, path: str, form: str) -> None:
    writer = frame.write.mode("errorifexists").format(form)
    if form == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.save(path)


def write_search_responses(responses: DataFrame, path: str, form: str = "json") -> None:
    _write(
        responses.select("request_id", "query", "verified", "results", "fetch_status"), path, form
    )


def write_sanitize_responses(responses: DataFrame, path: str, form: str = "json") -> None:
    _write(
        responses.select("request_id", "status", "threat_intercepted", "results"), path, form
    )


def write_pair_reports(reports: DataFrame, path: str, form: str = "json") -> None:
    _write(reports, path, form)


def write_items_in_order(
    items: DataFrame, path: str, request_id: str = "request_id", rank: str = "rank"
) -> None:
    """Item rows of requests of any size, in request and rank order across the files.

    The range is cut on both columns, so a request that holds a third of the table still ends
    up in many files of even size.
    """
    _write(
        items.repartitionByRange(F.col(request_id), F.col(rank)).sortWithinPartitions(
            request_id, rank
        ),
        path,
        "parquet",
    )
