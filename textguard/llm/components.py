"""Connected components of links, by joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.session import written


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of all ids in links ``a``, ``b``.

    In each round every id points to its smallest smaller neighbour, pointers are followed to
    their roots by doubling, and links are drawn again between roots, until none is left; every
    round joins all ids that have a smaller neighbour, so chains and stars take one or two. Links
    may repeat, point either way or to themselves; null ends are ignored. No links give an empty
    result. Each table is written, so that a lost executor costs one step; none goes to the
    driver.
    """
    links = written(_ordered(links), "links")
    found = None
    while True:
        pointers = written(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")), "pointers")
        while True:
            upper = pointers.select(F.col("id").alias("component"), F.col("component").alias("upper"))
            if pointers.join(upper, "component", "left_semi").isEmpty():
                break
            jumped = pointers.join(upper, "component", "left")
            pointers = written(
                jumped.select("id", F.coalesce("upper", "component").alias("component")), "pointers"
            )
        found = pointers if found is None else _moved(found, "component", pointers).unionByName(pointers)
        moved = _moved(_moved(links, "a", pointers), "b", pointers)
        links = written(_ordered(moved), "links")
        if links.isEmpty():
            break
        found = written(found, "components")
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    return written(found.unionByName(roots).groupBy("id").agg(F.min("component").alias("component")), "components")


def _ordered(links: DataFrame) -> DataFrame:
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ends.filter("a < b").distinct()


def _moved(frame: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """The frame with the ids of a column replaced by what they point to."""
    to = pointers.select(F.col("id").alias(column), F.col("component").alias("__to"))
    joined = frame.join(to, column, "left")
    return joined.withColumn(column, F.coalesce("__to", column)).select(*frame.columns)
