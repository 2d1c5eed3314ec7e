"""Live sums per time window that lose no event, and one stream into two sinks.

``Sums`` keeps what each micro-batch adds, not what a state store holds: a batch writes its own
partial sums, a reader adds them up. Rows that come too late for their window go to a table of
their own with the reason, so sums and late rows together are all events. Days that can get no
more rows are added up once into the closed table, which readers take in place of the parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textguard.functions import egress, fixed
from textguard.sources.rules import DLP, Rule


def read_or_empty(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A parquet table, or no rows where nothing was written yet; other errors are raised."""
    try:
        return spark.read.schema(fields).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields)


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of this module's own through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass(frozen=True)
class Sums:
    """Additive measures per tumbling window and group, kept under ``path``.

    ``time`` names the event time, ``by`` the group columns with their types (``"source string"``),
    ``measures`` aggregates that add up over batches (counts and sums, as bigint). ``length`` and
    ``late`` are intervals. A window takes rows until the newest event of the earlier batches is
    ``late`` past its end; a row after that, or without a time, is a late row. A NULL in a group
    column is a group of its own.
    """

    path: str
    time: str
    length: str
    late: str
    by: tuple[str, ...]
    measures: Mapping[str, Column]

    @cached_property
    def _keys(self) -> list[str]:
        return ["window_start", *(b.split()[0] for b in self.by)]

    @cached_property
    def _fields(self) -> str:
        return ", ".join(["window_start timestamp", *self.by, *(f"`{m}` bigint" for m in self.measures)])

    def _open(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.path}/open", f"{self._fields}, day date, batch_id bigint")

    def _closed(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.path}/closed", f"{self._fields}, day date")

    def _newest(self, spark: SparkSession, before: int) -> object:
        """The newest event time of the batches before this one."""
        marks = read_or_empty(spark, f"{self.path}/marks", "batch_id bigint, newest timestamp, slot int")
        return marks.filter(F.col("batch_id") < before).agg(F.max("newest")).first()[0]

    def _edge(self, newest: object) -> Column:
        return F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {self.late}")

    def write(self, batch: DataFrame, batch_id: int, tidy_every: int = 100) -> None:
        """Add a micro-batch. The same batch written again changes nothing."""
        spark = batch.sparkSession
        seen = self._newest(spark, batch_id)
        time = F.col(self.time).cast("timestamp")
        # One window a row, without the row being dropped for a missing time.
        window = F.window(F.coalesce(time, F.lit("1970-01-01").cast("timestamp")), self.length)
        why = F.when(time.isNull(), "no time").when(window["end"] <= self._edge(seen), "late")
        placed = batch.select("*", window["start"].alias("window_start"), why.alias("why"))
        # What the batch holds is worked out once, late rows too; the rest reads these sums.
        summed = placed.groupBy(*self._keys, "why").agg(
            F.max(time).alias("_newest"),
            *(m.cast("bigint").alias(name) for name, m in self.measures.items()),
        ).persist()
        try:
            self._write(summed, placed, seen, batch_id)
        finally:
            summed.unpersist()
        if batch_id % tidy_every == tidy_every - 1:
            self.tidy(spark, batch_id + 1)

    def _write(self, summed: DataFrame, placed: DataFrame, seen: object, batch_id: int) -> None:
        some_late = not summed.filter("why IS NOT NULL").isEmpty()
        placed.filter("why IS NOT NULL" if some_late else "false").drop("window_start").write.mode(
            "overwrite"
        ).parquet(f"{self.path}/late/batch_id={batch_id}")
        added = summed.filter("why IS NULL").select(
            *self._keys, *self.measures, F.to_date("window_start").alias("day"), F.lit(batch_id).alias("batch_id")
        )
        added.hint("rebalance", "day").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day", "batch_id").parquet(f"{self.path}/open")
        newest = summed.agg(F.greatest(F.max("_newest"), F.lit(seen).cast("timestamp")).alias("newest"))
        # Two places in turn: a batch that fails here leaves the mark of the one before.
        newest.select(F.lit(batch_id).cast("bigint").alias("batch_id"), "newest").write.mode(
            "overwrite"
        ).parquet(f"{self.path}/marks/slot={batch_id % 2}")

    def tidy(self, spark: SparkSession, before: int) -> None:
        """Close the days that can get no more rows, and remove the parts of those closed earlier.

        A day is closed before its parts go, and parts of a closed day are not read, so a failure
        at any place loses and doubles nothing. Only the stream's own writer may call this.
        """
        closed = self._closed(spark).select("day").distinct()
        days = self._open(spark).select("day").distinct()
        for row in days.join(closed, "day", "left_semi").collect():
            _remove(spark, f"{self.path}/open/day={row.day}")
        parts, seen = self._open(spark), self._newest(spark, before)
        # The last window that starts on a day ends at most its length after it.
        ends = F.date_add("day", 1).cast("timestamp") + F.expr(f"INTERVAL {self.length}")
        ripe = parts.join(closed, "day", "left_anti").filter(ends <= self._edge(seen))
        self._added(ripe, "day").hint("rebalance", "day").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day").parquet(f"{self.path}/closed")

    def _added(self, parts: DataFrame, *more: str) -> DataFrame:
        return parts.groupBy(*self._keys, *more).agg(
            *(F.sum(m).cast("bigint").alias(m) for m in self.measures)
        )

    def start(
        self, stream: DataFrame, checkpoint: str, available_now: bool = False, tidy_every: int = 100
    ) -> StreamingQuery:
        writer = stream.writeStream.option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.foreachBatch(lambda rows, n: self.write(rows, n, tidy_every)).start()

    def current(self, spark: SparkSession, since: object = None) -> DataFrame:
        """The sums as they stand; ``since`` reads only the days from that one on."""
        parts, closed = self._open(spark), self._closed(spark)
        if since is not None:
            parts, closed = (f.filter(F.col("day") >= F.lit(since)) for f in (parts, closed))
        still_open = parts.join(closed.select("day").distinct(), "day", "left_anti")
        columns = [*self._keys, *self.measures]
        return closed.select(*columns).unionByName(self._added(still_open).select(*columns))

    def late_rows(self, spark: SparkSession, fields: str) -> DataFrame:
        """The rows that came too late, with ``why`` and ``batch_id``; ``fields`` is their schema."""
        return read_or_empty(spark, f"{self.path}/late", f"{fields}, why string, batch_id bigint")


def levels(sums: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums over every set of the ``by`` columns, the whole table included.

    ``level`` names the columns a row is for, joined by commas, so that a NULL group and a column
    left out are told apart. An empty table has no rows.
    """
    sets = [[c for j, c in enumerate(by) if n >> j & 1] for n in range(2 ** len(by))]
    named = F.array_join(
        F.array_compact(F.array(*(F.when(F.grouping(c) == 0, F.lit(c)) for c in by))), ","
    )
    return sums.groupingSets(sets, *by).agg(
        named.alias("level"), *(F.sum(m).cast("bigint").alias(m) for m in measures)
    )


def part_by_action(
    stream: DataFrame,
    payload: str,
    blocked: str,
    allowed: str,
    checkpoint: str,
    rules: Sequence[Rule] = DLP,
    available_now: bool = False,
) -> StreamingQuery:
    """Rows with their leak report into two sinks, BLOCK rows to one path and ALLOW to the other.

    The report of a micro-batch is made once and kept while both sinks are written. Each batch has
    a folder of its own in each sink, also an empty one, and a batch that is run again overwrites
    both: whichever write a failure came after, both sinks end as if there had been none. A NULL
    payload is allowed, as in the report.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        report = egress.with_dlp_report(batch, payload, rules).persist()
        try:
            for path, action in ((blocked, fixed.BLOCK), (allowed, fixed.ALLOW)):
                rows = report.filter(F.col("action") == action)
                rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            report.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(write).start()
