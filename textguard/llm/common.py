"""What the operators share: reading, Arrow functions that keep a frame's other columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textguard.session import ship_package, spread

#: What an Arrow function makes of a batch: an array for each new or replaced column.
Columns = dict[str, pa.Array]

#: Bytes of a batch that a function works on at once.
PIECE = 8 << 20


def table(spark: SparkSession, folder: str, name: str, *keys: str) -> DataFrame:
    """A table of the folder, spread where it is one small file."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"), *keys)


def append(
    frame: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Columns]],
    fields: Sequence[T.StructField],
) -> DataFrame:
    """The frame with columns that an Arrow function makes of each batch.

    ``make`` is called once in each task. A new column takes the place of one of the same name
    (in any letter case, as Spark compares names); all other columns stay as they are.
    """
    ship_package(frame.sparkSession)
    _small_batches(frame.sparkSession)
    new = {f.name.lower(): f for f in fields}
    kept = [new.pop(f.name.lower(), f) for f in frame.schema]
    schema = T.StructType([*kept, *new.values()])
    made = {f.name for f in fields}
    names = schema.names
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in pieces(batches):
            if batch.num_rows:
                columns = function(batch)
                yield pa.RecordBatch.from_arrays(
                    [
                        columns[n].cast(arrow.field(i).type) if n in made else batch.column(i)
                        for i, n in enumerate(names)
                    ],
                    names=names,
                )
        # The worker process outlives its task; what the task held goes back now.
        pa.default_memory_pool().release_unused()

    return frame.mapInArrow(run, schema)


def _small_batches(spark: SparkSession) -> None:
    """Lets Spark send batches of about ``PIECE`` bytes, where a session still has its default.

    A batch is held by the JVM and by the worker at once.
    """
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    if spark.conf.get(name).removesuffix("b") == str(default):
        spark.conf.set(name, str(PIECE))


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``PIECE`` bytes, which bounds what is made of them."""
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def one_text_each(sampled: DataFrame, label: str) -> DataFrame:
    """One row for each ``doc_id``: the text with the least hash, so reruns take the same.

    Equal ids are brought down to one before the shuffle.
    """
    least = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    return sampled.groupBy("doc_id", label).agg(least.alias("text"))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


class Shipped:
    """A file's bytes, broadcast once; equal if the bytes are.

    Executors need no copy of the file. Its size is that of a tokenizer, not of any table.
    """

    def __init__(self, spark: SparkSession, path: str, limit: int = 256 << 20):
        with open(path, "rb") as file:
            data = file.read(limit + 1)
        if len(data) > limit:
            raise ValueError(f"{path} is larger than {limit} bytes")
        self.key = hashlib.sha256(data).hexdigest()
        self.data = spark.sparkContext.broadcast(data)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Shipped) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)
