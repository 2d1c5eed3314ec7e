"""Session settings, the shared folder for intermediate tables, and scan spreading."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "textguard", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the library is written for; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def conf_for(spark: SparkSession, **conf: object) -> Iterator[None]:
    """Settings, named as in ``session``, for the jobs that run meanwhile in this session.

    The values before are put back, whatever happens; queries not run yet do not see them.
    """
    settings = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers where it is not installed.

    Only a model scorer needs it; all other work is done by Spark's own functions.
    """
    context = spark.sparkContext
    if any("textguard" in Path(f).name for f in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="textguard-package-")) / "textguard"
    # Spark copies the archive to every executor from the driver.
    context.addPyFile(shutil.make_archive(str(target), "zip", root.parent, root.name))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textguard-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write a result that is read more than once and read it back.

    What follows no longer depends on the executors that made it, and it is made once.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """Repartition a scan that yields fewer partitions than there are cores.

    A table of many files passes unchanged; one small file would otherwise keep the regex
    work in a single task. ``keys`` should be (nearly) unique columns. For a stream, ``like`` is
    a batch scan of the same files.
    """
    want = frame.sparkSession.sparkContext.defaultParallelism
    have = (like or frame).rdd.getNumPartitions()  # plan metadata only, nothing is run
    return frame if have >= want else frame.repartition(want, *keys)
