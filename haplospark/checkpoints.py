"""Cutting lineage so that a lost executor costs a read, not a recomputation: tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Where the session names none, a folder of our own is made only if
driver and executors are one process; on several machines that would be a different disk for each, so it is an error.
All tables of an application are below one folder, which goes when the application ends; ``release`` deletes a table as
soon as its last reader is done.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What a Python worker is handed at once, at most, while a table is written.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def there(spark: SparkSession, path: str) -> bool:
    system, p = _files(spark, path)
    return system.exists(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        named = tempfile.mkdtemp(prefix="haplospark-")
        sc.setCheckpointDir(named)
    own = f"{named.rstrip('/')}/haplospark-{sc.applicationId}"
    system, path = _files(spark, own)
    if not there(spark, own):
        system.mkdirs(path)
        system.deleteOnExit(path)
    return own


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within, Arrow batches have at most so many rows and ``BATCH_BYTES`` bytes; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k) for k in _LIMITS}
    for k, v in _LIMITS.items():
        spark.conf.set(k, str(v if k.endswith("maxBytesPerBatch") else rows))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder, and read from there; the tables ``done`` are deleted, once it is there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    release(*done)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables that have no reader left."""
    system, p = _files(spark, path)
    system.delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Have shuffle files deleted whose jobs are done: the driver's JVM notices only when it collects garbage, which a small plan seldom makes it do."""
    spark.sparkContext._jvm.System.gc()


class Levels:
    """A stored table that grows by one level at a time, each in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def add(self, level: int, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/level={level}")
        return self.of([level])

    def of(self, levels: list[int]) -> DataFrame:
        """The rows of these levels."""
        read = self.spark.read.schema(self.schema)
        return read.parquet(*[f"{self.path}/level={k}" for k in levels]) if levels else self.spark.createDataFrame([], self.schema)

    def every(self) -> DataFrame:
        """All rows, and their level."""
        return self.spark.read.schema(f"{self.schema}, level int").option("basePath", self.path).parquet(self.path)


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` wrote; others, and those that are gone, are left alone."""
    for t in tables:
        path = getattr(t, "__dict__", {}).pop("_stored_at", None)
        if path is not None:
            system, p = _files(t.sparkSession, path)
            system.delete(p, True)
