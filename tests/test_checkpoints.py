"""Tables in the shared folder."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haplospark import checkpoints


def test_tables_are_released(spark):
    first = checkpoints.stored(spark.range(5), "first")
    path = first._stored_at.removeprefix("file:")
    second = checkpoints.stored(first.withColumn("x", F.lit(1)), "second", first)
    assert not os.path.exists(path) and second.count() == 5
    checkpoints.release(first, None, spark.range(1), second, second)


def test_batches_are_bounded_and_settings_come_back(spark):
    keys = list(checkpoints._LIMITS)
    before = [spark.conf.get(k) for k in keys]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    wide = spark.range(0, 30, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    got = checkpoints.stored(wide.mapInArrow(sizes, "n long, bytes long"), "sizes").agg(F.sum("n"), F.max("bytes")).first()
    assert got[0] == 30 and got[1] <= checkpoints.BATCH_BYTES + 1_100_000
    assert [spark.conf.get(k) for k in keys] == before
    with pytest.raises(ZeroDivisionError), checkpoints.small_batches(spark, 7):
        assert spark.conf.get(keys[0]) == "7" and 1 / 0
    assert [spark.conf.get(k) for k in keys] == before


def test_no_local_folder_for_several_machines():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoints.shared_dir(Session())
