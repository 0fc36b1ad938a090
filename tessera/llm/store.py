"""Shared-folder tables that cut lineage, and size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of keys up to which a key set is broadcast, and what a row of up to three numbers takes as a hashed relation.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64
#: The setting for how many bytes of rows go to a worker at once, and the bound that bounded_batches sets.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where that is unset, a temporary folder serves a local
    session; on a cluster nobody else would see it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write once to the shared folder and go on from the files: lost executors never recompute what is above."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Removes all stage tables and files that this application has written so far, and returns how many. Call it when
    the results that were returned have been saved: they read these tables."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the batches that go to workers by bytes, for the session, unless it has a bound of its own. Spark's default
    bounds rows, so that executor and worker each hold a batch as large as its texts are long."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(most))


def is_small(keys: DataFrame) -> bool:
    """Whether a table of up to three numbers a row, as a stage table, is small enough to be broadcast."""
    return keys.count() * ROW_BYTES <= BROADCAST_BYTES


def keyed_to(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key is in keys (distinct, one column `on`), or isn't (left_anti). Only a small key set is broadcast."""
    return rows.join(F.broadcast(keys) if is_small(keys) else keys, on, how)
