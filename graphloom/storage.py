"""Tables written to the folder that driver and executors share, to cut lineage so that it survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths written by this process and not yet released, oldest first.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir`` (or the context's checkpoint folder).
    Only a local master without that setting gets a temporary folder, which
    goes when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage: what was written survives the loss of any executor.
    Returns the table and its path, for :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`materialize` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def mark() -> int:
    """A point in time, for :func:`release_since`."""
    return len(_WRITTEN)


def release_since(spark: SparkSession, point: int, *kept: str) -> None:
    """Delete all tables written since ``mark()`` but those kept; for plans whose result has been written."""
    release(spark, *[p for p in _WRITTEN[point:] if p not in kept])
