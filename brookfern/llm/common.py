"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import share_package

#: ASCII white space that separates words in every contract of this package.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset in local mode (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="brookfern-")
        spark.conf.set("spark.checkpoint.dir", found)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def write_shared(df: DataFrame, label: str, partition_by: str | None = None) -> str:
    """Write ``df`` as Parquet under the shared folder and return the path: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table of this package that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, label))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that are dealt out by key, never broadcast before they run.

    Sizes are estimated from compressed files, and an explode counts as one row: a table of few megabytes by that estimate may
    be a gigabyte in the driver."""
    return df.hint("merge")


def trim() -> None:
    """Give memory that is free in this Python worker back: workers live on beside other stages."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def free(name: str, *frames: DataFrame) -> str:
    """``name``, or a longer one that is no column of the frames."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
