"""Session defaults for local runs and tests; a cluster brings its own configuration."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("brookfern")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the place the driver has it (on a cluster: install it, or --py-files)."""
    home = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (home, env.get("PYTHONPATH", ""))))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset in local mode (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="brookfern-"))
    return sc.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: unlike a checkpoint, its size is known where joins are planned."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """``df`` dealt out by keys to two tasks a core, or ``least``: for rows of few bytes and much work, which else meet in few tasks."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, least), *keys)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once a row.

    Later expressions read a column many times; merged into one projection or a pushed filter, each reading would be
    worked out anew.  A generator of one row keeps them apart, inside the same stage."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
