"""Published tables: readers see a whole version, whatever a writer does; any version can be had again."""

import pytest
from pyspark.sql import functions as F

from brookfern.sources import files

SCHEMA = "n long"


def numbers(spark, path, **more):
    return sorted(r.n for r in files.read_json(spark, path, SCHEMA, **more).collect())


def test_versions_swap_in_one_step(spark, tmp_path):
    path = str(tmp_path / "table")
    assert numbers(spark, path) == [] and files.versions(spark, path) == [] and files.current(spark, path) is None
    first = files.publish(spark.range(3).withColumnRenamed("id", "n"), path)
    assert numbers(spark, path) == [0, 1, 2]
    pinned = files.read_json(spark, path, SCHEMA)  # a reader between the steps
    files.write_json(spark.range(5, 7).withColumnRenamed("id", "n"), path)
    assert numbers(spark, path) == [5, 6] and sorted(r.n for r in pinned.collect()) == [0, 1, 2]
    assert len(files.versions(spark, path)) == 2 and numbers(spark, path, version=first) == [0, 1, 2]
    files.restore_version(spark, path, first)
    assert numbers(spark, path) == [0, 1, 2]
    with pytest.raises(ValueError, match="no version"):
        files.restore_version(spark, path, "v00000009-none")


def test_a_failed_writer_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    files.publish(spark.range(2).withColumnRenamed("id", "n"), path)
    with pytest.raises(Exception, match="broken"):
        files.publish(spark.range(2).select(F.when(F.col("id") == 1, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("n")), path)
    assert numbers(spark, path) == [0, 1] and len(files.versions(spark, path)) == 1


def test_log_of_jobs(spark, tmp_path):
    for i in range(3):
        files.logged(spark, str(tmp_path / "log"), {"job": i, "state": "done"})
    rows = spark.read.schema("job int, state string").json(str(tmp_path / "log")).collect()
    assert sorted(r.job for r in rows) == [0, 1, 2]
