"""Chunk tables in version partitions and state tables in snapshots that a pointer makes current.

All files are reached through Hadoop's file system, so the folders may lie on any storage the cluster shares.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; one that is not there is no error."""
    _files(spark, path).delete(_path(spark, path), True)


def stage_chunks(chunks: DataFrame, path: str) -> int:
    """Write chunks by version; versions present in ``chunks`` are replaced, others stay. Returns the rows written."""
    seen = Observation()
    chunks.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(path)
    return seen.get["n"]


def read_chunks(spark: SparkSession, path: str, versions: DataFrame) -> DataFrame:
    """The chunks of some versions."""
    return spark.read.parquet(path).join(versions.select("version_id").distinct(), "version_id", "left_semi")


def staged_count_matches(spark: SparkSession, path: str, versions: DataFrame, expected: int) -> bool:
    """Whether the versions have as many chunks as were written."""
    return (read_chunks(spark, path, versions).count() if exists(spark, path) else 0) == expected


def remove_versions(spark: SparkSession, path: str, versions: DataFrame) -> int:
    """Delete the partitions of versions; their ids pass through the driver one by one, so their number has no bound."""
    n = 0
    for row in versions.select("version_id").where("version_id IS NOT NULL").distinct().toLocalIterator():
        n += exists(spark, f"{path}/version_id={row[0]}")
        remove(spark, f"{path}/version_id={row[0]}")
    return n


def write_snapshot(tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables into a new folder, then make it current by replacing one small file; a failure leaves the old one."""
    name = f"snapshot-{time.time_ns()}"
    spark = next(iter(tables.values())).sparkSession
    for table, df in tables.items():
        df.write.parquet(f"{root}/{name}/{table}")
    jvm, new = spark._jvm, _path(spark, f"{root}/.current.new")
    out = _files(spark, root).create(new, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs = _files(spark, root)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(_path(spark, f"{root}/current")), options)
    return name


def current_snapshot(spark: SparkSession, root: str) -> str | None:
    """The name of the current snapshot, or None if there is none."""
    if not exists(spark, f"{root}/current"):
        return None
    return spark.read.text(f"{root}/current").first()[0].strip()


def read_snapshot(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current_snapshot(spark, root)}/{table}")


def clear(spark: SparkSession, root: str) -> None:
    """Forget all state and all chunks."""
    remove(spark, root)
