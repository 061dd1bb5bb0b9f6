"""Counts and look-ups over the state tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload_filter(wanted: dict[str, object] | None) -> Column:
    """All of the given columns have the given values; nothing given lets every row pass. Reaches the Parquet scan."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in (wanted or {}).items()], F.lit(True))


def listed(df: DataFrame, status: str | None, order: str) -> DataFrame:
    """Rows of a status (or all), the latest first."""
    return (df if status is None else df.where(F.col("status") == status)).orderBy(F.desc_nulls_last(order), df.columns[0])


def by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def total_chunks(versions: DataFrame) -> DataFrame:
    return versions.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"))


def latest_jobs(jobs: DataFrame, limit: int = 10, job_type: str | None = None) -> DataFrame:
    df = jobs if job_type is None else jobs.where(F.col("job_type") == job_type)
    return df.orderBy(F.desc("started_at"), "job_id").limit(limit)


def active_mapping(documents: DataFrame) -> DataFrame:
    return documents.where("active_version_id IS NOT NULL").select("document_id", "active_version_id")


def active_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions that a document names as its active one."""
    d = documents.select(F.col("active_version_id").alias("version_id"), F.col("source_path"))
    return versions.join(d, "version_id")


def shared_hashes(documents: DataFrame) -> DataFrame:
    """Hashes that more than one document has, with their number."""
    return documents.where("md5_hash IS NOT NULL").groupBy("md5_hash").agg(F.count("*").alias("n_documents"), F.min("document_id").alias("first_document")).where("n_documents > 1")
