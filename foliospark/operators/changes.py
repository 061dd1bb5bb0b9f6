"""What a scan found against what is stored: new, changed, unchanged, to be indexed again, deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detect_changes(discovered: DataFrame, stored: DataFrame, profile_id: str | Column) -> DataFrame:
    """(source_path, document_id, change_type, reason, stored_md5, found_md5), one row for each path on either side.

    ``discovered`` has (source_path, md5_hash) and ``stored`` (source_path, document_id, version_id, version_md5,
    version_profile, status), each path once. Rows with status ``deleted`` count as not stored. Null paths match nothing.
    """
    profile = F.lit(profile_id) if isinstance(profile_id, str) else profile_id
    d = discovered.select("source_path", F.col("md5_hash").alias("found_md5"), F.lit(True).alias("__d"))
    s = stored.where("coalesce(status, '') <> 'deleted'").select(
        "source_path", "document_id", F.col("version_id").alias("__v"), F.col("version_md5").alias("stored_md5"), F.col("version_profile").alias("__p"), F.lit(True).alias("__s")
    )
    rules = [
        (F.col("__s").isNull(), "new", "Not stored"),
        (F.col("__d").isNull(), "deleted", "Not found"),
        (F.col("__v").isNull(), "changed", "No active version"),
        (~F.col("found_md5").eqNullSafe(F.col("stored_md5")), "changed", "Content differs"),
        (~F.col("__p").eqNullSafe(profile), "reindex_required", "Settings differ"),
    ]
    kind, reason = F.lit("unchanged"), F.lit("Same content and settings")
    for test, k, r in reversed(rules):
        kind, reason = F.when(test, k).otherwise(kind), F.when(test, r).otherwise(reason)
    both = d.join(s, "source_path", "full_outer")
    return both.select("source_path", "document_id", kind.alias("change_type"), reason.alias("reason"), "stored_md5", "found_md5")


def stored_state(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Every document with its active version's hash and profile, both null where there is none."""
    v = versions.select(F.col("version_id").alias("active_version_id"), F.col("md5_hash").alias("version_md5"), F.col("index_profile_id").alias("version_profile"))
    return documents.join(v, "active_version_id", "left").select(
        "source_path", "document_id", F.when(F.col("version_md5").isNotNull(), F.col("active_version_id")).alias("version_id"), "version_md5", "version_profile", "status"
    )


def summarize_changes(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))


def files_to_process(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("change_type").isin("new", "changed", "reindex_required"))
