"""State tables as immutable values: each function returns the table as it is after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_unique(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``new`` whose key it does not have yet."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``new``, which replace those of the same key; columns ``new`` lacks are null."""
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True).select(*table.columns)


def update_known(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Columns of ``updates`` replace those of ``table`` where they are not null; null changes nothing."""
    names = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    out = [F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in table.columns]
    return table.join(u, key, "left").select(*out)


def clear_errors(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``error_message`` set to null for the keys of ``ids``; an update with null would leave it."""
    d = table.join(ids.select(key, F.lit(True).alias("__clear")).distinct(), key, "left")
    return d.withColumn("error_message", F.when(F.col("__clear").isNull(), F.col("error_message"))).select(*table.columns)


def pending_versions(versions: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """(document_id, md5_hash, index_profile_id, version_id, reused): the id of an equal version, or one derived from the three."""
    keys = ["document_id", "md5_hash", "index_profile_id"]
    old = versions.groupBy(*keys).agg(F.min("version_id").alias("__old"))
    fresh = F.regexp_replace(F.md5(F.concat_ws("|", *keys)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return wanted.join(old, keys, "left").select(*keys, F.coalesce("__old", fresh).alias("version_id"), F.col("__old").isNotNull().alias("reused"), now.alias("created_at"))


def activate(documents: DataFrame, versions: DataFrame, swaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Make each (document_id, version_id) of ``swaps`` the active one; the version it replaces becomes ``deleted``."""
    s = swaps.select("document_id", F.col("version_id").alias("__new"))
    d = documents.join(s, "document_id", "left")
    replaced = d.where("__new IS NOT NULL AND active_version_id IS NOT NULL AND active_version_id <> __new").select(F.col("active_version_id").alias("version_id"), F.lit(True).alias("__gone")).distinct()
    docs = d.withColumn("active_version_id", F.coalesce("__new", "active_version_id")).withColumn("status", F.when(F.col("__new").isNotNull(), "active").otherwise(F.col("status")))
    v = versions.join(s.select(F.col("__new").alias("version_id"), F.lit(True).alias("__live")), "version_id", "left").join(replaced, "version_id", "left")
    status = F.when(F.col("__live"), "active").when(F.col("__gone"), "deleted").otherwise(F.col("status"))
    return docs.select(*documents.columns), v.withColumn("status", status).select(*versions.columns)


def delete_documents(documents: DataFrame, versions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the documents of ``gone`` and, as by a foreign key, without their versions."""
    ids = gone.select("document_id").distinct()
    return documents.join(ids, "document_id", "left_anti"), versions.join(ids, "document_id", "left_anti")


def mark_deleted(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Status ``deleted`` and no active version, so that the next scan does not find them deleted again."""
    d = documents.join(gone.select("document_id", F.lit(True).alias("__gone")).distinct(), "document_id", "left")
    return (
        d.withColumn("active_version_id", F.when(F.col("__gone").isNull(), F.col("active_version_id")))
        .withColumn("status", F.when(F.col("__gone"), "deleted").otherwise(F.col("status")))
        .select(*documents.columns)
    )


def clean_old_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions that are active for their document."""
    live = documents.where("active_version_id IS NOT NULL").select(F.col("active_version_id").alias("version_id")).distinct()
    return versions.join(live, "version_id", "left_semi")
