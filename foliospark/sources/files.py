"""Listing, admitting and hashing files with Spark's binary file source."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import SPACE

# Parts a file name may not have, and reserved device names.
SUSPICIOUS = ["..", "~", "$", "`", "|", ";", "&", "\x00"]
RESERVED = ["CON", "PRN", "AUX", "NUL"] + [f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)]
# Limits for archives.
MAX_ENTRIES, MAX_UNPACKED, MAX_RATIO = 1000, 100 * 1024 * 1024, 100


def name_problem(name: Column) -> Column:
    """Why a file name is refused, or null: blanks at an end, a suspicious part, a reserved stem."""
    out = F.when(name.rlike(f"^[{SPACE}]|[{SPACE}]\\z"), "whitespace")
    for part in SUSPICIOUS:
        out = out.when(name.contains(part), "suspicious")
    return out.when(F.upper(F.substring_index(name, ".", 1)).isin(RESERVED), "reserved")


def is_contained(path: Column, root: str) -> Column:
    """Whether a path, with its ``.`` and ``..`` resolved, lies under a root; null does not."""
    start = F.array().cast("array<string>")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    resolved = F.aggregate(parts, start, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    inside = F.concat(F.lit("/"), F.array_join(resolved, "/"), F.lit("/"))
    return F.coalesce(F.startswith(inside, F.lit(root.rstrip("/") + "/")), F.lit(False))


def has_size(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Adds ``size_matches`` by (source_path, expected_size); files that nothing is expected of match."""
    return files.join(expected, "source_path", "left").withColumn("size_matches", F.coalesce(F.col("file_size") == F.col("expected_size"), F.lit(True))).drop("expected_size")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def admit(files: DataFrame, extensions: list[str], max_bytes: int, max_path: int = 4096) -> DataFrame:
    """Adds ``problem``: the first rule a file breaks (name, path length, size, extension), or null."""
    problem = F.coalesce(
        name_problem(F.col("file_name")),
        F.when(F.length("source_path") > max_path, "path_length"),
        F.when(F.col("file_size") > max_bytes, "size"),
        F.when(~F.coalesce(extension(F.col("file_name")).isin(extensions), F.lit(False)), "extension"),
    )
    return files.withColumn("problem", problem)


def list_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(source_path, file_name, file_type, file_size, modified_at[, content]); without content only metadata is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    rel = F.expr("substr(p, length(r) + 2)")
    df = df.withColumn("p", base).withColumn("r", F.lit(root.rstrip("/"))).withColumn("source_path", rel).withColumn("file_name", F.element_at(F.split("source_path", "/"), -1))
    cols = ["source_path", "file_name", extension(F.col("file_name")).alias("file_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at")]
    return df.select(*cols, *(["content"] if content else []))


def hash_files(files: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Adds ``md5_hash``; with an earlier listing also ``stable``: size and time are as they were."""
    out = files.withColumn("md5_hash", F.md5("content"))
    if before is None:
        return out
    b = before.select("source_path", F.col("file_size").alias("__s"), F.col("modified_at").alias("__m"))
    return out.join(b, "source_path", "left").withColumn("stable", F.col("file_size").eqNullSafe(F.col("__s")) & F.col("modified_at").eqNullSafe(F.col("__m"))).drop("__s", "__m")


def archive_sizes(data: bytes | None) -> tuple[bool, int, int, float]:
    """(safe, entries, unpacked bytes, ratio) of an archive; what is no archive, or null, is safe."""
    try:
        infos = zipfile.ZipFile(io.BytesIO(data)).infolist() if data is not None else []
    except zipfile.BadZipFile:
        infos = []
    total, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    ratio = total / packed if packed else 0.0
    return len(infos) <= MAX_ENTRIES and total <= MAX_UNPACKED and ratio <= MAX_RATIO, len(infos), total, ratio


def check_archive(data: bytes) -> None:
    safe, entries, total, ratio = archive_sizes(data)
    if not safe:
        raise ValueError(f"the archive passes the limits: {entries} entries, {total} bytes, ratio {ratio:.0f}")


@F.pandas_udf(T.StructType().add("safe", T.BooleanType()).add("entries", T.IntegerType()).add("unpacked", T.LongType()).add("ratio", T.DoubleType()))
def archive_check(contents: pd.Series) -> pd.DataFrame:
    """Whether an archive stays within the limits; what is no archive, or null, is safe."""
    return pd.DataFrame([archive_sizes(data) for data in contents], columns=["safe", "entries", "unpacked", "ratio"])
