"""Stable identifiers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the DNS namespace of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace_hex: str = DNS_NAMESPACE) -> Column:
    """Name-based UUID (version 5): SHA-1 over namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def chunk_id(document_id: Column, version_id: Column, index: Column) -> Column:
    return uuid5(F.concat_ws("/", document_id, version_id, index.cast("string")))


def index_profile_id(target: Column, overlap: Column, most: Column, keep_pages: Column, model: Column, size: Column, normalize: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256 over the indexing settings joined by ``|``."""

    def flag(c: Column) -> Column:
        return F.when(c, "True").otherwise("False")

    parts = [target.cast("string"), overlap.cast("string"), most.cast("string"), flag(keep_pages), model, size.cast("string"), flag(normalize), F.lit("parser_v1")]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
