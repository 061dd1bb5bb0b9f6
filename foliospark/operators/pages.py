"""Pages of scanned documents: which need recognition, how it went, and how its text joins what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliospark.functions.text import strip, word_jaccard


def is_scan_page(chars: Column, area: Column, has_images: Column) -> Column:
    """Little text for its area, or images and hardly any text."""
    density = F.coalesce(F.try_divide(chars, area), F.lit(0.0))
    return ((density < 0.001) & (chars < 50)) | (has_images & (chars < 100))


def recognition_status(pages: DataFrame, low_text: int = 20) -> DataFrame:
    """(document_id, n_pages, n_low, n_failed, mean_confidence, status, outcome) of pages with (text, confidence).

    ``status``: required if all pages have less than ``low_text`` characters, partial if some, else not_needed.
    ``outcome``: failed, partial_failed or completed by pages without text. Null text has no characters; the mean is
    over confidences above 0.
    """
    chars = F.length(strip(F.coalesce("text", F.lit(""))))
    g = pages.groupBy("document_id").agg(
        F.count("*").alias("n_pages"),
        F.count_if(chars < low_text).alias("n_low"),
        F.count_if(chars == 0).alias("n_failed"),
        F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 9).alias("mean_confidence"),
    )
    some = lambda n: F.when(F.col(n) == F.col("n_pages"), 2).when(F.col(n) > 0, 1).otherwise(0)
    return g.withColumn("status", F.element_at(F.array(*map(F.lit, ["not_needed", "partial", "required"])), some("n_low") + 1)).withColumn(
        "outcome", F.element_at(F.array(*map(F.lit, ["completed", "partial_failed", "failed"])), some("n_failed") + 1)
    )


def merge_recognized(blocks: DataFrame, pages: DataFrame, same: float = 0.8) -> DataFrame:
    """(document_id, page_number, text, similarity): recognized pages that add something to the blocks of their page.

    A page stays if no block has its number or the word overlap with them is at most ``same``.
    """
    own = blocks.where("page_number IS NOT NULL AND text IS NOT NULL").groupBy("document_id", "page_number").agg(F.array_sort(F.collect_set("text")).alias("__t"))
    j = pages.join(own, ["document_id", "page_number"], "left").withColumn("similarity", F.when(F.col("__t").isNotNull(), word_jaccard(F.col("text"), F.array_join("__t", " "))))
    return j.where(F.col("similarity").isNull() | (F.col("similarity") <= same)).select("document_id", "page_number", "text", "similarity")


def append_recognized(blocks: DataFrame, added: DataFrame) -> DataFrame:
    """(document_id, sequence, block_type, text, page_number): the blocks, and after a document's last one its added pages.

    ``added`` are the pages that ``merge_recognized`` keeps; each becomes a paragraph, in page order. Documents without
    blocks start at 0.
    """
    last = blocks.groupBy("document_id").agg(F.max("sequence").alias("__last"))
    number = F.row_number().over(W.partitionBy("document_id").orderBy("page_number"))
    new = added.join(last, "document_id", "left").withColumn("sequence", (F.coalesce("__last", F.lit(-1)) + number).cast("int"))
    columns = ["document_id", "sequence", "block_type", "text", "page_number"]
    return blocks.select(*columns).unionByName(new.withColumn("block_type", F.lit("paragraph")).select(*columns))
