"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import duplicates, garble, leaks, neighbours, packing, scans, sentences, unify
from foliospark.session import shuffle_partitions, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p8_found(s: SparkSession, d: str) -> DataFrame:
    return unify.same_looking_pairs(spread(table(s, d, "documents", "doc_id", "text")))


@query
def p8_texts(s: SparkSession, d: str) -> DataFrame:
    return unify.unify(spread(table(s, d, "documents", "doc_id", "text"))).select("doc_id", F.col("unified").alias("text"))


# ---------------------------------------------------------------- wrong encodings
def _blocks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "parsed_blocks", "document_id", "sequence", "text")


@query
def p4_found(s: SparkSession, d: str) -> DataFrame:
    return garble.find_garbled(_blocks(s, d)).select("document_id", "sequence").distinct()


@query
def p4_texts(s: SparkSession, d: str) -> DataFrame:
    return garble.find_garbled(_blocks(s, d))


# ---------------------------------------------------------------- sentences
def _paragraphs(s: SparkSession, d: str) -> DataFrame:
    """Paragraph blocks without garbled ones, each text once, with the language its document states."""
    b = table(s, d, "parsed_blocks", "document_id", "sequence", "block_type", "text").where("block_type = 'paragraph' AND text IS NOT NULL").drop("block_type").distinct()
    bad = garble.find_garbled(_blocks(s, d)).select("document_id", "sequence")
    lang = table(s, d, "parsed_documents", "document_id", "language").groupBy("document_id").agg(F.max("language").alias("language"))
    return b.join(bad, ["document_id", "sequence"], "left_anti").join(lang, "document_id", "left").repartition(shuffle_partitions(s))


@query
def p5_found(s: SparkSession, d: str) -> DataFrame:
    e = sentences.sentence_ends(_paragraphs(s, d))
    return e.select("document_id", "sequence", F.explode("ends").alias("end_char")).distinct()


@query
def p5_sentences(s: SparkSession, d: str) -> DataFrame:
    e = sentences.sentence_ends(_paragraphs(s, d)).select("document_id", "sequence", "text", "ends")
    x = e.select("document_id", "sequence", "text", "ends", F.posexplode("ends").alias("part", "end_char"))
    start = F.when(F.col("part") > 0, F.element_at("ends", F.greatest(F.col("part"), F.lit(1)))).otherwise(0)
    return x.select("document_id", "sequence", "part", F.ltrim(F.substring("text", start + 1, F.col("end_char") - start)).alias("sentence"))


# ---------------------------------------------------------------- leaked evaluation texts
@query
def p7_found(s: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(spread(table(s, d, "documents", "doc_id", "text")), table(s, d, "eval_items", "item_id", "passage", "language"))


@query
def p7_kept(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text").join(p7_found(s, d).select("doc_id").distinct(), "doc_id", "left_anti")


# ---------------------------------------------------------------- nearest vectors
@query
def p3_neighbours(s: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(s, d, "embedded_chunks", "chunk_id", "embedding", "indexed_at"))


@query
def p3_found(s: SparkSession, d: str) -> DataFrame:
    p = p3_neighbours(s, d)
    return p.select(F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b")).distinct()


# ---------------------------------------------------------------- near duplicates
@query
def p1_groups(s: SparkSession, d: str) -> DataFrame:
    return duplicates.near_duplicates(table(s, d, "embedded_chunks", "chunk_id", "content"), "chunk_id", "content")


@query
def p1_found(s: SparkSession, d: str) -> DataFrame:
    return duplicates.pairs_in_groups(p1_groups(s, d), "chunk_id")


# ---------------------------------------------------------------- scanned pages
def _pages(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "ocr_pages", "document_id", "page_number", "text", "confidence", "processing_time_ms"))


@query
def p2_found(s: SparkSession, d: str) -> DataFrame:
    return scans.find_noise(_pages(s, d))


@query
def p2_texts(s: SparkSession, d: str) -> DataFrame:
    return scans.repair(_pages(s, d))


# ---------------------------------------------------------------- containers
@query
def p6_containers(s: SparkSession, d: str) -> DataFrame:
    """The capacity is the largest max_tokens of the index profiles, 2048."""
    return packing.fill_containers(spread(table(s, d, "documents", "doc_id", "text")), 2048)


@query
def p6_fill(s: SparkSession, d: str) -> DataFrame:
    return p6_containers(s, d).groupBy("container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
