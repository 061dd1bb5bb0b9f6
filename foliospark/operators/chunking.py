"""Blocks to sentences to overlapping chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliospark.functions.ids import chunk_id
from foliospark.functions.sentences import split_sentences
from foliospark.functions.text import is_blank, linearize_table, normalize_text, token_count
from foliospark.session import shuffle_partitions

CHUNK_COLUMNS = "document_id string, page_group long, page_number int, sheet_name string, slide_number int, section_title string, chunk_no int, content string, token_count int"


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Tables linearized and texts cleaned; rows blank before or after that are dropped."""
    text = F.when(F.col("block_type") == "table", linearize_table(F.col("text"))).otherwise(F.col("text"))
    return blocks.withColumn("text", normalize_text(text)).where(~is_blank(F.col("text")))


def block_sentences(blocks: DataFrame, language: str = "language") -> DataFrame:
    """One row for each sentence, numbered from 0 within the document; tables, code and images stay whole."""
    whole = F.col("block_type").isin("table", "code", "image")
    parts = F.when(whole, F.array("text")).otherwise(split_sentences(F.col("text"), F.col(language)))
    # One partitioning serves the splitting and the windows by document; its number is not taken from the small input.
    rows = blocks.repartition(shuffle_partitions(blocks.sparkSession), "document_id").select(*[c for c in blocks.columns if c != "text"], F.posexplode(parts).alias("part", "text"))
    w = W.partitionBy("document_id").orderBy("sequence", "part")
    return rows.withColumn("sentence_no", F.row_number().over(w) - 1)


def page_groups(blocks: DataFrame) -> DataFrame:
    """``page_group``: counts from 0 and grows where the previous page is known and differs from this one."""
    w = W.partitionBy("document_id").orderBy("sequence")
    before = F.lag("page_number").over(w)
    change = (before.isNotNull() & ~before.eqNullSafe(F.col("page_number"))).cast("int")
    return blocks.withColumn("__c", change).withColumn("page_group", F.sum("__c").over(w)).drop("__c")


def pack_sentences(sentences: DataFrame, max_tokens: int = 512, overlap_tokens: int = 60, min_tokens: int = 50, across_groups: bool = False) -> DataFrame:
    """Greedy chunks of the sentences of each page group, in order, with an overlap of whole sentences.

    A chunk closes when the next sentence would pass ``max_tokens``; a longer sentence stands alone. Chunks below
    ``min_tokens`` are dropped unless they are the group's first. Page, sheet and slide are the first known of a chunk,
    the section is the last. Needs (document_id, page_group, page_number, section_path, sentence_no, text) and takes
    sheet_name and slide_number if there; null text counts as empty. The state of the fold is one open chunk, so the rows
    stream through sorted partitions and a hot document is never held whole.

    With ``across_groups`` a page group opens with the last ``overlap_tokens * 4`` characters of the chunk before it,
    without page and section, and ``chunk_no`` counts over the whole document, as does the exception for the first. What
    a page group opens with is known only when the one before it is done, so a document is then one stream.
    """
    known = [c if c in sentences.columns else F.lit(None).cast(t).alias(c) for c, t in (("sheet_name", "string"), ("slide_number", "int"))]
    rows = sentences.select("document_id", "page_group", "sentence_no", "page_number", *known, F.try_element_at("section_path", F.lit(-1)).alias("section_title"), F.coalesce("text", F.lit("")).alias("text"), token_count(F.col("text")).alias("tokens"))
    ordered = rows.repartition(*(["document_id"] if across_groups else ["document_id", "page_group"])).sortWithinPartitions("document_id", "page_group", "sentence_no")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, total, number, tail = None, [], 0, 0, ""  # held: (page, sheet, slide, title, text, tokens)

        def close(out: list) -> None:
            nonlocal number, tail
            content = "\n".join(x[4] for x in held).strip()
            count = tokens_of(content)
            if content and not (count < min_tokens and number > 0):
                first = [next((x[i] for x in held if x[i] is not None), None) for i in range(3)]
                title = next((x[3] for x in reversed(held) if x[3] is not None), None)
                out.append((*key, *first, title, number, content, count))
                number += 1
                tail = content[-overlap_tokens * 4 :] if across_groups and overlap_tokens > 0 else ""

        for pdf in batches:
            out: list = []
            pages, slides = ([None if pd.isna(x) else int(x) for x in pdf[c]] for c in ("page_number", "slide_number"))
            for doc, group, page, sheet, slide, title, text, tokens in zip(pdf["document_id"], pdf["page_group"], pages, pdf["sheet_name"], slides, pdf["section_title"], pdf["text"], pdf["tokens"]):
                if key != (doc, group):
                    if held:
                        close(out)
                    if not across_groups or key is None or key[0] != doc:
                        number, tail = 0, ""
                    key, held, total = (doc, group), [], tokens_of(tail)
                    if total > 0:
                        held.append((None, None, None, None, tail, total))
                if held and total + tokens > max_tokens:
                    close(out)
                    kept, size = [], 0
                    for x in reversed(held):
                        if size + x[5] > overlap_tokens:
                            break
                        kept.insert(0, x)
                        size += x[5]
                    held, total = kept, size
                held.append((page, sheet, slide, title, text, tokens))
                total += tokens
            if out:
                yield _frame(out)
        if held:
            out = []
            close(out)
            if out:
                yield _frame(out)

    return ordered.mapInPandas(pack, CHUNK_COLUMNS)


def tokens_of(text: str) -> int:
    hangul = sum("가" <= ch <= "힣" for ch in text)
    return int(hangul / 1.3 + (len(text) - hangul) / 4.0)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNK_COLUMNS.split(", ")])
    return out.astype({"page_number": "Int32", "slide_number": "Int32", "page_group": "int64", "chunk_no": "int32", "token_count": "int32"})


def finish_chunks(chunks: DataFrame) -> DataFrame:
    """The first of equal contents of a document, numbered from 0, with a stable ``chunk_id``."""
    key = W.partitionBy("document_id", F.md5("content")).orderBy("page_group", "chunk_no")
    once = chunks.withColumn("__r", F.row_number().over(key)).where("__r = 1").drop("__r")
    index = F.row_number().over(W.partitionBy("document_id").orderBy("page_group", "chunk_no")) - 1
    return once.withColumn("chunk_index", index).withColumn("chunk_id", chunk_id(F.col("document_id"), F.lit("-"), F.col("chunk_index")))
