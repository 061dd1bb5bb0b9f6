"""Exact vector search for a stated set of queries, and what follows it: active filter, quota, cut, rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliospark.functions.vectors import is_usable

QUERY_BLOCK = 2048


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, dim: int, minimum: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows of ``corpus`` with the highest cosine to each query.

    ``queries`` has (query_id, embedding), ``corpus`` (id, embedding). Scores are rounded to 6 places, clamped to
    [-1, 1] and, where ``minimum`` is given, not below it; ties go to the smaller id. Unusable vectors (null, wrong
    length, not finite, all zero) take no part; other columns do not matter; an empty side gives no rows.

    Queries go to the executors in blocks of at most ``block`` vectors (``block * dim * 8`` bytes each, the only thing
    broadcast); each block is one pass of matrix products over the corpus, and every task keeps k rows a query before
    the shuffle.
    """
    spark = corpus.sparkSession
    q = queries.where(is_usable(F.col("embedding"), dim)).select("query_id", "embedding")
    c = corpus.where(is_usable(F.col("embedding"), dim)).select("id", "embedding")
    n = q.count()
    parts = []
    blocks = max(1, -(-2 * n // block))
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        if len(rows):
            parts.append(_search_block(spark, rows, c, k, minimum))
    schema = f"query_id {dict(q.dtypes)['query_id']}, id {dict(c.dtypes)['id']}, score double"
    found = spark.createDataFrame([], schema)
    for p in parts:
        found = found.unionByName(p)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search_block(spark, rows: pd.DataFrame, corpus: DataFrame, k: int, minimum: float | None) -> DataFrame:
    m = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    sent = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), m / np.linalg.norm(m, axis=1, keepdims=True)))
    schema = f"query_id {'string' if rows['query_id'].dtype == object else 'long'}, id {dict(corpus.dtypes)['id']}, score double"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, dtype=object))] * len(ids)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            s = np.round(np.clip(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, -1, 1), 6)
            own = pdf["id"].to_numpy()
            for i in range(len(ids)):
                take = np.flatnonzero(s[i] >= (-2 if minimum is None else minimum))
                if len(take) > k:
                    least = np.partition(s[i][take], len(take) - k)[len(take) - k]
                    take = take[s[i][take] >= least]
                score, at = np.concatenate([best[i][0], s[i][take]]), np.concatenate([best[i][1], own[take]])
                order = np.lexsort((at, -score))[:k]
                best[i] = (score[order], at[order])
        for i, (score, at) in enumerate(best):
            if len(score):
                yield pd.DataFrame({"query_id": ids[i], "id": at, "score": score})

    return corpus.mapInPandas(search, schema)


def active_only(hits: DataFrame, active: DataFrame) -> DataFrame:
    """Hits whose (document_id, version_id) is a document's active version. Spark broadcasts the smaller side if small."""
    keys = active.select("document_id", F.col("active_version_id").alias("version_id")).where("version_id IS NOT NULL").distinct()
    return hits.join(keys, ["document_id", "version_id"], "left_semi")


def quota_and_cut(hits: DataFrame, per_document: int = 3, limit: int = 30, tie: str = "chunk_id") -> DataFrame:
    """At most ``per_document`` hits of a document, then the best ``limit`` of each query, numbered from 1 in ``rank``."""
    order = [F.desc("score"), F.col(tie)]
    kept = hits.withColumn("__d", F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(*order))).where(F.col("__d") <= per_document)
    return kept.drop("__d", "rank").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)


def retrieve(queries: DataFrame, chunks: DataFrame, active: DataFrame, dim: int, minimum: float = 0.25, candidates: int = 30, per_document: int = 3) -> DataFrame:
    """Search with twice the candidates, then threshold, active versions, quota and cut, in that order.

    Stale versions use up places before they are dropped; that is the defined order of steps.
    """
    found = exact_topk(queries, chunks.withColumnRenamed("chunk_id", "id"), 2 * candidates, dim, minimum)
    hits = chunks.drop("embedding").join(found.withColumnRenamed("id", "chunk_id"), "chunk_id")
    return quota_and_cut(active_only(hits, active), per_document, candidates)


def rerank(hits: DataFrame, rerank_score: Column | None, top: int = 5) -> DataFrame:
    """The best ``top`` by rerank score, or by search score where that is null or not given; ties keep their rank."""
    score = F.coalesce(rerank_score, F.col("score")) if rerank_score is not None else F.col("score")
    w = W.partitionBy("query_id").orderBy(F.desc("final_score"), "rank")
    return hits.withColumn("final_score", score).withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= top)
