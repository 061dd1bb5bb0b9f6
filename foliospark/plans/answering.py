"""Answering a table of questions: screening, search, rerank, context, answer, citation check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.vectors import is_usable
from foliospark.models import Reranker, rerank_column
from foliospark.operators import answers, search
from foliospark.session import checkpointed


def source_hits(questions: DataFrame, chunks: DataFrame, active: DataFrame, dim: int, minimum: float = 0.25, top: int = 5, reranker: Callable[[], Reranker] | None = None) -> DataFrame:
    """The best ``top`` hits of each question that is not refused, numbered from 1 in ``rank``."""
    hits = search.retrieve(questions.where("status = 'ok'").select("query_id", "embedding"), chunks, active, dim, minimum)
    score = None
    if reranker is not None:
        hits = hits.join(questions.select("query_id", "question"), "query_id")
        score = rerank_column(F.col("question"), F.col("content"), reranker)
    return search.rerank(hits, score, top).drop("rank", "question").withColumnRenamed("final_rank", "rank")


def answer_questions(
    questions: DataFrame, chunks: DataFrame, active: DataFrame, dim: int, minimum: float = 0.25, top: int = 5, budget: int = 3072,
    reranker: Callable[[], Reranker] | None = None, generator: Callable[[], answers.Generator] | None = None,
) -> DataFrame:
    """(query_id, status, answer, citations, n_sources) for (query_id, question, embedding); one row for each question.

    Status is empty, rejected_security, failed_retrieval (no usable vector), no_context (no hits), insufficient_context
    (no hit within the budget), failed_generation (the model failed) or success; where it is not success the answer is the
    fixed text of ``answers.REFUSALS``. Refused questions are not searched for. Without a generator the answer is the
    offline model's formula. Hits are bounded by ``top`` a question and are written once.
    """
    q = questions.withColumn("status", answers.question_status(F.col("question")))
    q = q.withColumn("status", F.when((F.col("status") == "ok") & ~is_usable(F.col("embedding"), dim), "failed_retrieval").otherwise(F.col("status")))
    hits = checkpointed(source_hits(q, chunks, active, dim, minimum, top, reranker))
    block = answers.source_block(F.col("rank"), F.col("source_path"), F.col("page_number"), F.col("sheet_name"), F.col("slide_number"), F.col("section_title"), F.col("content"))
    used = hits.withColumn("block", block)
    found = used.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    a = q.select("query_id", "question", "status").join(found, "query_id", "left").join(answers.build_context(answers.within_budget(used, "block", budget), "block"), "query_id", "left")
    if generator is None:
        a = a.withColumn("answer", F.when(F.col("context").isNotNull(), answers.dummy_answer(F.col("question"), F.col("context")))).withColumn("error", F.lit(None).cast("string"))
    else:
        a = a.withColumn("made", answers.generated(F.col("question"), F.col("context"), generator)).withColumn("answer", F.col("made.answer")).withColumn("error", F.col("made.error"))
    a = answers.verify_citations(a)
    status = (
        F.when(F.col("status") != "ok", F.col("status")).when(F.col("n_hits").isNull(), "no_context").when(F.col("context").isNull(), "insufficient_context")
        .when(F.col("error").isNotNull() | F.col("answer").isNull(), "failed_generation").otherwise("success")
    )
    refusals = F.create_map(*[F.lit(x) for pair in answers.REFUSALS.items() for x in pair])
    return a.withColumn("status", status).select(
        "query_id", "status", F.coalesce(F.try_element_at(refusals, F.col("status")), "cleaned").alias("answer"),
        F.when(F.col("status") == "success", F.col("valid")).otherwise(F.array().cast("array<string>")).alias("citations"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
    )
