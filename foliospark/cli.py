"""Command line: scan, rebuild, status, ask, validate-config."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliospark.config import load_settings
from foliospark.models import embed_column, hashing_embedder
from foliospark.operators.metadata import by_status
from foliospark.plans.answering import answer_questions
from foliospark.plans.indexing import rebuild
from foliospark.sources import store
from foliospark.streaming.schedule import run_once


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliospark")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "rebuild", "status", "validate-config"):
        sub.add_parser(name)
    sub.add_parser("ask").add_argument("question")
    a = p.parse_args(argv)
    s = load_settings(a.config)
    if a.command == "validate-config":
        print(s)
        return 0
    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    if a.command == "scan":
        print(run_once(spark, s))
    elif a.command == "rebuild":
        print(rebuild(spark, s))
    elif store.current_snapshot(spark, s.state) is None:
        print("nothing is indexed yet")
        return 1
    elif a.command == "status":
        by_status(store.read_snapshot(spark, s.state, "documents")).show()
    else:
        docs = store.read_snapshot(spark, s.state, "documents")
        chunks = spark.read.parquet(f"{s.state}/chunks").join(docs.select("document_id", "source_path", "file_name"), "document_id")
        dim = s.embedding.vector_size
        q = spark.createDataFrame([(1, a.question)], "query_id long, question string").withColumn("embedding", embed_column(F.col("question"), lambda: hashing_embedder(dim)))
        r = s.retrieval
        for row in answer_questions(q, chunks, docs, dim, r.minimum_score, r.final_top_k).collect():
            print(row["status"], row["answer"], row["citations"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
