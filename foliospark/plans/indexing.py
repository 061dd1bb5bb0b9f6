"""The indexing job: list, hash, compare, parse, clean, chunk, embed, stage, make current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions.ids import chunk_id, index_profile_id
from foliospark.models import Embedder, embed_column, hashing_embedder
from foliospark.operators import changes, chunking, versions
from foliospark.session import checkpointed
from foliospark.sources import files, parsers, store

DOCUMENTS = "document_id string, source_path string, file_name string, file_type string, file_size long, md5_hash string, modified_at timestamp, active_version_id string, status string, error_message string"
VERSIONS = "version_id string, document_id string, md5_hash string, index_profile_id string, chunk_count int, status string, error_message string"
JOBS = "job_type string, discovered long, new long, changed long, reindex_required long, deleted long, unchanged long, failed long, finished_at timestamp"


def profile_of(s: Settings):
    c, e = s.chunking, s.embedding
    return index_profile_id(F.lit(c.target_tokens), F.lit(c.overlap_tokens), F.lit(c.max_tokens), F.lit(c.preserve_page_boundary), F.lit(e.model_id), F.lit(e.vector_size), F.lit(e.normalize))


def state(spark: SparkSession, s: Settings, table: str, schema: str) -> DataFrame:
    return store.read_snapshot(spark, s.state, table) if store.current_snapshot(spark, s.state) else spark.createDataFrame([], schema)


def chunk_blocks(blocks: DataFrame, s: Settings) -> DataFrame:
    """Chunks of (document_id, language, sequence, block_type, text, page_number, section_path)."""
    c = s.chunking
    sentences = chunking.block_sentences(chunking.clean_blocks(blocks))
    grouped = chunking.page_groups(sentences.drop("sequence").withColumnRenamed("sentence_no", "sequence")).withColumnRenamed("sequence", "sentence_no") if c.preserve_page_boundary else sentences.withColumn("page_group", F.lit(0).cast("long"))
    return chunking.finish_chunks(chunking.pack_sentences(grouped, c.max_tokens, c.overlap_tokens, c.min_tokens, across_groups=True))


def run_indexing(spark: SparkSession, s: Settings, job_type: str = "manual", embedder: Callable[[], Embedder] | None = None, parse: dict[str, Callable[[bytes], list]] | None = None) -> dict[str, int]:
    """One run over the folder ``s.root``; returns the counts by kind of change. One file's failure stops no other.

    All files are read once to hash them; those to be processed are read once more to parse them, and a file whose hash is
    then another one fails in this run and is found again by the next. Blocks are written once. Chunks are staged under
    their version, counted, and only then made current; the chunks of replaced, failed and deleted versions are removed
    after that. ``embedder`` and ``parse`` replace the built-in models and parsers.
    """
    docs, vers = state(spark, s, "documents", DOCUMENTS), state(spark, s, "versions", VERSIONS)
    chunk_path, dim = f"{s.state}/chunks", s.embedding.vector_size
    listed = files.admit(files.list_files(spark, s.root, content=True), list(s.extensions), s.max_bytes).where("problem IS NULL").drop("problem")
    found = checkpointed(files.hash_files(listed).drop("content"))
    diff = checkpointed(changes.detect_changes(found, changes.stored_state(docs, vers), profile_of(s)))
    counts = {r["change_type"]: r["n"] for r in changes.summarize_changes(diff).collect()}

    work = changes.files_to_process(diff).select("source_path", F.col("document_id").alias("known_id"))
    todo = found.join(work, "source_path").withColumn("document_id", F.coalesce("known_id", F.md5("source_path"))).withColumn("index_profile_id", profile_of(s))
    todo = checkpointed(todo.withColumn("version_id", F.md5(F.concat_ws("|", "document_id", "md5_hash", "index_profile_id"))))
    ids = todo.select("document_id", "version_id")
    contents = files.list_files(spark, s.root, content=True).select("source_path", "file_type", "content").join(todo.select("source_path", "md5_hash"), "source_path")
    parsed = checkpointed(parsers.parse_files(contents, parse).join(todo.select("source_path", "document_id"), "source_path"))
    blocks = parsed.where("error IS NULL").select(
        "document_id", F.lit(None).cast("string").alias("language"), "sequence", "block_type", "text", "page_number",
        F.lit(None).cast("string").alias("sheet_name"), F.lit(None).cast("int").alias("slide_number"), "section_path",
    )
    chunks = chunk_blocks(blocks, s).join(ids, "document_id").withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("version_id"), F.col("chunk_index")))
    chunks = chunks.withColumn("embedding", embed_column(F.col("content"), embedder or (lambda: hashing_embedder(dim))))
    written = store.stage_chunks(chunks, chunk_path)
    if not store.staged_count_matches(spark, chunk_path, ids, written):
        raise RuntimeError("the staged chunks are not those that were written; nothing was made current")

    errors = parsed.where("error IS NOT NULL").select("document_id", F.col("error").alias("error_message"))
    made = store.read_chunks(spark, chunk_path, ids).groupBy("document_id", "version_id").agg(F.count("*").cast("int").alias("chunk_count")) if written else ids.limit(0).withColumn("chunk_count", F.lit(0))
    new_vers = todo.join(made, ["document_id", "version_id"], "left").join(errors, "document_id", "left").select(
        "version_id", "document_id", "md5_hash", "index_profile_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.when(F.col("chunk_count") > 0, "staging").otherwise("failed").alias("status"), F.when(F.col("chunk_count").isNull(), F.coalesce("error_message", F.lit("no text"))).alias("error_message"),
    )
    new_vers = checkpointed(new_vers)
    # A known document keeps its active version until the new one is made current; what else is known of it is renewed.
    before = docs.select("document_id", "active_version_id", F.col("status").alias("old_status"))
    new_docs = todo.join(new_vers.select("document_id", "error_message"), "document_id", "left").join(before, "document_id", "left").select(
        "document_id", "source_path", "file_name", "file_type", "file_size", "md5_hash", "modified_at", "active_version_id",
        F.when(F.col("error_message").isNotNull(), "failed").otherwise("staging").alias("status"), "error_message",
    )
    all_docs, all_vers = versions.upsert(docs, new_docs, ["document_id"]), versions.upsert(vers, new_vers, ["version_id"])
    all_docs, all_vers = versions.activate(all_docs, all_vers, new_vers.where("chunk_count > 0").select("document_id", "version_id"))
    gone = diff.where("change_type = 'deleted'").select("document_id")
    all_docs = versions.mark_deleted(all_docs, gone)
    all_vers = all_vers.join(gone.withColumn("__gone", F.lit(True)).distinct(), "document_id", "left").withColumn("status", F.when(F.col("__gone"), "deleted").otherwise(F.col("status"))).select(*vers.columns)
    failed = new_vers.where("chunk_count = 0").count()
    job = spark.range(1).select(
        F.lit(job_type).alias("job_type"), F.lit(sum(v for k, v in counts.items() if k != "deleted")).cast("long").alias("discovered"),
        *[F.lit(counts.get(k, 0)).cast("long").alias(k) for k in ("new", "changed", "reindex_required", "deleted", "unchanged")],
        F.lit(failed).cast("long").alias("failed"), F.current_timestamp().alias("finished_at"),
    )
    store.write_snapshot({"documents": all_docs, "versions": all_vers, "jobs": state(spark, s, "jobs", JOBS).unionByName(job)}, s.state)
    # Only after the new state is current: what no document names any more.
    now = store.read_snapshot(spark, s.state, "versions")
    touched = now.join(todo.select("document_id").unionByName(gone).distinct(), "document_id", "left_semi")
    store.remove_versions(spark, chunk_path, touched.where("status IN ('deleted', 'failed')"))
    return counts | {"failed": failed}


def rebuild(spark: SparkSession, s: Settings) -> dict[str, int]:
    """Forget all documents, versions, jobs and chunks, then index everything."""
    store.clear(spark, s.state)
    return run_indexing(spark, s, "rebuild")
