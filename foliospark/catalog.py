"""The registered queries of the core and the SQL that gives the same rows.

Every query reads whole tables. Repeated rows of a key count once: the helpers below and the views of ``_VIEWS`` take
the same row of each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliospark.functions import ids, sentences, text, vectors
from foliospark.models import embed_column, hashing_embedder
from foliospark.operators import answers, changes, chunking, metadata, pages, search, versions
from foliospark.plans.answering import answer_questions, source_hits
from foliospark.session import latest, shuffle_partitions, spread, table
from foliospark.sources import files

Query = Callable[[SparkSession, str], DataFrame]
DIM = 64
PROFILE = "643395d7cd8a51fe"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_VIEWS = {
    "docs": "SELECT * FROM parsed_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST, status NULLS LAST, source_path NULLS LAST, md5_hash NULLS LAST) = 1",
    "vers": "SELECT * FROM file_versions QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY indexed_at DESC NULLS LAST, status NULLS LAST, md5_hash NULLS LAST) = 1",
    "jobs": "SELECT * FROM index_jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY completed_at DESC NULLS LAST, started_at DESC NULLS LAST, status NULLS LAST) = 1",
    "chunks": "SELECT * FROM embedded_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, md5(content) NULLS LAST) = 1",
    "blocks": "SELECT * FROM parsed_blocks QUALIFY row_number() OVER (PARTITION BY document_id, sequence ORDER BY md5(text) NULLS LAST, block_type NULLS LAST) = 1",
    "pages": "SELECT * FROM ocr_pages QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY processing_time_ms DESC NULLS LAST, md5(text) NULLS LAST) = 1",
}


def _first(name: str, keys: list[str], order: list, s: SparkSession, d: str, cols: tuple[str, ...]) -> DataFrame:
    df = latest(table(s, d, name), keys, order)
    return df.select(*cols) if cols else df


def _desc(c):
    return F.desc_nulls_last(c)


def _asc(c):
    return F.asc_nulls_last(c)


def docs(s, d, *cols):
    return _first("parsed_documents", ["document_id"], [_desc("updated_at"), _asc("status"), _asc("source_path"), _asc("md5_hash")], s, d, cols)


def vers(s, d, *cols):
    return _first("file_versions", ["version_id"], [_desc("indexed_at"), _asc("status"), _asc("md5_hash")], s, d, cols)


def jobs(s, d, *cols):
    return _first("index_jobs", ["job_id"], [_desc("completed_at"), _desc("started_at"), _asc("status")], s, d, cols)


def chunks(s, d, *cols):
    return _first("embedded_chunks", ["chunk_id"], [_desc("indexed_at"), F.md5("content").asc_nulls_last()], s, d, cols)


def blocks(s, d, *cols):
    return _first("parsed_blocks", ["document_id", "sequence"], [F.md5("text").asc_nulls_last(), _asc("block_type")], s, d, cols)


def scanned(s, d, *cols):
    return _first("ocr_pages", ["document_id", "page_number"], [_desc("processing_time_ms"), F.md5("text").asc_nulls_last()], s, d, cols)


_S = text.SPACE


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


_INJECTED = "(" + " OR ".join("regexp_matches(question, '" + p.replace("'", "''") + "')" for p in text.INJECTION_PATTERNS) + ")"


def query(sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Register a query; ``uses`` names the views its SQL needs."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            views = ", ".join(f"{v} AS ({_VIEWS[v]})" for v in uses.split())
            recursive = "RECURSIVE " if sql.startswith("WITH RECURSIVE ") else ""
            own = sql.removeprefix("WITH ").removeprefix("RECURSIVE ")
            SQL[f.__name__] = sql if not views else f"WITH {recursive}{views}" + (", " + own if sql.startswith("WITH ") else " " + own)
        return f

    return add


# ---------------------------------------------------------------- retrieval
# Stated query set: the vectors of `embeddings` whose vec_id is divisible by 100, against all chunks.
_USABLE = "len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_SCORED = """u AS MATERIALIZED (SELECT * FROM chunks WHERE {filter}),
scored AS (SELECT q.query_id, u.chunk_id, u.document_id, u.version_id, round(least(1.0, greatest(-1.0, list_dot_product(qe::DOUBLE[], u.embedding::DOUBLE[])
  / (sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[])) * sqrt(list_dot_product(u.embedding::DOUBLE[], u.embedding::DOUBLE[]))))), 6) AS score FROM q, u)"""
_STATED = "q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0)"
_HITS = f"{_STATED}, {_SCORED.format(filter=_USABLE)}"


def _queries(s, d):
    return table(s, d, "embeddings", "vec_id", "embedding").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {_HITS} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 10", "chunks")
def vector_topk(s, d):
    return search.exact_topk(_queries(s, d), chunks(s, d, F.col("chunk_id").alias("id"), "embedding"), 10, DIM).select("query_id", F.col("id").alias("chunk_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_HITS} SELECT query_id, chunk_id, score FROM scored WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 60", "chunks")
def vector_topk_threshold(s, d):
    return search.exact_topk(_queries(s, d), chunks(s, d, F.col("chunk_id").alias("id"), "embedding"), 60, DIM, 0.1).select("query_id", F.col("id").alias("chunk_id"), "score")


_PAYLOAD = {"file_type": ".pdf", "language": "en"}


@query(f"""WITH {_STATED}, {_SCORED.format(filter=_USABLE + " AND file_type = '.pdf' AND language = 'en'")}
SELECT query_id, chunk_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10""", "chunks")
def payload_filter_search(s, d):
    c = chunks(s, d).where(metadata.payload_filter(_PAYLOAD)).select(F.col("chunk_id").alias("id"), "embedding")
    return search.exact_topk(_queries(s, d), c, 10, DIM).select("query_id", F.col("id").alias("chunk_id"), "score")


_RETRIEVE = """top60 AS (SELECT * FROM scored WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 60),
live AS (SELECT t.* FROM top60 t WHERE EXISTS (SELECT 1 FROM docs a WHERE a.document_id = t.document_id AND a.active_version_id = t.version_id)),
quota AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) <= 3),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM quota QUALIFY rank <= 30)"""
_RETRIEVED = f"{_HITS}, {_RETRIEVE}"


def _retrieved(s, d):
    c = chunks(s, d, "chunk_id", "document_id", "version_id", "content", "page_number", "sheet_name", "slide_number", "section_title", "source_path", "embedding")
    return search.retrieve(_queries(s, d), c, docs(s, d, "document_id", "active_version_id"), DIM, 0.1)


@query(f"WITH {_RETRIEVED} SELECT query_id, document_id, chunk_id, score, rank FROM hits", "chunks docs")
def retrieve_active_quota(s, d):
    return _retrieved(s, d).select("query_id", "document_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_RETRIEVED} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS final_rank FROM hits QUALIFY final_rank <= 5", "chunks docs")
def rerank_fallback(s, d):
    return search.rerank(_retrieved(s, d), None, 5).select("query_id", "chunk_id", F.col("final_rank").cast("long").alias("final_rank"))


@query(f"WITH {_RETRIEVED} SELECT query_id, h.chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(round(1.0 / (1 + length(content)), 9), score) DESC, rank) AS final_rank FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id QUALIFY final_rank <= 5", "chunks docs")
def rerank_topk(s, d):
    score = F.round(F.lit(1.0) / (1 + F.length("content")), 9)
    return search.rerank(_retrieved(s, d), score, 5).select("query_id", "chunk_id", F.col("final_rank").cast("long").alias("final_rank"))


_COUNT = "CAST(floor(length(regexp_replace({0}, '[^가-힣]', '', 'g')) / 1.3::DOUBLE + (length({0}) - length(regexp_replace({0}, '[^가-힣]', '', 'g'))) / 4.0::DOUBLE) AS INT)"
_BLOCK = """'[SOURCE S' || rank || ']' || chr(10) || 'file: ' || coalesce(source_path, '') || chr(10) || 'location: ' || coalesce(nullif(concat_ws(', ', 'page ' || page_number, 'sheet ' || sheet_name, 'slide ' || slide_number), ''), 'N/A')
 || chr(10) || 'section: ' || coalesce(section_title, 'N/A') || chr(10) || 'content:' || chr(10) || coalesce(content, '') || chr(10) || '[/SOURCE S' || rank || ']'"""
_BLOCKS = f"{_RETRIEVED}, src AS (SELECT h.query_id, h.rank, {_BLOCK} AS block FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id), used AS (SELECT *, CAST(sum({_COUNT.format('block')}) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used_tokens FROM src)"


def _blocks_of_hits(s, d):
    block = answers.source_block(F.col("rank"), F.col("source_path"), F.col("page_number"), F.col("sheet_name"), F.col("slide_number"), F.col("section_title"), F.col("content"))
    return answers.within_budget(_retrieved(s, d).withColumn("block", block), "block", 1500)


@query(f"WITH {_BLOCKS} SELECT query_id, rank, used_tokens FROM used WHERE used_tokens <= 1500", "chunks docs")
def context_budget(s, d):
    return _blocks_of_hits(s, d).select("query_id", F.col("rank").cast("long").alias("rank"), "used_tokens")


@query(f"WITH {_BLOCKS} SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, CAST(count(*) AS INT) AS n_sources FROM used WHERE used_tokens <= 1500 GROUP BY query_id", "chunks docs")
def source_blocks(s, d):
    return answers.build_context(_blocks_of_hits(s, d), "block")


# The built-in embedder: character trigrams of the folded text, each adding 1 or -1 to one of 64 sums by its MD5.
_EMBEDDED = f"""items AS (SELECT item_id AS query_id, question FROM eval_items QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY md5(question) NULLS LAST) = 1),
folded AS (SELECT *, coalesce(nullif(lower({_sql_strip('question')}), ''), '(empty)') AS t FROM items),
grams AS (SELECT query_id, ('0x' || substr(md5(substr(t, i::INT, 3)), 1, 8))::BIGINT AS h FROM (SELECT *, unnest(generate_series(1, greatest(1, length(t) - 2))) AS i FROM folded)),
sums AS (SELECT query_id, h % 64 AS k, sum(CASE WHEN (h & 1024) <> 0 THEN 1 ELSE -1 END) AS x FROM grams GROUP BY ALL),
norms AS (SELECT query_id, CAST(sqrt(sum(x * x)) AS FLOAT) AS n FROM sums GROUP BY 1),
cells AS (SELECT f.query_id, k.k, coalesce(x, 0) AS x FROM folded f CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS k) k LEFT JOIN sums s ON s.query_id = f.query_id AND s.k = k.k),
vectors AS (SELECT query_id, list(CASE WHEN n > 0 THEN CAST(x AS FLOAT) / n ELSE CAST(0 AS FLOAT) END ORDER BY k) AS qe FROM cells JOIN norms USING (query_id) GROUP BY query_id),
asked AS (SELECT i.*, v.qe, CASE WHEN question IS NULL OR {_sql_strip('question')} = '' THEN 'empty' WHEN {_INJECTED} THEN 'rejected_security' WHEN len(list_filter(qe, lambda x: x <> 0)) = 0 THEN 'failed_retrieval' ELSE 'ok' END AS status FROM items i JOIN vectors v USING (query_id)),
q AS (SELECT query_id, qe FROM asked WHERE status = 'ok')"""
_BEST = "best AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) <= 5)"
_ANSWERED = f"""{_EMBEDDED}, {_SCORED.format(filter=_USABLE)}, {_RETRIEVE}, {_BEST},
src AS (SELECT b.query_id, b.rank, {_BLOCK} AS block, c.source_path, c.file_name, c.page_number, c.sheet_name, c.slide_number, c.section_title FROM best b JOIN chunks c ON c.chunk_id = b.chunk_id),
used AS (SELECT *, CAST(sum({_COUNT.format('block')}) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used_tokens FROM src),
ctx AS (SELECT query_id, count(*) AS n_hits, count(*) FILTER (used_tokens <= 3072) AS n_sources, string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (used_tokens <= 3072) AS context FROM used GROUP BY 1),
made AS (SELECT query_id, question, status, n_hits, coalesce(n_sources, 0) AS n_sources, context, greatest(1, len(list_distinct(regexp_extract_all(context, '\\[S(\\d+)\\]', 1)))) AS n FROM asked LEFT JOIN ctx USING (query_id)),
answered AS (SELECT query_id, n_sources::INT AS n_sources, CASE WHEN status <> 'ok' THEN status WHEN n_hits IS NULL THEN 'no_context' WHEN context IS NULL THEN 'insufficient_context' ELSE 'success' END AS status,
 '검색된 문서 근거에 기반한 답변입니다: ' || question || ' ' || array_to_string(list_transform(generate_series(1, n), lambda i: '[S' || i || ']'), ' ') AS answer FROM made),
parts AS (SELECT *, list_transform(regexp_extract_all(answer, '\\[S(\\d+)\\]', 1), lambda x: 'S' || x) AS marks FROM answered),
cited AS (SELECT query_id, status, n_sources, answer, list_sort(list_distinct(list_filter(marks, lambda x: list_contains(list_transform(generate_series(1, n_sources), lambda i: 'S' || i), x)))) AS valid,
 list_distinct(list_filter(marks, lambda x: NOT list_contains(list_transform(generate_series(1, n_sources), lambda i: 'S' || i), x))) AS invalid FROM parts)"""
_REFUSED = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in answers.REFUSALS.items()) + " END"


def _asked(s, d):
    items = latest(table(s, d, "eval_items", "item_id", "question"), ["item_id"], [F.md5("question").asc_nulls_last()])
    return items.select(F.col("item_id").alias("query_id"), "question", embed_column(F.col("question"), lambda: hashing_embedder(DIM)).alias("embedding"))


def _sources(s, d):
    return chunks(s, d, "chunk_id", "document_id", "version_id", "content", "page_number", "sheet_name", "slide_number", "section_title", "source_path", "file_name", "embedding")


@query(f"WITH {_ANSWERED} SELECT query_id, status, n_sources, coalesce({_REFUSED}, list_reduce(list_prepend(answer, invalid), lambda a, x: replace(a, '[' || x || ']', ''))) AS answer, CASE WHEN status = 'success' THEN array_to_string(valid, ',') ELSE '' END AS citations FROM cited", "chunks docs")
def answer_pipeline(s, d):
    """Every question of eval_items, as a vector of the library's own embedder."""
    a = answer_questions(_asked(s, d), _sources(s, d), docs(s, d, "document_id", "active_version_id"), DIM, 0.1)
    return a.withColumn("citations", F.array_join(F.array_sort("citations"), ","))


_LINE = """'[S' || rank || '] ' || coalesce(nullif(file_name, ''), list_last(string_split(source_path, '/')), '') || ' (' ||
 coalesce(nullif(concat_ws(', ', page_number || '페이지', CASE WHEN sheet_name <> '' THEN sheet_name || ' 시트' END, slide_number || ' 슬라이드'), ''), '위치 정보 없음') || ')' ||
 CASE WHEN coalesce(section_title, '') IN ('', '본문') THEN '' ELSE ', "' || section_title || '"' END"""


@query(f"WITH {_ANSWERED} SELECT src.query_id, 'S' || rank AS mark, {_LINE} AS line FROM src JOIN cited USING (query_id) WHERE list_contains(valid, 'S' || rank)", "chunks docs")
def citation_lines(s, d):
    """What each answer of ``answer_pipeline`` cites, as lines for a reader."""
    q, c, live = _asked(s, d), _sources(s, d), docs(s, d, "document_id", "active_version_id")
    hits = source_hits(q.withColumn("status", answers.question_status(F.col("question"))), c, live, DIM, 0.1)
    cited = answer_questions(q, c, live, DIM, 0.1).select("query_id", F.col("citations").alias("valid"))
    return answers.cited_sources(cited, hits).select("query_id", "mark", "line")


@query(f"WITH {_ANSWERED} SELECT query_id, md5('참고 문서 (Context):' || chr(10) || context || chr(10) || chr(10) || '질문 (Question): ' || question) AS prompt_md5 FROM made WHERE context IS NOT NULL", "chunks docs")
def prompt_assembly(s, d):
    q = _asked(s, d).withColumn("status", answers.question_status(F.col("question")))
    hits = source_hits(q, _sources(s, d), docs(s, d, "document_id", "active_version_id"), DIM, 0.1)
    block = answers.source_block(F.col("rank"), F.col("source_path"), F.col("page_number"), F.col("sheet_name"), F.col("slide_number"), F.col("section_title"), F.col("content"))
    context = answers.build_context(answers.within_budget(hits.withColumn("block", block), "block", 3072), "block")
    return context.join(q, "query_id").select("query_id", F.md5(answers.prompt(F.col("question"), F.col("context"))).alias("prompt_md5"))


# ---------------------------------------------------------------- vectors
@query(f"SELECT chunk_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first_value FROM chunks WHERE {_USABLE}", "chunks")
def l2_normalize(s, d):
    c = chunks(s, d, "chunk_id", "embedding").where(vectors.is_usable(F.col("embedding"), DIM))
    return c.select("chunk_id", F.round(vectors.l2_norm(F.col("embedding")), 4).alias("norm"), F.round(vectors.l2_normalize(F.col("embedding"))[0], 5).alias("first_value"))


@query(f"SELECT embedding_model, coalesce(len(embedding), -1)::INT AS dim, coalesce(len(embedding) = 64, false) AS dimension_ok, coalesce({_USABLE}, false) AS usable, count(*) AS n FROM chunks GROUP BY ALL", "chunks")
def dimension_check(s, d):
    e = F.col("embedding")
    c = chunks(s, d, "embedding_model", "embedding").select("embedding_model", F.coalesce(F.size(e), F.lit(-1)).alias("dim"), F.coalesce(F.size(e) == DIM, F.lit(False)).alias("dimension_ok"), vectors.is_usable(e, DIM).alias("usable"))
    return c.withColumn("dim", F.when(F.col("dim") < 0, -1).otherwise(F.col("dim"))).groupBy("embedding_model", "dim", "dimension_ok", "usable").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- changes
# Found: all paths but those of excluded documents; stored: every document with its active version.
_DIFF = f"""f AS (SELECT source_path, max(md5_hash) AS found_md5 FROM docs WHERE coalesce(status, '') NOT IN ('excluded', 'deleted') AND source_path IS NOT NULL GROUP BY 1),
st AS (SELECT d.source_path, d.document_id, CASE WHEN v.md5_hash IS NOT NULL THEN d.active_version_id END AS version_id, v.md5_hash AS stored_md5, v.index_profile_id AS p
  FROM docs d LEFT JOIN vers v ON v.version_id = d.active_version_id WHERE coalesce(d.status, '') NOT IN ('deleted', 'staging')),
diff AS (SELECT coalesce(f.source_path, st.source_path) AS source_path, st.document_id, stored_md5, found_md5,
  CASE WHEN st.document_id IS NULL THEN 'new' WHEN f.source_path IS NULL THEN 'deleted' WHEN version_id IS NULL THEN 'changed' WHEN found_md5 IS DISTINCT FROM stored_md5 THEN 'changed' WHEN p IS DISTINCT FROM '{PROFILE}' THEN 'reindex_required' ELSE 'unchanged' END AS change_type
  FROM f FULL JOIN st ON f.source_path = st.source_path)"""


def _diff(s, d):
    all_docs = docs(s, d, "document_id", "source_path", "md5_hash", "active_version_id", "status")
    found = all_docs.where("coalesce(status, '') NOT IN ('excluded', 'deleted') AND source_path IS NOT NULL").groupBy("source_path").agg(F.max("md5_hash").alias("md5_hash"))
    stored = changes.stored_state(all_docs.where("coalesce(status, '') <> 'staging'"), vers(s, d, "version_id", "md5_hash", "index_profile_id"))
    return changes.detect_changes(found, stored, PROFILE)


@query(f"WITH {_DIFF} SELECT source_path, document_id, change_type, stored_md5, found_md5 FROM diff", "docs vers")
def change_detection(s, d):
    return _diff(s, d).drop("reason")


@query(f"WITH {_DIFF} SELECT change_type, count(*) AS n FROM diff GROUP BY 1", "docs vers")
def change_summary(s, d):
    return changes.summarize_changes(_diff(s, d))


@query(f"WITH {_DIFF} SELECT source_path, change_type FROM diff WHERE change_type IN ('new', 'changed', 'reindex_required')", "docs vers")
def files_to_process(s, d):
    return changes.files_to_process(_diff(s, d)).select("source_path", "change_type")


@query("SELECT source_path FROM docs WHERE source_path IS NOT NULL EXCEPT SELECT source_path FROM docs WHERE coalesce(status, '') NOT IN ('excluded', 'deleted')", "docs")
def deleted_paths(s, d):
    a = docs(s, d, "source_path", "status")
    return a.where("source_path IS NOT NULL").select("source_path").distinct().join(a.where("coalesce(status, '') NOT IN ('excluded', 'deleted')"), "source_path", "left_anti")


# ---------------------------------------------------------------- metadata
@query("SELECT v.version_id, v.document_id, d.source_path, v.status FROM vers v JOIN docs d ON v.version_id = d.active_version_id", "docs vers")
def active_version_join(s, d):
    return metadata.active_versions(docs(s, d, "source_path", "active_version_id"), vers(s, d, "version_id", "document_id", "status")).select("version_id", "document_id", "source_path", "status")


@query("SELECT document_id, active_version_id FROM docs WHERE active_version_id IS NOT NULL", "docs")
def active_mapping(s, d):
    return metadata.active_mapping(docs(s, d, "document_id", "active_version_id"))


@query("SELECT status, count(*) AS n FROM docs GROUP BY 1", "docs")
def document_status_counts(s, d):
    return metadata.by_status(docs(s, d, "status"))


@query("SELECT status, count(*) AS n FROM vers GROUP BY 1", "vers")
def version_status_counts(s, d):
    return metadata.by_status(vers(s, d, "status"))


@query("SELECT coalesce(sum(chunk_count), 0)::BIGINT AS total_chunks FROM vers", "vers")
def total_chunks(s, d):
    return metadata.total_chunks(vers(s, d))


@query("SELECT job_id, job_type, status, epoch_us(started_at) AS started_us FROM jobs ORDER BY started_at DESC NULLS LAST, job_id LIMIT 10", "jobs")
def latest_jobs(s, d):
    return metadata.latest_jobs(jobs(s, d)).select("job_id", "job_type", "status", F.unix_micros("started_at").alias("started_us"))


@query("SELECT job_id, epoch_us(started_at) AS started_us FROM jobs WHERE job_type = 'manual' ORDER BY started_at DESC NULLS LAST, job_id LIMIT 10", "jobs")
def latest_jobs_by_type(s, d):
    return metadata.latest_jobs(jobs(s, d), 10, "manual").select("job_id", F.unix_micros("started_at").alias("started_us"))


@query("SELECT job_type, count(*) AS n, sum(new_count)::BIGINT AS new_files, sum(changed_count)::BIGINT AS changed_files, sum(deleted_count)::BIGINT AS deleted_files, count(*) FILTER (completed_at IS NULL) AS running FROM jobs GROUP BY 1", "jobs")
def job_summary(s, d):
    return jobs(s, d).groupBy("job_type").agg(F.count("*").alias("n"), F.sum("new_count").alias("new_files"), F.sum("changed_count").alias("changed_files"), F.sum("deleted_count").alias("deleted_files"), F.count_if(F.col("completed_at").isNull()).alias("running"))


@query("SELECT md5_hash, count(*) AS n_documents, min(document_id) AS first_document FROM docs WHERE md5_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1", "docs")
def duplicate_md5(s, d):
    return metadata.shared_hashes(docs(s, d))


@query("SELECT document_id, count(*) AS n_versions, max(chunk_count) AS most_chunks FROM vers GROUP BY 1", "vers")
def versions_per_document(s, d):
    return vers(s, d).groupBy("document_id").agg(F.count("*").alias("n_versions"), F.max("chunk_count").alias("most_chunks"))


# ---------------------------------------------------------------- versions
_SWAP = "sw AS (SELECT document_id, version_id FROM vers WHERE status <> 'failed' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC NULLS LAST, version_id) = 1)"


def _swaps(s, d):
    w = W.partitionBy("document_id").orderBy(_desc("created_at"), "version_id")
    return vers(s, d).where("status <> 'failed'").withColumn("r", F.row_number().over(w)).where("r = 1").select("document_id", "version_id")


@query(f"""WITH {_SWAP} SELECT v.version_id, CASE WHEN EXISTS (SELECT 1 FROM sw WHERE sw.version_id = v.version_id) THEN 'active'
 WHEN EXISTS (SELECT 1 FROM docs d JOIN sw ON sw.document_id = d.document_id WHERE d.active_version_id = v.version_id AND d.active_version_id <> sw.version_id) THEN 'deleted' ELSE status END AS status FROM vers v""", "docs vers")
def version_swap(s, d):
    return versions.activate(docs(s, d, "document_id", "active_version_id", "status"), vers(s, d), _swaps(s, d))[1].select("version_id", "status")


@query(f"WITH {_SWAP} SELECT d.document_id, coalesce(sw.version_id, d.active_version_id) AS active_version_id, CASE WHEN sw.version_id IS NOT NULL THEN 'active' ELSE status END AS status FROM docs d LEFT JOIN sw ON sw.document_id = d.document_id", "docs vers")
def activated_documents(s, d):
    return versions.activate(docs(s, d, "document_id", "active_version_id", "status"), vers(s, d), _swaps(s, d))[0]


@query("SELECT version_id, document_id FROM vers v WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.document_id = v.document_id AND d.status = 'failed')", "docs vers")
def cascade_delete(s, d):
    a = docs(s, d, "document_id", "status")
    return versions.delete_documents(a, vers(s, d, "version_id", "document_id"), a.where("status = 'failed'"))[1].select("version_id", "document_id")


@query("SELECT version_id, document_id FROM vers v WHERE EXISTS (SELECT 1 FROM docs d WHERE d.active_version_id = v.version_id)", "docs vers")
def cleanup_old_versions(s, d):
    return versions.clean_old_versions(docs(s, d, "document_id", "active_version_id"), vers(s, d, "version_id", "document_id"))


@query("SELECT d.document_id, coalesce(CASE WHEN f.document_id IS NOT NULL THEN 'failed' END, d.status) AS status, coalesce(f.error_message, d.error_message) AS error_message FROM docs d LEFT JOIN (SELECT document_id, max(error_message) AS error_message FROM vers WHERE status = 'failed' GROUP BY 1) f ON f.document_id = d.document_id", "docs vers")
def update_status_coalesce(s, d):
    failed = vers(s, d).where("status = 'failed'").groupBy("document_id").agg(F.max("error_message").alias("error_message")).withColumn("status", F.lit("failed"))
    return versions.update_known(docs(s, d, "document_id", "status", "error_message"), failed, "document_id")


@query(f"""WITH want AS (SELECT DISTINCT document_id, md5_hash, '{PROFILE}' AS index_profile_id FROM docs), old AS (SELECT document_id, md5_hash, index_profile_id, min(version_id) AS o FROM vers GROUP BY ALL)
SELECT w.document_id, w.md5_hash, o IS NOT NULL AS reused, coalesce(o, regexp_replace(md5(concat_ws('|', w.document_id, w.md5_hash, w.index_profile_id)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')) AS version_id
FROM want w LEFT JOIN old ON old.document_id = w.document_id AND old.md5_hash = w.md5_hash AND old.index_profile_id = w.index_profile_id""", "docs vers")
def pending_versions(s, d):
    want = docs(s, d, "document_id", "md5_hash").withColumn("index_profile_id", F.lit(PROFILE)).distinct()
    return versions.pending_versions(vers(s, d), want, F.lit(None)).select("document_id", "md5_hash", "reused", "version_id")


@query("SELECT DISTINCT document_id, version_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.document_id = c.document_id AND d.active_version_id = c.version_id)", "chunks docs")
def stale_chunk_versions(s, d):
    c = chunks(s, d, "document_id", "version_id").distinct()
    a = docs(s, d, "document_id", F.col("active_version_id").alias("version_id")).where("version_id IS NOT NULL")
    return c.join(a, ["document_id", "version_id"], "left_anti")


# ---------------------------------------------------------------- text
def _norm(x: str) -> str:
    x = f"nfc_normalize(regexp_replace({x}, '\\r\\n?', chr(10), 'g'))"
    for pattern, new in ((f"'{text.CONTROL}'", "''"), ("'[ \\t]+'", "' '"), ("'(?m)^[ \\t]+|[ \\t]+$'", "''"), ("'\\n{3,}'", "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, {pattern}, {new}, 'g')"
    return _sql_strip(x)


@query(f"SELECT doc_id, md5({_norm('text')}) AS hash, length({_norm('text')})::INT AS n FROM documents")
def normalize_text(s, d):
    t = spread(table(s, d, "documents", "doc_id", "text")).withColumn("t", text.normalize_text(F.col("text")))
    return t.select("doc_id", F.md5("t").alias("hash"), F.length("t").alias("n"))


@query(f"SELECT doc_id, {_COUNT.format('text')} AS tokens FROM documents")
def token_count(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@query(f"SELECT document_id, sequence, len(p)::INT AS n, p[1] AS first_part FROM (SELECT document_id, sequence, list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10) || chr(10)), lambda x: {_sql_strip('x')}), lambda x: length(x) > 0) AS p FROM blocks WHERE text IS NOT NULL)", "blocks")
def paragraph_split(s, d):
    p = text.paragraphs(F.col("text"))
    return blocks(s, d, "document_id", "sequence", "text").where("text IS NOT NULL").select("document_id", "sequence", F.size(p).alias("n"), F.get(p, F.lit(0)).alias("first_part"))


def _cells(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({x}, '|'), lambda y: {_sql_strip('y')}), lambda y: length(y) > 0), ' | ')"


@query(
    f"""SELECT document_id, sequence, CASE WHEN contains(text, '[Header]') OR contains(text, '[Row') OR len(l) < 2 OR NOT contains(l[1], '|') THEN text
 ELSE array_to_string(list_concat(['[Header] ' || {_cells('l[1]')}], list_transform(b, lambda x, i: '[Row ' || i || '] ' || {_cells('x')})), chr(10)) END AS linear
FROM (SELECT *, list_filter(l[2:], lambda x: NOT regexp_matches(x, '^[|{_S}:\\-]+$')) AS b FROM (SELECT document_id, sequence, text, list_filter(list_transform(string_split({_sql_strip('text')}, chr(10)), lambda x: {_sql_strip('x')}), lambda x: length(x) > 0) AS l FROM blocks WHERE block_type = 'table' AND text IS NOT NULL))""",
    "blocks",
)
def table_linearize(s, d):
    return blocks(s, d).where("block_type = 'table' AND text IS NOT NULL").select("document_id", "sequence", text.linearize_table(F.col("text")).alias("linear"))


def _paragraph_blocks(s, d):
    b = table(s, d, "parsed_blocks", "document_id", "sequence", "block_type", "text").repartition(shuffle_partitions(s), "document_id", "sequence")
    return latest(b, ["document_id", "sequence"], [F.md5("text").asc_nulls_last(), _asc("block_type")]).where("block_type = 'paragraph' AND text IS NOT NULL")


def _sql_pieces(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT document_id, sequence, md5(array_to_string(CASE WHEN len(p) > 0 THEN p WHEN length(t) > 0 THEN [t] ELSE [] END, chr(10))) AS pieces, (CASE WHEN len(p) > 0 THEN len(p) WHEN length(t) > 0 THEN 1 ELSE 0 END)::INT AS n
 FROM (SELECT document_id, sequence, {_sql_strip('text')} AS t, list_filter(list_transform(regexp_extract_all(text, '{p}', 1), lambda x: {_sql_strip('x')}), lambda x: length(x) > 0) AS p FROM blocks WHERE block_type = 'paragraph' AND text IS NOT NULL)"""


@query(_sql_pieces(sentences.JAPANESE), "blocks")
def sentence_split_ja(s, d):
    x = sentences.japanese(F.col("text"))
    return _paragraph_blocks(s, d).select("document_id", "sequence", F.md5(F.array_join(x, "\n")).alias("pieces"), F.size(x).alias("n"))


@query(_sql_pieces(sentences.KOREAN.replace(r"\s", "[\\t\\n\\f\\r\\x{0B} ]")), "blocks")
def sentence_split_ko(s, d):
    x = sentences.korean(F.col("text"), keep_tail=False)
    return _paragraph_blocks(s, d).select("document_id", "sequence", F.md5(F.array_join(x, "\n")).alias("pieces"), F.size(x).alias("n"))


_ABBREVIATIONS = ", ".join(f"'{x}'" for x in sentences.ENGLISH_ABBREVIATIONS)


@query(f"""WITH parts AS (SELECT document_id, sequence, unnest(l) AS part, generate_subscripts(l, 1) AS i
 FROM (SELECT document_id, sequence, string_split(regexp_replace(text, '([.?!]+)(\\s+|$)', '\\1\\2' || chr(1), 'g'), chr(1)) AS l FROM blocks WHERE block_type = 'paragraph' AND text IS NOT NULL)),
flags AS (SELECT *, {_sql_strip('part')} = '' OR regexp_replace(lower(regexp_extract({_sql_strip('part')}, '(\\S+)$', 1)), '[.!?]+$', '') IN ({_ABBREVIATIONS}) AS joined FROM parts),
groups AS (SELECT *, coalesce(sum((NOT joined)::INT) OVER (PARTITION BY document_id, sequence ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM flags),
texts AS (SELECT document_id, sequence, g, {_sql_strip("string_agg(part, '' ORDER BY i)")} AS sentence FROM groups GROUP BY ALL)
SELECT document_id, sequence, (row_number() OVER (PARTITION BY document_id, sequence ORDER BY g) - 1)::INT AS part, sentence FROM texts WHERE sentence <> ''""", "blocks")
def sentence_split_en(s, d):
    return _paragraph_blocks(s, d).select("document_id", "sequence", F.posexplode(sentences.english(F.col("text"))).alias("part", "sentence"))


@query("SELECT doc_id, (" + " + ".join("regexp_matches(coalesce(text, ''), '" + p.replace("'", "''") + "')::INT" for p in text.INJECTION_PATTERNS) + ")::INT AS n_patterns FROM documents")
def injection_detect(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", F.size(text.injection_matches(F.col("text"))).alias("n_patterns"))


@query("SELECT chunk_id, concat_ws(' | ', file_name, CASE WHEN page_number IS NOT NULL THEN 'page ' || page_number WHEN sheet_name IS NOT NULL THEN 'sheet ' || sheet_name WHEN slide_number IS NOT NULL THEN 'slide ' || slide_number END, section_title) AS location FROM chunks", "chunks")
def hit_location(s, d):
    c = chunks(s, d, "chunk_id", "file_name", "page_number", "sheet_name", "slide_number", "section_title")
    return c.select("chunk_id", text.hit_location(*[F.col(x) for x in c.columns[1:]]).alias("location"))


@query("SELECT document_id, sequence, coalesce(nullif(concat_ws(', ', 'page ' || page_number, 'sheet ' || sheet_name, 'slide ' || slide_number, CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') END), ''), 'unknown') AS location FROM blocks", "blocks")
def block_location(s, d):
    b = blocks(s, d, "document_id", "sequence", "page_number", "sheet_name", "slide_number", "section_path")
    return b.select("document_id", "sequence", text.block_location(F.col("page_number"), F.col("sheet_name"), F.col("slide_number"), F.col("section_path")).alias("location"))


_REFS = "list_distinct(list_transform(regexp_extract_all(a, '\\[S(\\d+)\\]', 1), lambda x: 'S' || x))"


@query(f"SELECT chunk_id, len({_REFS})::INT AS n_marks, contains(a, '[S7]') AS has_seven FROM (SELECT chunk_id, coalesce(content, '') || ' [S1] [S7] [S1] [S' || coalesce(chunk_index, 0) || ']' AS a FROM chunks)", "chunks")
def citation_extract(s, d):
    a = chunks(s, d, "chunk_id", "content", "chunk_index").withColumn("a", F.concat(F.coalesce("content", F.lit("")), F.lit(" [S1] [S7] [S1] [S"), F.coalesce("chunk_index", F.lit(0)).cast("string"), F.lit("]")))
    return a.select("chunk_id", F.size(text.citations(F.col("a"))).alias("n_marks"), F.array_contains(text.citations(F.col("a")), "S7").alias("has_seven"))


@query("SELECT chunk_id, replace(replace(coalesce(content, '') || ' [S1] x [S9] y [S01]', '[S9]', ''), '[S01]', '') AS cleaned, 2 AS n_invalid FROM chunks", "chunks")
def citation_clean(s, d):
    a = chunks(s, d, "chunk_id", "content").select("chunk_id", F.concat(F.coalesce("content", F.lit("")), F.lit(" [S1] x [S9] y [S01]")).alias("answer"), F.lit(3).alias("n_sources"))
    return answers.verify_citations(a).select("chunk_id", "cleaned", F.size("invalid").alias("n_invalid"))


@query("SELECT chunk_id, coalesce(nullif(concat_ws(', ', page_number || '페이지', CASE WHEN sheet_name <> '' THEN sheet_name || ' 시트' END, slide_number || ' 슬라이드'), ''), '위치 정보 없음') AS location FROM chunks", "chunks")
def citation_location(s, d):
    c = chunks(s, d, "chunk_id", "page_number", "sheet_name", "slide_number")
    return c.select("chunk_id", text.citation_location(F.col("page_number"), F.col("sheet_name"), F.col("slide_number")).alias("location"))


@query(f"SELECT document_id, count(*) AS n_texts, (sum(length(text)) + 2 * (count(*) - 1))::BIGINT AS n_chars FROM blocks WHERE text IS NOT NULL AND {_sql_strip('text')} <> '' GROUP BY 1", "blocks")
def text_content(s, d):
    """Size of the full text of every document: its texts that are not blank, with an empty line between."""
    b = blocks(s, d, "document_id", "sequence", "text").where(~text.is_blank(F.col("text")))
    return b.groupBy("document_id").agg(F.count("*").alias("n_texts"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("n_chars"))


@query("SELECT document_id, CASE WHEN starts_with(file_type, '.') THEN lower(file_type) ELSE '.' || lower(file_type) END AS extension FROM docs WHERE file_type IS NOT NULL", "docs")
def extension_normalize(s, d):
    return docs(s, d, "document_id", "file_type").where("file_type IS NOT NULL").select("document_id", text.normalize_extension(F.col("file_type")).alias("extension"))


@query("SELECT document_id, page_number, coalesce(confidence BETWEEN 0 AND 1 AND NOT isnan(confidence), true) AS valid FROM pages", "pages")
def score_validity(s, d):
    return scanned(s, d, "document_id", "page_number", "confidence").select("document_id", "page_number", text.is_score(F.col("confidence")).alias("valid"))


@query("SELECT document_id, sequence, coalesce(metadata['style'], 'none') AS style, len(list_distinct(list_concat(coalesce(map_keys(metadata), []), ['is_linearized_table'])))::INT AS n_keys FROM blocks", "blocks")
def metadata_merge(s, d):
    m = text.map_with(F.col("metadata"), F.create_map(F.lit("is_linearized_table"), F.lit("true")))
    return blocks(s, d, "document_id", "sequence", "metadata").select("document_id", "sequence", text.map_value(F.col("metadata"), "style", "none").alias("style"), F.size(m).alias("n_keys"))


@query("SELECT document_id, source_path, updated_at::VARCHAR IS NOT NULL AS has_time, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS updated FROM docs WHERE status = 'active'", "docs")
def documents_by_status(s, d):
    """Documents of a status, the latest first, with their time in ISO 8601."""
    x = metadata.listed(docs(s, d, "document_id", "source_path", "status", "updated_at"), "active", "updated_at")
    return x.select("document_id", "source_path", F.col("updated_at").isNotNull().alias("has_time"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("updated"))


@query("SELECT document_id, starts_with('/srv/docs/' || source_path, '/srv/docs/') AND NOT regexp_matches(source_path, '(^|/)\\.\\.(/|$)') AS contained FROM docs WHERE source_path IS NOT NULL", "docs")
def path_containment(s, d):
    """Whether a path, joined to a root and resolved, stays under it."""
    p = F.concat(F.lit("/srv/docs/"), F.col("source_path"))
    return docs(s, d, "document_id", "source_path").where("source_path IS NOT NULL").select("document_id", files.is_contained(p, "/srv/docs").alias("contained"))


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[{_S}]+'), lambda x: x <> ''))"


@query(f"SELECT item_id, round(CASE WHEN len(u) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(u) END, 6) AS similarity FROM (SELECT *, list_distinct(list_concat(a, b)) AS u FROM (SELECT item_id, {_words('question')} AS a, {_words('passage')} AS b FROM eval_items))")
def jaccard_similarity(s, d):
    return table(s, d, "eval_items", "item_id", "question", "passage").select("item_id", F.round(text.word_jaccard(F.col("question"), F.col("passage")), 6).alias("similarity"))


# ---------------------------------------------------------------- ids
@query("SELECT chunk_id, md5(content) AS content_md5 FROM chunks", "chunks")
def content_md5(s, d):
    return chunks(s, d, "chunk_id", "content").select("chunk_id", F.md5("content").alias("content_md5"))


@query("""SELECT chunk_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS made_id
FROM (SELECT chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws('/', document_id, version_id, chunk_index))) AS h FROM chunks)""", "chunks")
def chunk_uuid5(s, d):
    return chunks(s, d, "chunk_id", "document_id", "version_id", "chunk_index").select("chunk_id", ids.chunk_id(F.col("document_id"), F.col("version_id"), F.col("chunk_index")).alias("made_id"))


@query("""WITH p AS (SELECT index_profile_id, substr(sha256(concat_ws('|', target_tokens, overlap_tokens, max_tokens, 'True', embedding_model, vector_size, CASE WHEN normalize_vectors THEN 'True' ELSE 'False' END, 'parser_v1')), 1, 16) AS made_id FROM index_profiles)
SELECT p.made_id, count(*) AS n_versions FROM vers v JOIN p ON p.index_profile_id = v.index_profile_id GROUP BY 1""", "vers")
def index_profile_id(s, d):
    p = table(s, d, "index_profiles").dropDuplicates(["index_profile_id"])
    c = F.col
    p = p.select("index_profile_id", ids.index_profile_id(c("target_tokens"), c("overlap_tokens"), c("max_tokens"), F.lit(True), c("embedding_model"), c("vector_size"), c("normalize_vectors")).alias("made_id"))
    return vers(s, d, "version_id", "index_profile_id").join(p, "index_profile_id").groupBy("made_id").agg(F.count("*").alias("n_versions"))


# ---------------------------------------------------------------- chunking
@query("SELECT document_id, sequence, sum(c) OVER (PARTITION BY document_id ORDER BY sequence)::BIGINT AS page_group FROM (SELECT document_id, sequence, coalesce((b IS NOT NULL AND b IS DISTINCT FROM page_number)::INT, 0) AS c FROM (SELECT *, lag(page_number) OVER (PARTITION BY document_id ORDER BY sequence) AS b FROM blocks))", "blocks")
def page_groups(s, d):
    return chunking.page_groups(blocks(s, d, "document_id", "sequence", "page_number")).select("document_id", "sequence", "page_group")


# The chunker in SQL: cleaned blocks, sentences by language, page groups, and a fold with one step for each sentence.
_KO = sentences.KOREAN.replace(r"\s", "[\\t\\n\\f\\r\\x{0B} ]").replace("'", "''")
_KO_TAIL = r"""[.?!~。？！](?:[\t\n\f\r\x{0B} ]*[''"」』]*)?([^.?!~。？！]*)$"""


def _found(pattern: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(t, '{pattern}', 1), lambda x: {_sql_strip('x')}), lambda x: length(x) > 0)"


def _known(field: str, place: int, rows: str) -> str:
    return f"list_filter(list_transform({rows}, lambda x: x.{field}), lambda y: y IS NOT NULL)[{place}]"


def _joined(rows: str) -> str:
    return _sql_strip(f"array_to_string(list_transform({rows}, lambda x: x.text), chr(10))")


def _chunk(rows: str, number: str, group: str, content: str) -> str:
    return f"{{'page_group': {group}, 'page_number': {_known('page', 1, rows)}, 'sheet_name': {_known('sheet', 1, rows)}, 'slide_number': {_known('slide', 1, rows)}, 'section_title': {_known('title', -1, rows)}, 'chunk_no': {number}, 'content': {content}, 'token_count': {_COUNT.format(content)}}}"


_CHUNKED = f"""cells AS (SELECT b.*, d.language, list_filter(list_transform(string_split({_sql_strip('text')}, chr(10)), lambda x: {_sql_strip('x')}), lambda x: length(x) > 0) AS l FROM blocks b LEFT JOIN docs d ON d.document_id = b.document_id),
lined AS (SELECT * EXCLUDE (l, text), CASE WHEN block_type <> 'table' OR contains(text, '[Header]') OR contains(text, '[Row') OR len(l) < 2 OR NOT contains(l[1], '|') THEN text
  ELSE array_to_string(list_concat(['[Header] ' || {_cells('l[1]')}], list_transform(list_filter(l[2:], lambda x: NOT regexp_matches(x, '^[|{_S}:\\-]+$')), lambda x, i: '[Row ' || i || '] ' || {_cells('x')})), chr(10)) END AS text FROM cells),
cleaned AS (SELECT document_id, sequence, block_type, page_number, sheet_name, slide_number, section_path[-1] AS title, lower(substr(coalesce(language, 'ko'), 1, 2)) AS lang, {_norm('text')} AS t FROM lined),
full_text AS (SELECT * FROM cleaned WHERE {_sql_strip('t')} <> ''),
en_parts AS (SELECT document_id, sequence, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (SELECT *, string_split(regexp_replace(t, '([.?!]+)(\\s+|$)', '\\1\\2' || chr(1), 'g'), chr(1)) AS p FROM full_text WHERE lang = 'en')),
en_flags AS (SELECT *, {_sql_strip('part')} = '' OR regexp_replace(lower(regexp_extract({_sql_strip('part')}, '(\\S+)$', 1)), '[.!?]+$', '') IN ({', '.join(f"'{x}'" for x in sentences.ENGLISH_ABBREVIATIONS)}) AS joined FROM en_parts),
en_groups AS (SELECT *, coalesce(sum((NOT joined)::INT) OVER (PARTITION BY document_id, sequence ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM en_flags),
en AS (SELECT document_id, sequence, list(s ORDER BY g) FILTER (s <> '') AS p FROM (SELECT document_id, sequence, g, {_sql_strip("string_agg(part, '' ORDER BY i)")} AS s FROM en_groups GROUP BY ALL) GROUP BY 1, 2),
split AS (SELECT f.*, CASE WHEN block_type IN ('table', 'code', 'image') THEN [t] WHEN lang = 'en' THEN en.p
  WHEN lang = 'ja' THEN CASE WHEN len({_found(sentences.JAPANESE)}) > 0 THEN {_found(sentences.JAPANESE)} ELSE [{_sql_strip('t')}] END
  ELSE list_concat(CASE WHEN len({_found(_KO)}) > 0 THEN {_found(_KO)} ELSE [{_sql_strip('t')}] END, list_filter([{_sql_strip(f"regexp_extract(t, '{_KO_TAIL}', 1)")}], lambda x: x <> '')) END AS p
  FROM full_text f LEFT JOIN en ON en.document_id = f.document_id AND en.sequence = f.sequence),
one AS (SELECT document_id, sequence, page_number, sheet_name, slide_number, title, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM split),
numbered AS (SELECT *, row_number() OVER w - 1 AS n, lag(page_number) OVER w AS before FROM one WINDOW w AS (PARTITION BY document_id ORDER BY sequence, i)),
s AS MATERIALIZED (SELECT document_id, n, {{'page': page_number, 'sheet': sheet_name, 'slide': slide_number, 'title': title, 'text': text, 'tokens': {_COUNT.format('text')}}} AS sent, {_COUNT.format('text')} AS k,
  sum(coalesce((before IS NOT NULL AND before IS DISTINCT FROM page_number)::INT, 0)) OVER (PARTITION BY document_id ORDER BY n) AS g FROM numbered),
fold AS (
  SELECT document_id, -1::BIGINT AS n, -1::HUGEINT AS g, [sent][:0] AS held, 0::BIGINT AS total, 0 AS number, '' AS tail, [{_chunk('[sent]', '0', '0::HUGEINT', "''")}][:0] AS made FROM s WHERE n = 0
  UNION ALL
  SELECT document_id, n, g, list_append(held2, sent), CASE WHEN full_up THEN coalesce(list_sum(list_transform(held2, lambda y: y.tokens)), 0) ELSE total1 END + k, number1 + e2::INT, CASE WHEN e2 THEN right(c2, 240) ELSE tail1 END,
    list_concat(made1, CASE WHEN e2 THEN [{_chunk('held1', 'number1', 'g', 'c2')}] ELSE [] END)
  FROM (SELECT *, full_up AND c2 <> '' AND NOT ({_COUNT.format('c2')} < 50 AND number1 > 0) AS e2,
      CASE WHEN full_up THEN held1[len(held1) - len(list_filter(generate_series(1, len(held1)), lambda j: list_sum(list_transform(held1[j:], lambda y: y.tokens)) <= 60)) + 1:] ELSE held1 END AS held2
    FROM (SELECT *, len(held1) > 0 AND total1 + k > 512 AS full_up, CASE WHEN len(held1) > 0 AND total1 + k > 512 THEN {_joined('held1')} ELSE '' END AS c2
      FROM (SELECT *, CASE WHEN turn THEN CASE WHEN opens > 0 THEN [{{'page': NULL::INT, 'sheet': NULL::VARCHAR, 'slide': NULL::INT, 'title': NULL::VARCHAR, 'text': tail1, 'tokens': opens}}] ELSE [sent][:0] END ELSE held END AS held1, CASE WHEN turn THEN opens ELSE total END AS total1
        FROM (SELECT *, {_COUNT.format('tail1')} AS opens
          FROM (SELECT *, number + e1::INT AS number1, CASE WHEN e1 THEN right(c1, 240) ELSE tail END AS tail1, CASE WHEN e1 THEN [{_chunk('held', 'number', 'old_g', 'c1')}] ELSE [] END AS made1
            FROM (SELECT *, turn AND c1 <> '' AND NOT ({_COUNT.format('c1')} < 50 AND number > 0) AS e1
              FROM (SELECT f.document_id, s.n, s.g, f.g AS old_g, s.sent, s.k, f.held, f.total, f.number, f.tail, s.g <> f.g AS turn, CASE WHEN s.g <> f.g AND len(f.held) > 0 THEN {_joined('f.held')} ELSE '' END AS c1
                FROM fold f JOIN s ON s.document_id = f.document_id AND s.n = f.n + 1)))))))),
ends AS (SELECT document_id, g, held, number, {_joined('held')} AS c FROM fold QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC) = 1),
made AS (SELECT document_id, unnest(made, recursive := true) FROM fold UNION ALL
  SELECT document_id, unnest([{_chunk('held', 'number', 'g', 'c')}], recursive := true) FROM ends WHERE c <> '' AND NOT ({_COUNT.format('c')} < 50 AND number > 0)),
once AS (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY document_id, md5(content) ORDER BY page_group, chunk_no) = 1),
indexed AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_group, chunk_no) - 1 AS chunk_index FROM once)"""
_UUID5 = """concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12))"""


@query(f"""WITH RECURSIVE {_CHUNKED} SELECT document_id, page_group::BIGINT AS page_group, page_number, sheet_name, slide_number, section_title, chunk_no, content, token_count, chunk_index, {_UUID5} AS chunk_id
FROM (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws('/', document_id, '-', chunk_index))) AS h FROM indexed)""", "blocks docs")
def chunk_pack(s, d):
    b = blocks(s, d, "document_id", "sequence", "block_type", "text", "page_number", "sheet_name", "slide_number", "section_path").join(docs(s, d, "document_id", "language"), "document_id", "left")
    rows = chunking.block_sentences(chunking.clean_blocks(b))
    grouped = chunking.page_groups(rows.drop("sequence").withColumnRenamed("sentence_no", "sequence")).withColumnRenamed("sequence", "sentence_no")
    return chunking.finish_chunks(chunking.pack_sentences(grouped, across_groups=True))


@query("SELECT chunk_id, document_id, version_id, row_number() OVER (PARTITION BY document_id, version_id ORDER BY chunk_index, chunk_id) - 1 AS new_index FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY document_id, version_id, md5(content) ORDER BY chunk_index, chunk_id) = 1)", "chunks")
def chunk_dedupe(s, d):
    c = chunks(s, d, "chunk_id", "document_id", "version_id", "chunk_index", "content")
    once = c.withColumn("r", F.row_number().over(W.partitionBy("document_id", "version_id", F.md5("content")).orderBy("chunk_index", "chunk_id"))).where("r = 1")
    w = W.partitionBy("document_id", "version_id").orderBy("chunk_index", "chunk_id")
    return once.select("chunk_id", "document_id", "version_id", (F.row_number().over(w) - 1).cast("long").alias("new_index"))


# ---------------------------------------------------------------- scanned pages
@query(f"""WITH c AS (SELECT document_id, confidence, length({_sql_strip("coalesce(text, '')")}) AS n FROM pages),
g AS (SELECT document_id, count(*) AS n_pages, count(*) FILTER (n < 20) AS n_low, count(*) FILTER (n = 0) AS n_failed, round(avg(confidence) FILTER (confidence > 0), 9) AS mean_confidence FROM c GROUP BY 1)
SELECT *, CASE WHEN n_low = n_pages THEN 'required' WHEN n_low > 0 THEN 'partial' ELSE 'not_needed' END AS status, CASE WHEN n_failed = n_pages THEN 'failed' WHEN n_failed > 0 THEN 'partial_failed' ELSE 'completed' END AS outcome FROM g""", "pages")
def ocr_status(s, d):
    return pages.recognition_status(scanned(s, d, "document_id", "text", "confidence"))


_MERGED = f"""o AS (SELECT document_id, page_number, array_to_string(list_sort(list(DISTINCT text)), ' ') AS t FROM blocks WHERE page_number IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
j AS (SELECT p.document_id, p.page_number, p.text, CASE WHEN o.t IS NOT NULL THEN (SELECT CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END FROM (SELECT {_words('p.text')} AS a, {_words('o.t')} AS b)) END AS similarity
 FROM pages p LEFT JOIN o ON o.document_id = p.document_id AND o.page_number = p.page_number)"""


@query(f"""WITH {_MERGED} SELECT document_id, page_number, md5(text) AS text_md5, round(similarity, 6) AS similarity FROM j WHERE similarity IS NULL OR similarity <= 0.8""", "blocks pages")
def ocr_merge(s, d):
    m = pages.merge_recognized(blocks(s, d, "document_id", "page_number", "text"), scanned(s, d, "document_id", "page_number", "text"))
    return m.select("document_id", "page_number", F.md5("text").alias("text_md5"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_MERGED}, last AS (SELECT document_id, max(sequence) AS n FROM blocks GROUP BY 1)
SELECT document_id, sequence, block_type, page_number, md5(text) AS text_md5 FROM blocks UNION ALL
SELECT j.document_id, (coalesce(n, -1) + row_number() OVER (PARTITION BY j.document_id ORDER BY page_number))::INT, 'paragraph', page_number, md5(text) FROM j LEFT JOIN last ON last.document_id = j.document_id WHERE similarity IS NULL OR similarity <= 0.8""", "blocks pages")
def ocr_append(s, d):
    b = blocks(s, d, "document_id", "sequence", "block_type", "text", "page_number")
    m = pages.merge_recognized(b, scanned(s, d, "document_id", "page_number", "text"))
    return pages.append_recognized(b, m).select("document_id", "sequence", "block_type", "page_number", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- files
_SUSPECT = " ".join(f"WHEN contains(file_name, {'chr(0)' if x == chr(0) else chr(39) + x + chr(39)}) THEN 'suspicious'" for x in files.SUSPICIOUS if x != "\x00")
_NAME = f"CASE WHEN regexp_matches(file_name, '^[{_S}]|[{_S}]$') THEN 'whitespace' {_SUSPECT} WHEN upper(string_split(file_name, '.')[1]) IN ({', '.join(chr(39) + x + chr(39) for x in files.RESERVED)}) THEN 'reserved' END"


@query(f"SELECT document_id, {_NAME} AS problem FROM docs", "docs")
def filename_guard(s, d):
    return docs(s, d, "document_id", "file_name").select("document_id", files.name_problem(F.col("file_name")).alias("problem"))


@query(f"SELECT document_id, coalesce({_NAME}, CASE WHEN length(source_path) > 4096 THEN 'path_length' END, CASE WHEN file_size > 10485760 THEN 'size' END, CASE WHEN NOT coalesce(lower(regexp_extract(file_name, '(\\.[^.]+)$', 1)) IN ('.pdf', '.docx', '.txt', '.md'), false) THEN 'extension' END) AS problem FROM docs", "docs")
def file_admission(s, d):
    f = docs(s, d, "document_id", "file_name", "source_path", "file_size")
    return files.admit(f, [".pdf", ".docx", ".txt", ".md"], 10 * 1024 * 1024).select("document_id", "problem")
