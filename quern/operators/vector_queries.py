"""Vector search and metadata queries, with their SQL. Queries are all rows whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import vectors as V
from quern.operators.orphans import uuid_key
from quern.plans import predicates as P
from quern.tables import table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding", "label")


def _queries(df: DataFrame) -> DataFrame:
    return df.where(F.col("vec_id") % 20 == 0)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    return V.top_k(df, _queries(df), 10, 0.6)


def vector_topk_strict(spark: SparkSession, d: str) -> DataFrame:
    """The default threshold of 0.7."""
    df = _vectors(spark, d)
    return V.top_k(df, _queries(df), 10, 0.7)


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    return V.top_k(df.where(P.compile_predicate({"$or": [{"label": 1}, {"label": 2}, {"label": 3}]})), _queries(df), 5, 0.5)


def vector_merge_sources(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    q = _queries(df)
    parts = {"code": V.top_k(df.where("label < 5"), q, 20, 0.5), "document": V.top_k(df.where("label >= 5"), q, 20, 0.5)}
    return V.merge_sources(parts, 20)


def vector_threshold_count(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d)
    return V.score_all(df, _queries(df), None, 0.55).groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))


def collection_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and dimensions of each collection (label): a search checks them against its query."""
    n = F.size("embedding")
    return _vectors(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(n).cast("long").alias("min_dims"), F.max(n).cast("long").alias("max_dims"))


_TREE = {"$and": [{"lang": {"$ne": "en"}}, {"chunk_index": {"$gte": 1}}, {"$or": [{"total_chunks": {"$lte": 3}}, {"collection_name": "kb_handbook"}]}]}


def metadata_predicate(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "chroma_entries", "chromadb_id", "collection_name", "chunk_index", "total_chunks", "lang")
    return df.where(P.compile_predicate(_TREE))


def document_type_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "document_type").where(P.document_types(["pdf", "docx"]))


def distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chroma_entries", "collection_name", "file_path", "deleted_at").where("deleted_at is null").select("collection_name", "file_path").distinct()


def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    live = F.col("deleted_at").isNull()
    return (
        table(spark, d, "chroma_entries", "collection_name", "chromadb_id", "deleted_at")
        .groupBy("collection_name")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(live).alias("n_live"), F.countDistinct("chromadb_id").alias("n_ids"))
    )


def repository_targets(spark: SparkSession, d: str) -> DataFrame:
    """Which repositories a search reaches when none is named, and what naming one gives."""
    state = F.when(F.col("status") == "ready", "search").when(F.col("status") == "error", "search with warning").otherwise("refuse")
    return table(spark, d, "repositories", "repo_name", "status").select(
        "repo_name", "status", state.alias("explicit"), F.coalesce(F.col("status").isin("ready", "error"), F.lit(False)).alias("implicit")
    )


def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repositories", "status", "file_count", "chunk_count").groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("file_count").alias("files"), F.sum("chunk_count").alias("chunks")
    )


def watch_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each watched folder that its include and exclude globs let through."""
    folders = table(spark, d, "watched_folders", "id", "folder_name", "enabled", "include_patterns", "exclude_patterns", "deleted_at").where("deleted_at is null and enabled")
    docs = table(spark, d, "documents", "doc_id", "source_id", "file_path")
    joined = docs.join(folders, uuid_key(docs["source_id"]) == uuid_key(folders["id"]))
    return joined.where(P.watched(F.col("file_path"), F.col("include_patterns"), F.col("exclude_patterns"))).select("doc_id", "folder_name")


def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """Search over the cells of an index that is fitted here."""
    df = _vectors(spark, d).select("vec_id", "embedding")
    return V.top_k_indexed(df, _queries(df), V.Cells.fit(df), 10, 0.6)


def vector_euclidean(spark: SparkSession, d: str) -> DataFrame:
    """Distances of the queries to the vectors of the ten ids behind theirs."""
    df = _vectors(spark, d)
    q = _queries(df).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    near = q.withColumn("vec_id", F.explode(F.sequence(F.col("query_id") + 1, F.col("query_id") + 10)))
    return near.join(df, "vec_id").select("query_id", "vec_id", F.round(V.euclidean(F.col("embedding"), F.col("_q")), 4).alias("distance"))


def vector_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.source_counts(vector_merge_sources(spark, d))


def search_projection(spark: SparkSession, d: str) -> DataFrame:
    """Index entries as search results, of other sources than these with metadata missing."""
    e = table(spark, d, "chroma_entries", "chromadb_id", "file_path", "collection_name", "chunk_index", "deleted_at").where("deleted_at is null")
    gone = F.pmod(F.col("chunk_index"), F.lit(3)) == 1
    rows = e.select(F.when(~gone, F.col("file_path")).alias("file_path"), F.col("collection_name").alias("repository"), F.when(~gone, F.col("chunk_index")).alias("chunk_index"), T.extension(F.col("file_path")).alias("file_extension"))
    return V.project_results(rows).groupBy("file_path", "language", "chunk_index").agg(F.count(F.lit(1)).alias("n"))


def language_filter(spark: SparkSession, d: str) -> DataFrame:
    """Files that searches for each of some languages look at; the last one is not known and keeps all."""
    f = table(spark, d, "file_inputs", "file_id", "path").withColumn("file_extension", T.extension(F.col("path")))
    parts = [f.where(P.language(x)).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("language"), "n") for x in ("Python", "typescript", "javascript", "markdown", "yaml", "klingon")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def provider_groups(spark: SparkSession, d: str) -> DataFrame:
    """Repositories by embedding space (made of their source and counts)."""
    r = table(spark, d, "repositories", "repo_name", "source", "file_count")
    g = V.provider_groups(r.select("repo_name", F.col("source").alias("provider"), F.lit("m").alias("model"), F.when(F.col("file_count") % 2 == 0, 64).otherwise(32).alias("dimensions")))
    return g.select("provider", "model", "dimensions", F.array_join("repositories", ",").alias("repositories"))


QUERIES = {
    "vector_index": vector_index,
    "vector_euclidean": vector_euclidean,
    "vector_source_counts": vector_source_counts,
    "search_projection": search_projection,
    "language_filter": language_filter,
    "provider_groups": provider_groups,
    "vector_topk": vector_topk,
    "vector_topk_strict": vector_topk_strict,
    "vector_topk_filtered": vector_topk_filtered,
    "vector_merge_sources": vector_merge_sources,
    "vector_threshold_count": vector_threshold_count,
    "collection_dimensions": collection_dimensions,
    "metadata_predicate": metadata_predicate,
    "document_type_filter": document_type_filter,
    "distinct_paths": distinct_paths,
    "collection_counts": collection_counts,
    "repository_targets": repository_targets,
    "registry_summary": registry_summary,
    "watch_filter": watch_filter,
}

_SIM = """sims AS (
  SELECT q.vec_id AS query_id, v.vec_id, v.label,
    round(greatest(0.0, least(1.0, (1 + list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) / 2)), 6) AS similarity
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"""


def _topk(where: str, k: int, threshold: float) -> str:
    return f"""WITH {_SIM} SELECT query_id, vec_id, similarity, label, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sims WHERE similarity >= {threshold} AND {where})
WHERE rank <= {k}"""


_GLOB = "'^' || replace(replace(replace(replace(replace(replace(regexp_replace(p, '([.+^$()|{{}}\\[\\]])', '\\\\\\1', 'g'), '**/', chr(1)), '**', chr(2)), '*', '[^/]*'), '?', '[^/]'), chr(1), '(.*/)?'), chr(2), '.*') || '$'"
_UUID = "lower(replace(replace(replace({c}, '{{', ''), '}}', ''), '-', ''))"

_LANG = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in exts)}) THEN '{lang}'" for lang, exts in T.LANGUAGE_EXTENSIONS.items()) + " END"
_EXT = r"lower(regexp_extract(regexp_replace(replace({c}, '\', '/'), '^(\./)+', ''), '[^/](\.[^./]*)$', 1))"

SQL = {
    "vector_euclidean": """SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS distance
FROM embeddings q JOIN embeddings v ON v.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 10 WHERE q.vec_id % 20 = 0""",
    "vector_source_counts": f"""WITH {_SIM}, tagged AS (SELECT *, CASE WHEN label < 5 THEN 'code' ELSE 'document' END AS source_type FROM sims WHERE similarity >= 0.5)
SELECT query_id, source_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, source_type, vec_id) AS rank FROM tagged) WHERE rank <= 20 GROUP BY query_id, source_type""",
    "search_projection": f"""SELECT CASE WHEN chunk_index % 3 = 1 THEN 'unknown' ELSE coalesce(file_path, 'unknown') END AS file_path, {_LANG} AS language, CAST(CASE WHEN chunk_index % 3 = 1 THEN 0 ELSE coalesce(chunk_index, 0) END AS INTEGER) AS chunk_index, count(*) AS n
FROM (SELECT *, {_EXT.format(c="file_path")} AS ext FROM chroma_entries WHERE deleted_at IS NULL) GROUP BY 1, 2, 3""",
    "language_filter": f"""WITH f AS (SELECT {_EXT.format(c="path")} AS ext FROM file_inputs), l AS (SELECT {_LANG} AS lang FROM f)
SELECT 'Python' AS language, count(*) FILTER (WHERE lang = 'python') AS n FROM l UNION ALL SELECT 'typescript', count(*) FILTER (WHERE lang = 'typescript') FROM l UNION ALL SELECT 'javascript', count(*) FILTER (WHERE lang = 'javascript') FROM l
UNION ALL SELECT 'markdown', count(*) FILTER (WHERE lang = 'markdown') FROM l UNION ALL SELECT 'yaml', count(*) FILTER (WHERE lang = 'yaml') FROM l UNION ALL SELECT 'klingon', count(*) FROM l""",
    "provider_groups": """SELECT source AS provider, 'm' AS model, CASE WHEN file_count % 2 = 0 THEN 64 ELSE 32 END AS dimensions, string_agg(repo_name, ',' ORDER BY repo_name) AS repositories FROM repositories GROUP BY 1, 2, 3""",
    "vector_topk": _topk("true", 10, 0.6),
    "vector_topk_strict": _topk("true", 10, 0.7),
    "vector_topk_filtered": _topk("label IN (1, 2, 3)", 5, 0.5),
    "vector_merge_sources": f"""WITH {_SIM}, tagged AS (
  SELECT *, CASE WHEN label < 5 THEN 'code' ELSE 'document' END AS source_type FROM sims WHERE similarity >= 0.5)
SELECT query_id, vec_id, similarity, label, source_type, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, source_type, vec_id) AS rank FROM tagged) WHERE rank <= 20""",
    "vector_threshold_count": f"WITH {_SIM} SELECT query_id, label, count(*) AS n FROM sims WHERE similarity >= 0.55 GROUP BY query_id, label",
    "collection_dimensions": "SELECT label, count(*) AS n, min(len(embedding)) AS min_dims, max(len(embedding)) AS max_dims FROM embeddings GROUP BY label",
    "metadata_predicate": """SELECT chromadb_id, collection_name, chunk_index, total_chunks, lang FROM chroma_entries
WHERE lang IS DISTINCT FROM 'en' AND chunk_index >= 1 AND (total_chunks <= 3 OR collection_name = 'kb_handbook')""",
    "document_type_filter": "SELECT doc_id, document_type FROM documents WHERE document_type IN ('pdf', 'docx')",
    "distinct_paths": "SELECT DISTINCT collection_name, file_path FROM chroma_entries WHERE deleted_at IS NULL",
    "collection_counts": """SELECT collection_name, count(*) AS n_rows, count(*) FILTER (WHERE deleted_at IS NULL) AS n_live, count(DISTINCT chromadb_id) AS n_ids
FROM chroma_entries GROUP BY collection_name""",
    "repository_targets": """SELECT repo_name, status, CASE status WHEN 'ready' THEN 'search' WHEN 'error' THEN 'search with warning' ELSE 'refuse' END AS explicit,
  coalesce(status IN ('ready', 'error'), false) AS implicit FROM repositories""",
    "registry_summary": "SELECT status, count(*) AS n, CAST(sum(file_count) AS BIGINT) AS files, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM repositories GROUP BY status",
    "watch_filter": f"""SELECT d.doc_id, f.folder_name FROM documents d JOIN watched_folders f ON {_UUID.format(c="d.source_id")} = {_UUID.format(c="f.id")}
WHERE f.deleted_at IS NULL AND f.enabled
  AND (f.include_patterns IS NULL OR len(f.include_patterns) = 0 OR len(list_filter(f.include_patterns, lambda p: regexp_matches(d.file_path, {_GLOB.format()}))) > 0)
  AND NOT coalesce(len(list_filter(f.exclude_patterns, lambda p: regexp_matches(d.file_path, {_GLOB.format()}))) > 0, false)""",
}
