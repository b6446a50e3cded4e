"""Scalar functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.maintenance import change_kinds as change_kinds_of
from quern.tables import table


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), F.char_length("text").cast("long").alias("n_code_points"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Files with their hash and whether the stored one is right."""
    h = T.content_hash(F.col("content"))
    return table(spark, d, "file_inputs", "file_id", "content", "hash").select("file_id", h.alias("content_hash"), (h == F.col("hash")).alias("matches"))


def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def language_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_inputs", "path").groupBy(T.detect_language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Name-like tokens that prose mentions, with the number of documents."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return (
        docs.select("doc_id", F.explode(T.identifier_tokens(F.col("text"))).alias("token"))
        .where(T.looks_like_identifier(F.col("token")))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


def duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return docs.groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def node_ids(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "file_inputs", "file_id", "repository", "path")
    path = T.posix(F.col("path"))
    return files.select("file_id", T.node_id("File", F.col("repository"), path).alias("node_id"), T.display_name(path).alias("name"), T.package_of(path).alias("package"), T.module_of(path).alias("module"), F.substring(T.extension(F.col("path")), 2, 20).alias("extension"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stored entries taken apart and put together again: collection, path, index."""
    e = table(spark, d, "chroma_entries", "chromadb_id", "collection_name", "file_path", "chunk_index")
    p = T.parse_table_id(F.col("chromadb_id"))
    return e.select("chromadb_id", p["repository"].alias("repository"), p["path"].alias("path"), p["index"].alias("index"), (T.chunk_id(F.col("collection_name"), F.col("file_path"), F.col("chunk_index")) == F.col("chromadb_id")).alias("same"))


def collection_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repositories", "repo_name", "collection_name").select("repo_name", T.collection_name(F.col("repo_name")).alias("collection"), (T.collection_name(F.col("repo_name")) == F.col("collection_name")).alias("same"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words and sentences of each document, and whether the stored word count is right."""
    docs = table(spark, d, "documents", "doc_id", "text", "word_count")
    n = F.regexp_count("text", F.lit(r"[^ \t\r\n]+"))
    return docs.select("doc_id", n.cast("long").alias("n_words"), (n == F.col("word_count")).alias("same"))


def text_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Words, sentences, lines and escaped titles of the documents."""
    docs = table(spark, d, "documents", "doc_id", "text", "title", "file_size_bytes")
    return docs.select(
        "doc_id",
        F.when(F.col("text").isNotNull(), F.size(T.words(F.col("text")))).cast("long").alias("n_words"),
        F.when(F.col("text").isNotNull(), F.size(T.sentences(F.col("text")))).cast("long").alias("n_sentences"),
        F.regexp_count(T.normalize_line_ends(F.col("text")), F.lit("\n")).cast("long").alias("n_line_ends"),
        T.anchor_slug(F.col("title")).alias("slug"), T.escape_cell(F.col("title")).alias("cell"), T.unescape_cell(T.escape_cell(F.col("title"))).alias("back"), T.csv_cell(F.concat("title", F.lit(', "x"'))).alias("csv"),
        T.elapsed(F.col("file_size_bytes") * 1000).alias("elapsed"),
    )


def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    """Targets of double-bracket links made of titles, with and without a label."""
    docs = table(spark, d, "documents", "doc_id", "title").where("title is not null")
    made = F.concat(F.lit("see [["), "title", F.lit("]] and [["), "title", F.lit(" | label]]"))
    return docs.select("doc_id", F.array_join(T.wikilinks(made), "|").alias("targets"))


def url_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Whether repositories' places are external addresses, and what imports of them would be."""
    r = table(spark, d, "repositories", "repo_name", "url", "local_path")
    place = F.coalesce("url", "local_path")
    return r.select("repo_name", T.is_external_url(place).alias("external"), T.is_external_package(place).alias("package"))


def change_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of a commit comparison."""
    named = F.create_map(*[F.lit(x) for kv in {"signup": "A", "purchase": "R100", "error": "removed", "view": "Copied", "click": "T"}.items() for x in kv])
    return change_kinds_of(table(spark, d, "events", "event_type").select(named[F.col("event_type")].alias("status"))).groupBy("status", "change").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "text_shapes": text_shapes,
    "wiki_links": wiki_links,
    "url_kinds": url_kinds,
    "change_kinds": change_kinds,
    "token_estimate": token_estimate,
    "content_hash": content_hash,
    "snippet": snippet,
    "language_map": language_map,
    "identifiers": identifiers,
    "duplicate_documents": duplicate_documents,
    "node_ids": node_ids,
    "chunk_ids": chunk_ids,
    "collection_names": collection_names,
    "word_counts": word_counts,
}

_POSIX = r"regexp_replace(replace(path, '\', '/'), '^(\./)+', '')"
_EXT = rf"lower(regexp_extract({_POSIX}, '[^/](\.[^./]*)$', 1))"
_LANG = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items()) + " ELSE 'unknown' END"

SQL = {
    "text_shapes": r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words, len(regexp_extract_all(text, '[.!?]\s+')) + 1 AS n_sentences,
  len(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) - 1 AS n_line_ends, replace(lower(title), ' ', '-') AS slug,
  replace(replace(title, '\', '\\'), '|', '\|') AS cell, title AS back, chr(34) || replace(title, chr(34), chr(34) || chr(34)) || ', ' || chr(34) || chr(34) || 'x' || chr(34) || chr(34) || chr(34) AS csv,
  CASE WHEN file_size_bytes < 60 THEN file_size_bytes || 's' WHEN file_size_bytes < 3600 THEN file_size_bytes // 60 || 'm' WHEN file_size_bytes < 86400 THEN file_size_bytes // 3600 || 'h ' || file_size_bytes % 3600 // 60 || 'm' ELSE file_size_bytes // 86400 || 'd' END AS elapsed FROM documents""",
    "wiki_links": "SELECT doc_id, trim(title) || '|' || trim(title) AS targets FROM documents WHERE title IS NOT NULL",
    "url_kinds": """SELECT repo_name, regexp_matches(coalesce(url, local_path), '^(?i)([a-z][a-z0-9+.-]*:|//)') AS external, left(coalesce(url, local_path), 1) NOT IN ('.', '/') AS package FROM repositories""",
    "change_kinds": """SELECT status, CASE status WHEN 'A' THEN 'added' WHEN 'Copied' THEN 'added' WHEN 'removed' THEN 'deleted' WHEN 'R100' THEN 'renamed' ELSE 'modified' END AS change, count(*) AS n
FROM (SELECT CASE event_type WHEN 'signup' THEN 'A' WHEN 'purchase' THEN 'R100' WHEN 'error' THEN 'removed' WHEN 'view' THEN 'Copied' WHEN 'click' THEN 'T' END AS status FROM events) GROUP BY status""",
    "token_estimate": "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CAST(length(text) AS BIGINT) AS n_code_points FROM documents",
    "content_hash": "SELECT file_id, sha256(content) AS content_hash, sha256(content) = hash AS matches FROM file_inputs",
    "snippet": """SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE
  (CASE WHEN strpos(h, ' ') > 0 AND 500 - strpos(reverse(h), ' ') > 450 THEN substr(h, 1, 500 - strpos(reverse(h), ' ')) ELSE h END) || '...' END AS snippet
FROM (SELECT doc_id, text, substr(text, 1, 500) AS h FROM documents)""",
    "language_map": f"SELECT {_LANG} AS language, count(*) AS n FROM (SELECT {_EXT} AS ext FROM file_inputs) GROUP BY 1",
    "identifiers": """SELECT token, count(*) AS n_docs FROM (
  SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS token FROM documents)
WHERE regexp_full_match(token, '[A-Za-z][A-Za-z0-9_]{3,}') AND regexp_matches(token, '^.+[A-Z]') GROUP BY token""",
    "duplicate_documents": "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "node_ids": f"""SELECT file_id, concat_ws(':', 'File', repository, p) AS node_id, string_split(p, '/')[-1] AS name, string_split(p, '/')[1] AS package,
  CASE WHEN len(string_split(p, '/')) >= 2 THEN string_split(p, '/')[2] END AS module, substr(ext, 2, 20) AS extension
FROM (SELECT file_id, repository, {_POSIX} AS p, {_EXT} AS ext FROM file_inputs)""",
    "chunk_ids": """SELECT chromadb_id, CASE WHEN n >= 3 THEN s[1] END AS repository, CASE WHEN n >= 3 THEN array_to_string(s[2:n - 1], ':') END AS path,
  CASE WHEN n >= 3 THEN TRY_CAST(s[n] AS INTEGER) END AS index, concat_ws(':', collection_name, file_path, CAST(chunk_index AS VARCHAR)) = chromadb_id AS same
FROM (SELECT *, string_split(chromadb_id, ':') AS s, len(string_split(chromadb_id, ':')) AS n FROM chroma_entries)""",
    "collection_names": """SELECT repo_name, c AS collection, c = collection_name AS same FROM (
  SELECT repo_name, collection_name, CASE WHEN length(b) <= 63 THEN b ELSE substr(b, 1, 54) || '_' || substr(sha1(repo_name), 1, 8) END AS c FROM (
    SELECT repo_name, collection_name, regexp_replace('repo_' || regexp_replace(regexp_replace(lower(repo_name), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_+$', '') AS b FROM repositories))""",
    "word_counts": r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\r\n]+')) AS BIGINT) AS n_words, len(regexp_extract_all(text, '[^ \t\r\n]+')) = word_count AS same FROM documents""",
}
