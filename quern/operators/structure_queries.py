"""Chunkers and document structure over whole tables; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking as C
from quern.operators import docgraph as D
from quern.operators import graph as G
from quern.operators import markdown as M
from quern.operators.orphans import uuid_key
from quern.tables import table


def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "file_inputs", "file_id", "content")
    return C.chunk(files, C.by_lines)


def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk(table(spark, d, "documents", "doc_id", "text"), C.by_paragraphs)


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.by_pages(table(spark, d, "page_infos", "doc_id", "page_number", "content"))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents of that type or with such a file's extension: a document's type is not always right."""
    docs = table(spark, d, "documents", "doc_id", "text", "document_type", "source", "file_path")
    return docs.where((F.lower("document_type") == "markdown") | T.extension(F.col("file_path")).isin(".md", ".markdown"))


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return M.sections(_markdown(spark, d))


def markdown_titles(spark: SparkSession, d: str) -> DataFrame:
    return M.titles(_markdown(spark, d))


def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    return M.tables(_markdown(spark, d), 100)


def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    docs = _markdown(spark, d)
    node = T.document_node_id(F.col("source"), F.col("file_path"))
    titled = docs.join(M.titles(docs), "doc_id").select(F.col("source").alias("repository"), "file_path", "title", node.alias("node"))
    heads = M.sections(docs).join(docs.select("doc_id", "source", "file_path"), "doc_id")
    heads = heads.select(F.col("source").alias("repository"), "title", T.section_id(F.col("file_path"), F.col("section"), F.col("level"), F.col("title")).alias("node"))
    symbols = table(spark, d, "file_inputs", "repository", "path").select("repository", T.display_name(F.col("path")).alias("name"), T.node_id("File", F.col("repository"), T.posix(F.col("path"))).alias("node"))
    found = M.links(docs).join(docs.select("doc_id", F.col("source").alias("repository"), "file_path"), "doc_id")
    return M.resolve_links(found, titled, heads, symbols)


def code_mentions(spark: SparkSession, d: str) -> DataFrame:
    return M.mentions(_markdown(spark, d))


def chunk_headings(spark: SparkSession, d: str) -> DataFrame:
    """Stored pieces with the heading that stands before their start: the as-of join."""
    docs = _markdown(spark, d)
    chunks = table(spark, d, "document_chunks", "id", "document_id", "start_offset")
    ids = table(spark, d, "documents", "doc_id", uuid_key(F.col("id")).alias("_key"))
    at = chunks.withColumn("_key", uuid_key(F.col("document_id"))).join(ids, "_key").join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("start_offset").alias("offset"), F.col("id").alias("chunk_id")).distinct()
    return M.nearest_heading(at, M.sections(docs))


def url_links(spark: SparkSession, d: str) -> DataFrame:
    """Bare addresses in the documents' texts with their external-link node."""
    urls = F.explode(F.regexp_extract_all("text", F.lit(r"(https?://[a-zA-Z0-9./?=_&-]+)"), 1))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", urls.alias("url")).groupBy("url").agg(F.countDistinct("doc_id").alias("n_docs")).withColumn("node", T.external_link_id(F.col("url")))


def _doc_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents' graph; every name that is mentioned stands for a symbol."""
    docs = _markdown(spark, d).select("doc_id", F.col("source").alias("repository"), "file_path", "text")
    symbols = M.mentions(docs).join(docs.select("doc_id", "repository"), "doc_id").where("repository is not null").select("repository", "name").distinct()
    return D.build_document_graph(docs, symbols.select("repository", "name", T.node_id("Function", F.col("repository"), F.col("name")).alias("id")))


def markdown_tables_whole(spark: SparkSession, d: str) -> DataFrame:
    """Tables cut into chunks of at most 40 tokens and put together again, beside what they were."""
    docs = _markdown(spark, d)
    whole = M.tables(docs, 1_000_000).select("doc_id", "table_index", F.col("columns").alias("_c"), F.col("rows").alias("_r"))
    back = M.reassembled(M.tables(docs, 40))
    return back.join(whole, ["doc_id", "table_index"], "full").select("doc_id", "table_index", "n_parts", (F.col("columns").eqNullSafe(F.col("_c")) & F.col("n_rows").eqNullSafe(F.col("_r"))).alias("same"))


def doc_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.counts(*_doc_graph(spark, d))


def doc_graph_documents(spark: SparkSession, d: str) -> DataFrame:
    """The graph's document nodes."""
    return _doc_graph(spark, d)[0].where("label = 'Document'").select("id", "repository", "path")


def doc_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Files' names in the repositories as mentions, met with the names of all files exactly; those that lead out of the repository."""
    f = table(spark, d, "file_inputs", "repository", "path").where("repository is not null").select("repository", T.posix(F.col("path")).alias("path")).distinct()
    name = T.display_name(F.col("path"))
    symbols = G.symbol_index(f.select(T.node_id("File", F.col("repository"), F.col("path")).alias("id"), F.lit("Module").alias("label"), "repository", name.alias("name")))
    said = f.select("repository", F.concat(F.lit("Document:"), "repository").alias("src"), name.alias("name"), F.lit("high").alias("confidence"))
    return D.mention_edges(said, symbols)


def chunk_lines_cover(spark: SparkSession, d: str) -> DataFrame:
    """Per file with text: first and last line of its line chunks, and whether each begins at or before the line behind the last."""
    c = chunk_lines(spark, d).groupBy("file_id").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.sort_array(F.collect_list(F.struct("chunk_index", "start_line", "end_line"))).alias("_c"))
    gap = F.exists(F.sequence(F.lit(1), F.size("_c") - 1), lambda i: F.element_at("_c", i + 1)["start_line"] > F.element_at("_c", i)["end_line"] + 1)
    return c.select("file_id", "first_line", "last_line", F.when(F.size("_c") > 1, gap).otherwise(False).alias("gap"))


def chunk_pages_cover(spark: SparkSession, d: str) -> DataFrame:
    """Per document with text: chunks numbered from 0 without a gap, pages that have chunks."""
    c = chunk_pages(spark, d).groupBy("doc_id").agg(F.countDistinct("page_number").alias("n_pages"), (F.max("chunk_index") + 1 == F.countDistinct("chunk_index")).alias("numbered"))
    return c


def chunk_paragraphs_cover(spark: SparkSession, d: str) -> DataFrame:
    """Per document with text: chunks are numbered from 0, and no word of it is lost (words of all chunks, at least those of the text)."""
    c = chunk_paragraphs(spark, d).groupBy("doc_id").agg((F.max("chunk_index") + 1 == F.count(F.lit(1))).alias("numbered"), F.sum(T.count_words(F.col("content"))).alias("_n"))
    t = table(spark, d, "documents", "doc_id", "text").select("doc_id", T.count_words(F.col("text")).alias("n_words"))
    return c.join(t, "doc_id").select("doc_id", "numbered", F.col("n_words").cast("long").alias("n_words"), (F.col("_n") >= F.col("n_words")).alias("whole"))


def markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of Markdown documents without code blocks, by level: there every line that looks like one is one."""
    docs = _markdown(spark, d).where("text is not null and not contains(text, '```') and not contains(text, '~~~') and not contains(text, '---') and not contains(text, '===')")
    return M.sections(docs).groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))


def chunk_strategy(spark: SparkSession, d: str) -> DataFrame:
    """How each document is cut: by its pages if it has any, by paragraphs if it has blank lines, else by lines."""
    pages = table(spark, d, "page_infos", "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return C.strategy(table(spark, d, "documents", "doc_id", "text").join(pages, "doc_id", "left"))


def ocr_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence over each source's documents that were read; those without one are skipped."""
    docs = table(spark, d, "documents", "source", "ocr_confidence", "ocr_processed")
    return C.ocr_summary(docs.select(F.col("source").alias("doc_id"), F.col("ocr_confidence").cast("double").alias("confidence"), (~F.coalesce("ocr_processed", F.lit(False))).alias("skipped"))).withColumnRenamed("doc_id", "source")


def section_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """Stored pieces with the path of headings above their start."""
    docs = _markdown(spark, d)
    heads = M.sections(docs)
    return M.breadcrumbs(chunk_headings(spark, d).select("doc_id", "offset", "chunk_id"), heads)


QUERIES = {
    "chunk_lines": chunk_lines,
    "chunk_paragraphs": chunk_paragraphs,
    "chunk_pages": chunk_pages,
    "markdown_sections": markdown_sections,
    "markdown_titles": markdown_titles,
    "markdown_tables": markdown_tables,
    "markdown_links": markdown_links,
    "code_mentions": code_mentions,
    "chunk_headings": chunk_headings,
    "url_links": url_links,
    "doc_graph_counts": doc_graph_counts,
    "markdown_tables_whole": markdown_tables_whole,
    "doc_graph_documents": doc_graph_documents,
    "doc_mentions": doc_mentions,
    "chunk_lines_cover": chunk_lines_cover,
    "chunk_pages_cover": chunk_pages_cover,
    "chunk_paragraphs_cover": chunk_paragraphs_cover,
    "markdown_headings": markdown_headings,
    "chunk_strategy": chunk_strategy,
    "ocr_confidence": ocr_confidence,
    "section_breadcrumbs": section_breadcrumbs,
}

_MD = r"lower(document_type) = 'markdown' OR regexp_matches(lower(file_path), '[^/]\.(md|markdown)$')"
_BLANK = r"regexp_matches(replace(content, chr(13), chr(10)), '^\s*$')"

SQL = {
    "doc_graph_documents": f"SELECT DISTINCT 'Document:' || source || ':' || file_path AS id, source AS repository, file_path AS path FROM documents WHERE source IS NOT NULL AND file_path IS NOT NULL AND ({_MD})",
    "doc_mentions": r"""WITH f AS (SELECT DISTINCT repository, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path FROM file_inputs WHERE repository IS NOT NULL), n AS (SELECT *, string_split(path, '/')[-1] AS name FROM f)
SELECT DISTINCT 'Document:' || a.repository AS src, (SELECT min('File:' || b.repository || ':' || b.path) FROM n b WHERE b.repository = a.repository AND b.name = a.name) AS dst, 'MENTIONS' AS type, 'high' AS confidence FROM n a""",
    "chunk_lines_cover": rf"""SELECT file_id, CAST(1 AS INTEGER) AS first_line, CAST(len(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS INTEGER) AS last_line, false AS gap
FROM file_inputs WHERE content IS NOT NULL AND NOT {_BLANK}""",
    "chunk_pages_cover": f"SELECT doc_id, count(DISTINCT page_number) AS n_pages, true AS numbered FROM page_infos WHERE content IS NOT NULL AND NOT {_BLANK} GROUP BY doc_id",
    "chunk_paragraphs_cover": rf"""SELECT doc_id, true AS numbered, len(regexp_extract_all(text, '\S+')) AS n_words, true AS whole FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\S')""",
    "markdown_headings": rf"""SELECT doc_id, CAST(length(regexp_extract(x, '^ {{0,3}}(#+)', 1)) AS INTEGER) AS level, count(*) AS n FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS x FROM documents
  WHERE text IS NOT NULL AND ({_MD}) AND NOT contains(text, '```') AND NOT contains(text, '~~~') AND NOT contains(text, '---') AND NOT contains(text, '===')) WHERE regexp_matches(x, '^ {{0,3}}#{{1,6}}[ \t]+\S') GROUP BY 1, 2""",
    "chunk_strategy": r"""SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 'none' WHEN p.doc_id IS NOT NULL THEN 'pages' WHEN regexp_matches(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\n') THEN 'paragraphs' ELSE 'lines' END AS strategy
FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM page_infos) p USING (doc_id)""",
    "ocr_confidence": """SELECT source, round(avg(CASE WHEN ocr_processed THEN CAST(ocr_confidence AS DOUBLE) END), 2) AS confidence, count(*) AS n_pages, count(*) FILTER (WHERE NOT coalesce(ocr_processed, false)) AS n_skipped FROM documents GROUP BY source""",
    "url_links": """SELECT url, count(DISTINCT doc_id) AS n_docs, 'ExternalLink:' || substr(sha1(url), 1, 16) AS node FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '(https?://[a-zA-Z0-9./?=_&-]+)', 1)) AS url FROM documents) GROUP BY url""",
}
