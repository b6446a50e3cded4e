"""Queries of the text problems, gathered for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import encoding, handwritten, language, leakage, scans, secrets, splitting, syntax
from quern.tables import spread, table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "file_inputs", "file_id", "repository", "path", "content"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents", "doc_id", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_secrets(spark, d).select("file_id", "line_no")


def p1_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secrets(_files(spark, d))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return secrets.redacted(files, secrets.train(files))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """All pages: a document's type is not always right, so clean documents are examined like the scanned ones."""
    return table(spark, d, "page_infos", "page_id", "doc_id", "page_number", "content")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pages = _scanned(spark, d)
    return scans.defects(pages, scans.train(pages))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    pages = _scanned(spark, d)
    return scans.paragraphs(pages, scans.train(pages))


def p2_types(spark: SparkSession, d: str) -> DataFrame:
    """Pages and defects by the documents' type, which shows documents whose type is wrong."""
    found = p2_found(spark, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    docs = table(spark, d, "documents", "doc_id", F.lower("document_type").alias("document_type"))
    return (
        table(spark, d, "page_infos", "page_id", "doc_id")
        .join(found, "page_id", "left")
        .join(docs, "doc_id", "left")
        .groupBy("document_type")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.count("n").alias("n_defective"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_defects"))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(_files(spark, d)).select("file_id")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(_files(spark, d))


def p4_layout(spark: SparkSession, d: str) -> DataFrame:
    """The layout statistics of every file with a code extension."""
    return handwritten.described(_files(spark, d)).drop("code_hash")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.badly_cut(table(spark, d, "documents"), table(spark, d, "document_chunks"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_texts(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_files(_files(spark, d)).select("file_id")


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_files(_files(spark, d))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_rates(_files(spark, d))


def p6_log(spark: SparkSession, d: str) -> DataFrame:
    return syntax.log_agreement(_files(spark, d), table(spark, d, "ingestion_errors"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(_texts(spark, d))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_texts(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them and the longest span."""
    return p8_leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    return language.wrong_labels(spread(docs), language.train(docs))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    return language.document_languages(spread(docs), language.train(docs))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    return language.segments(spread(docs), language.train(docs))


# Checks: what SQL can say of results that it cannot make itself.


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    """Frame of the masked contents: characters and lines are as many as before."""
    r = p1_redacted(spark, d)
    return r.select("file_id", F.char_length("content").cast("long").alias("n_chars"), F.regexp_count("content", F.lit("\n")).cast("long").alias("n_lines"))


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    """Longest line of each file with a code extension."""
    return p4_layout(spark, d).select("file_id", "max_line")


def p5_cover(spark: SparkSession, d: str) -> DataFrame:
    """Per long document: where its pieces begin and end, and how many break a rule of length, order or overlap."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    p = p5_pieces(spark, d).withColumns({"_s": F.lag("start_offset").over(w), "_e": F.lag("end_offset").over(w), "_i": F.row_number().over(w) - 1})
    size, overlap = F.col("end_offset") - F.col("start_offset"), F.col("_e") - F.col("start_offset")
    bad = (size < 1) | (size > 2000) | (F.col("chunk_index") != F.col("_i")) | F.coalesce((F.col("start_offset") <= F.col("_s")) | (F.col("end_offset") <= F.col("_e")) | (overlap < 1) | (overlap > 200), F.lit(False))
    return p.groupBy("doc_id").agg(F.min("start_offset").alias("first"), F.max("end_offset").alias("last"), F.count_if(bad).alias("n_bad"))


def p6_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON files that are not valid."""
    return p6_files(spark, d).where("language = 'json'").select("file_id")


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    return p6_rates(spark, d).select("repository", "language", "n_files")


def p7_text(spark: SparkSession, d: str) -> DataFrame:
    """Hash and length of what the ids decode to."""
    t = encoding.decoded(p7_ids(spark, d))
    return t.select("doc_id", F.sha2("text", 256).alias("text_hash"), F.octet_length("text").cast("long").alias("n_bytes"))


QUERIES = {
    "p1_found": p1_found,
    "p1_secrets": p1_secrets,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p2_paragraphs": p2_paragraphs,
    "p2_types": p2_types,
    "p4_found": p4_found,
    "p4_files": p4_files,
    "p4_layout": p4_layout,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p6_files": p6_files,
    "p6_rates": p6_rates,
    "p6_log": p6_log,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_documents": p9_documents,
    "p9_segments": p9_segments,
    "p1_masked": p1_masked,
    "p4_lines": p4_lines,
    "p5_cover": p5_cover,
    "p6_json": p6_json,
    "p6_totals": p6_totals,
    "p7_text": p7_text,
}

_UUID = "lower(replace(replace(replace({c}, '{{', ''), '}}', ''), '-', ''))"
#: A cut stands inside a word: no white space on either side, and the run around it is not longer than a piece.
_INSIDE = """({p} > 0 AND {p} < n AND NOT regexp_matches(substr(text, CAST({p} AS BIGINT), 1), '[ \\t\\r\\n]') AND NOT regexp_matches(substr(text, CAST({p} AS BIGINT) + 1, 1), '[ \\t\\r\\n]')
  AND length(regexp_extract(substr(text, greatest(1, {p} - 2000), least({p}, 2001)), '[^ \\t\\r\\n]*$')) + length(regexp_extract(substr(text, CAST({p} AS BIGINT) + 1, 2001), '^[^ \\t\\r\\n]*')) <= 2000)"""

_LANG = r"CASE lower(regexp_extract(replace(path, '\', '/'), '[^/](\.[^./]*)$', 1)) WHEN '.py' THEN 'python' WHEN '.pyw' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.mts' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.java' THEN 'java' WHEN '.go' THEN 'go' WHEN '.json' THEN 'json' END"

SQL: dict[str, str] = {
    "p1_masked": "SELECT file_id, length(content) AS n_chars, length(content) - length(replace(content, chr(10), '')) AS n_lines FROM file_inputs",
    "p4_lines": f"""SELECT file_id, CAST(list_max(list_transform(string_split(replace(content, chr(13), ''), chr(10)), lambda x: length(x))) AS INTEGER) AS max_line
FROM file_inputs WHERE content <> '' AND {_LANG} <> 'json'""",
    "p5_cover": "SELECT doc_id, CAST(0 AS INTEGER) AS first, CAST(length(text) AS INTEGER) AS last, CAST(0 AS BIGINT) AS n_bad FROM documents WHERE ceil(length(text) / 4) > 500",
    "p6_json": f"SELECT file_id FROM file_inputs WHERE content IS NOT NULL AND {_LANG} = 'json' AND NOT json_valid(content)",
    "p6_totals": f"SELECT repository, {_LANG} AS language, count(*) AS n_files FROM file_inputs WHERE content IS NOT NULL AND {_LANG} IS NOT NULL GROUP BY 1, 2",
    "p7_text": "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
    "p5_found": f"""WITH d AS (SELECT doc_id, {_UUID.format(c="id")} AS k, text, length(text) AS n FROM documents WHERE ceil(length(text) / 4) > 500),
c AS (SELECT DISTINCT {_UUID.format(c="document_id")} AS k, chunk_index AS i, start_offset AS s, end_offset AS e FROM document_chunks),
j AS (SELECT d.doc_id, d.n, d.text, c.i, c.s, c.e, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY d.doc_id) AS m, lag(c.s) OVER w AS ps, lag(c.e) OVER w AS pe
  FROM d JOIN c ON d.k = c.k WINDOW w AS (PARTITION BY d.doc_id ORDER BY c.i, c.s, c.e)),
bad AS (SELECT DISTINCT doc_id FROM j WHERE i IS NULL OR s IS NULL OR e IS NULL OR i <> r OR (r = 0 AND s <> 0) OR (r = m - 1 AND e <> n) OR s < 0 OR e > n OR e <= s OR e - s > 2000
  OR (r > 0 AND (s <= ps OR e <= pe OR s >= pe OR pe - s > 200)) OR {_INSIDE.format(p="s")} OR {_INSIDE.format(p="e")})
SELECT doc_id FROM d WHERE doc_id IN (SELECT doc_id FROM bad) OR k NOT IN (SELECT k FROM c WHERE k IS NOT NULL)""",
}
