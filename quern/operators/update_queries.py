"""Queries of the update pipeline's guards and writes, with their SQL from the rules they follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import docgraph as D
from quern.operators import graph as G
from quern.operators import maintenance as M
from quern.operators import maintenance_queries as Q
from quern.tables import table


def volume_guard(spark: SparkSession, d: str) -> DataFrame:
    """Files of a repository as the changes of one update, of which it takes 30 here."""
    return M.volume_guard(table(spark, d, "file_inputs", "repository"), "repository", 30)


def base_commit_guard(spark: SparkSession, d: str) -> DataFrame:
    """A file's hash as a commit; each third repository starts from one that is not there, each fourth from none."""
    r = table(spark, d, "repositories", "repo_name", "file_count")
    f = table(spark, d, "file_inputs", "repository", "hash").where("hash is not null").select(F.col("repository").alias("repo_name"), F.col("hash").alias("sha"))
    least = f.groupBy("repo_name").agg(F.min("sha").alias("_s"))
    base = F.when(F.col("file_count") % 4 == 0, None).when(F.col("file_count") % 3 == 0, "gone").otherwise(F.col("_s"))
    return M.base_commit_guard(r.join(least, "repo_name", "left").select("repo_name", base.alias("base")), f)


def drift(spark: SparkSession, d: str) -> DataFrame:
    """Documents modified since a date as changes of their collection."""
    docs = table(spark, d, "documents", "source", "file_modified_at", "deleted_at").where("deleted_at is null and source is not null and file_modified_at > timestamp_ntz'2026-04-01 00:00:00'")
    return M.drift(docs.select(Q._collection(F.col("source")).alias("collection_name")), Q.completeness(spark, d), "collection_name")


def dimension_guard(spark: SparkSession, d: str) -> DataFrame:
    """What a registry knows of its embedders (made of its counts) against what the collections hold."""
    r = table(spark, d, "repositories", "repo_name", "source", "file_count", "chunk_count")
    own = r.select("repo_name", F.when(F.col("file_count") % 2 == 0, F.col("source")).alias("provider"), F.lit(None).cast("string").alias("model"), F.when(F.col("file_count") % 2 == 0, 64).alias("dimensions"))
    held = r.where("chunk_count % 3 > 0").select("repo_name", F.lit("local").alias("provider"), F.lit("small").alias("model"), F.when(F.col("chunk_count") % 3 == 1, 64).otherwise(32).alias("dimensions"))
    return M.dimension_guard(held, own, ("local", "base", 32))


def unchanged_skip(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_inputs", "file_id", "content", "hash")
    return M.unchanged(f.select("file_id", "content"), f.select("file_id", "hash"), ["file_id"])


def initial_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "content_hash", "file_size_bytes", "file_modified_at", "processing_status")
    files = docs.select("doc_id", F.col("content_hash").alias("hash"), F.col("file_size_bytes").alias("size"), F.col("file_modified_at").alias("mtime"))
    return M.initial_manifest(files, docs.where("processing_status = 'indexed'"), ["doc_id"])


def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    return M.repair_plan(*Q._disk_and_index(spark, d), ["collection_name", "file_path"])


def event_max_wait(spark: SparkSession, d: str) -> DataFrame:
    """A user's events, quiet for six hours or fired a day after the first."""
    return M.debounce_max_wait(table(spark, d, "events", "event_id", "ts", "user_id"), ["user_id"], "event_id", 6 * 3_600_000, 24 * 3_600_000)


def route_events(spark: SparkSession, d: str) -> DataFrame:
    """Documents' paths as events; the deepest watched folder takes each."""
    docs = table(spark, d, "documents", "doc_id", "source", "file_path").where("source is not null and file_path is not null")
    e = docs.select("doc_id", F.concat(F.lit("/srv/kb/"), "source", F.lit("/"), "file_path").alias("path"))
    f = table(spark, d, "watched_folders", "folder_path", "folder_name", "deleted_at").where("deleted_at is null").select("folder_path", F.col("folder_name").alias("repository"))
    return M.route_events(e, f)


def apply_changes(spark: SparkSession, d: str) -> DataFrame:
    """Index entries after an update made of the documents: a third each modified, deleted and added, some of the latter renamed; applied twice over."""
    held = table(spark, d, "chroma_entries", "collection_name", "file_path", "chunk_index", "deleted_at").where("deleted_at is null").select(F.col("collection_name").alias("repository"), "file_path", "chunk_index")
    docs = table(spark, d, "documents", "doc_id", "source", "file_path").where("source is not null and file_path is not null")
    kind = F.when(F.col("doc_id") % 3 == 0, "modified").when(F.col("doc_id") % 3 == 1, "deleted").when(F.col("doc_id") % 9 == 2, "renamed").otherwise("added")
    c = docs.select(Q._collection(F.col("source")).alias("repository"), F.col("file_path").alias("path"), kind.alias("change"))
    changes = c.select("repository", F.when(F.col("change") == "renamed", F.concat(F.lit("new/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("change") == "renamed", F.col("path")).alias("old_path"), "change")
    fresh = changes.where("change != 'deleted'").select("repository", F.col("path").alias("file_path"), F.lit(1000).alias("chunk_index")).distinct()
    return M.apply_changes(M.apply_changes(held, changes, fresh), changes, fresh)


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """A graph whose names overlap: customers as functions, suppliers as classes, parts as modules."""
    def of(name: str, key: str, label: str) -> DataFrame:
        k = F.col(key)
        return table(spark, d, name, key).select(F.concat(F.lit(f"{label}:"), k.cast("string")).alias("id"), F.lit(label).alias("label"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("repository"), F.concat(F.lit("name"), (k % 700).cast("string")).alias("name"), F.concat(F.lit("f"), (k % 50).cast("string")).alias("path"))

    return of("customer", "c_custkey", "Function").unionByName(of("supplier", "s_suppkey", "Class")).unionByName(of("part", "p_partkey", "Module"))


def symbol_index(spark: SparkSession, d: str) -> DataFrame:
    return G.symbol_index(_symbols(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_partkey", "l_suppkey").distinct()
    return li.select(F.concat(F.lit("Class:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("Module:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("MENTIONS").alias("type"))


def graph_delete_file(spark: SparkSession, d: str) -> DataFrame:
    """What goes with the files f1 and f2 of the first repository: nodes and edges by kind."""
    n, e = _symbols(spark, d), _links(spark, d)
    files = spark.createDataFrame([("r1", "f1"), ("r1", "f2")], "repository string, path string")
    return G.removed((n, e), G.delete_file(n, e, files))


def graph_delete_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links of suppliers that are not in the part's repository go."""
    n, e = _symbols(spark, d), _links(spark, d)
    return G.delete_edges(e, D.foreign_mentions(e, n))


def graph_import(spark: SparkSession, d: str) -> DataFrame:
    n, e = G.imported(_symbols(spark, d), _links(spark, d), "old")
    return G.counts(n.where("id = 'old:' || _source_id"), e.where("src like 'old:Class:%' and dst like 'old:Module:%'"))


QUERIES = {
    "volume_guard": volume_guard,
    "base_commit_guard": base_commit_guard,
    "drift": drift,
    "dimension_guard": dimension_guard,
    "unchanged_skip": unchanged_skip,
    "initial_manifest": initial_manifest,
    "repair_plan": repair_plan,
    "event_max_wait": event_max_wait,
    "route_events": route_events,
    "apply_changes": apply_changes,
    "symbol_index": symbol_index,
    "graph_delete_file": graph_delete_file,
    "graph_delete_edges": graph_delete_edges,
    "graph_import": graph_import,
}

_N = """n AS (SELECT 'Function:' || c_custkey AS id, 'Function' AS label, 'r' || c_custkey % 3 AS repository, 'name' || c_custkey % 700 AS name, 'f' || c_custkey % 50 AS path FROM customer
  UNION ALL SELECT 'Class:' || s_suppkey, 'Class', 'r' || s_suppkey % 3, 'name' || s_suppkey % 700, 'f' || s_suppkey % 50 FROM supplier
  UNION ALL SELECT 'Module:' || p_partkey, 'Module', 'r' || p_partkey % 3, 'name' || p_partkey % 700, 'f' || p_partkey % 50 FROM part),
e AS (SELECT DISTINCT 'Class:' || l_suppkey AS src, 'Module:' || l_partkey AS dst, 'MENTIONS' AS type FROM lineitem)"""
_GONE = "(SELECT id FROM n WHERE repository = 'r1' AND path IN ('f1', 'f2'))"
_COMPLETE = Q.SQL["completeness"]

SQL = {
    "volume_guard": "SELECT repository, count(*) AS n_changes, CASE WHEN count(*) > 30 THEN 'full_reindex' ELSE 'update' END AS verdict FROM file_inputs GROUP BY repository",
    "base_commit_guard": """WITH r AS (SELECT repo_name, CASE WHEN file_count % 4 = 0 THEN NULL WHEN file_count % 3 = 0 THEN 'gone' ELSE (SELECT min(hash) FROM file_inputs WHERE repository = repo_name) END AS base FROM repositories)
SELECT repo_name, base, CASE WHEN base IS NULL THEN 'none' WHEN EXISTS (SELECT 1 FROM file_inputs f WHERE f.repository = r.repo_name AND f.hash = r.base) THEN 'present' ELSE 'missing' END AS state FROM r""",
    "drift": f"""WITH done AS ({_COMPLETE}), c AS (SELECT 'kb_' || replace(source, '-', '_') AS collection_name FROM documents WHERE deleted_at IS NULL AND source IS NOT NULL AND file_modified_at > TIMESTAMP '2026-04-01' GROUP BY 1)
SELECT coalesce(done.collection_name, c.collection_name) AS collection_name, CASE WHEN c.collection_name IS NOT NULL THEN 'changes' WHEN done.status = 'incomplete' THEN 'drift_detected' ELSE 'no_changes' END AS status
FROM done FULL JOIN c ON done.collection_name = c.collection_name""",
    "dimension_guard": """SELECT repo_name, CASE WHEN chunk_count % 3 > 0 THEN 'local' WHEN file_count % 2 = 0 THEN source ELSE 'local' END AS provider, CASE WHEN chunk_count % 3 > 0 THEN 'small' ELSE 'base' END AS model,
  CASE WHEN chunk_count % 3 = 1 THEN 64 WHEN chunk_count % 3 = 2 THEN 32 WHEN file_count % 2 = 0 THEN 64 ELSE 32 END AS dimensions, CASE chunk_count % 3 WHEN 1 THEN 64 WHEN 2 THEN 32 END AS stored_dimensions,
  CASE WHEN chunk_count % 3 = 0 THEN 'new' WHEN (chunk_count % 3 = 1) = (file_count % 2 = 0) THEN 'ok' ELSE 'mismatch' END AS verdict FROM repositories""",
    "unchanged_skip": "SELECT file_id, CASE WHEN content IS NULL THEN 'missing' WHEN sha256(content) = lower(hash) THEN 'skip' ELSE 'process' END AS verdict FROM file_inputs",
    "initial_manifest": "SELECT doc_id, content_hash AS hash, file_size_bytes AS size, file_modified_at AS mtime FROM documents WHERE processing_status = 'indexed'",
    "repair_plan": """WITH dsk AS (SELECT DISTINCT 'kb_' || replace(source, '-', '_') AS collection_name, file_path FROM documents WHERE deleted_at IS NULL AND source IS NOT NULL),
idx AS (SELECT DISTINCT collection_name, file_path FROM chroma_entries WHERE deleted_at IS NULL)
SELECT *, 'embed' AS action FROM (SELECT * FROM dsk EXCEPT SELECT * FROM idx) UNION ALL SELECT *, 'delete' FROM (SELECT * FROM idx EXCEPT SELECT * FROM dsk)""",
    "event_max_wait": """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT user_id, r, event_id, ms, ms AS started, 1 AS piece FROM e WHERE r = 1
  UNION ALL SELECT e.user_id, e.r, e.event_id, e.ms, CASE WHEN e.ms - w.ms >= 21600000 OR e.ms - w.started >= 86400000 THEN e.ms ELSE w.started END,
    CASE WHEN e.ms - w.ms >= 21600000 OR e.ms - w.started >= 86400000 THEN w.piece + 1 ELSE w.piece END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
SELECT user_id, CAST(least(max(ms) + 21600000, min(started) + 86400000) AS BIGINT) AS fired_at, arg_max(event_id, r) AS event_id, count(*) AS n FROM w GROUP BY user_id, piece""",
    "route_events": """SELECT doc_id, path, arg_max(folder_name, length(folder_path)) AS repository FROM (SELECT doc_id, '/srv/kb/' || source || '/' || file_path AS path FROM documents WHERE source IS NOT NULL AND file_path IS NOT NULL)
JOIN watched_folders ON starts_with(path, rtrim(folder_path, '/') || '/') WHERE deleted_at IS NULL GROUP BY doc_id, path""",
    "apply_changes": """WITH c AS (SELECT 'kb_' || replace(source, '-', '_') AS repository, file_path, CASE WHEN doc_id % 3 = 0 THEN 'modified' WHEN doc_id % 3 = 1 THEN 'deleted' WHEN doc_id % 9 = 2 THEN 'renamed' ELSE 'added' END AS change
  FROM documents WHERE source IS NOT NULL AND file_path IS NOT NULL)
SELECT repository, file_path, CAST(chunk_index AS INTEGER) AS chunk_index FROM (
  SELECT collection_name AS repository, file_path, chunk_index FROM chroma_entries WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.repository = collection_name AND c.file_path = chroma_entries.file_path)
    AND NOT EXISTS (SELECT 1 FROM c WHERE change = 'renamed' AND c.repository = collection_name AND 'new/' || c.file_path = chroma_entries.file_path)
  UNION ALL SELECT DISTINCT repository, CASE WHEN change = 'renamed' THEN 'new/' || file_path ELSE file_path END, 1000 FROM c WHERE change <> 'deleted')""",
    "symbol_index": f"""WITH {_N} SELECT repository, name, id, label FROM (SELECT *, row_number() OVER (PARTITION BY repository, name ORDER BY CASE label WHEN 'Function' THEN 0 WHEN 'Class' THEN 1 ELSE 2 END, id) AS r FROM n) WHERE r = 1""",
    "graph_delete_file": f"""WITH {_N} SELECT 'node' AS kind, label AS name, count(*) AS n FROM n WHERE id IN {_GONE} GROUP BY label
UNION ALL SELECT 'edge', type, count(*) FROM e WHERE src IN {_GONE} OR dst IN {_GONE} GROUP BY type""",
    "graph_delete_edges": f"WITH {_N} SELECT e.src, e.dst, e.type FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.repository = b.repository",
    "graph_import": f"WITH {_N} SELECT 'node' AS kind, label AS name, count(*) AS n FROM n GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type",
}
