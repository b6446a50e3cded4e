"""Maintenance queries over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import maintenance as M
from quern.operators.orphans import uuid_key
from quern.tables import table

CUT = "2026-01-01 00:00:00"


def _collection(c):
    return F.concat(F.lit("kb_"), F.replace(c, F.lit("-"), F.lit("_")))


def _cut():
    return F.to_timestamp_ntz(F.lit(CUT))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as of a date (stored hashes) against the live documents (hashes of their texts)."""
    docs = table(spark, d, "documents", "doc_id", "text", "content_hash", "file_size_bytes", "file_modified_at", "indexed_at", "deleted_at")
    prior = docs.where(F.col("indexed_at") <= _cut()).select("doc_id", F.col("content_hash").alias("hash"), F.col("file_size_bytes").alias("size"), F.col("file_modified_at").alias("mtime"))
    size = F.when(F.col("doc_id") % 3 == 0, F.col("file_size_bytes") + 1).otherwise(F.col("file_size_bytes"))
    now = docs.where("deleted_at is null").select("doc_id", F.sha2("text", 256).alias("hash"), size.alias("size"), F.col("file_modified_at").alias("mtime"))
    return M.snapshot_diff(prior, now, ["doc_id"])


def _disk_and_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    disk = table(spark, d, "documents", "source", "file_path", "deleted_at").where("deleted_at is null and source is not null").select(_collection(F.col("source")).alias("collection_name"), "file_path")
    index = table(spark, d, "chroma_entries", "collection_name", "file_path", "deleted_at").where("deleted_at is null").select("collection_name", "file_path")
    return disk, index


def repair_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    return M.repair_diagnosis(*_disk_and_index(spark, d), ["collection_name", "file_path"], "collection_name")


def completeness(spark: SparkSession, d: str) -> DataFrame:
    return M.completeness(*_disk_and_index(spark, d), ["collection_name", "file_path"], "collection_name")


def orphan_reap(spark: SparkSession, d: str) -> DataFrame:
    """Collections whose watched folder is gone."""
    held = table(spark, d, "chroma_entries", "collection_name").distinct()
    live = table(spark, d, "watched_folders", "folder_name", "deleted_at").where("deleted_at is null").select(_collection(F.col("folder_name")).alias("collection_name"))
    return M.reap(held, live, ["collection_name"])


def upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    """Net state of the stored pieces: newest delivery of each id, without those of deleted documents."""
    c = M.latest(table(spark, d, "document_chunks", "id", "document_id", "chunk_index", "start_offset", "end_offset", "loaded_at"), ["id"], "loaded_at")
    gone = table(spark, d, "documents", "id", "deleted_at").where("deleted_at is not null").select(uuid_key(F.col("id")).alias("_k"))
    return M.delete(c.withColumn("_k", uuid_key(F.col("document_id"))), gone).drop("_k")


def event_debounce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id").withColumn("ts", F.col("ts").cast("timestamp"))
    return M.debounce(e, ["user_id"], "1 hour", "event_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def rename_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a user as unlinks, signups as adds, paired within a day."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value").select(F.col("event_id").alias("id"), "user_id", "ts", "event_type", F.floor("value").alias("size"))
    return M.correlate_renames(e.where("event_type = 'error'"), e.where("event_type = 'signup'"), ["user_id"], 86_400_000)


def change_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository that an update would take: extension among the repository's (the defaults if it names none), no pattern excludes them."""
    from quern.functions.text import posix
    from quern.plans.predicates import matches_any
    from quern.sources.files import DEFAULT_EXTENSIONS

    repos = table(spark, d, "repositories", "repo_name", "include_extensions", "exclude_patterns")
    f = table(spark, d, "file_inputs", "file_id", "repository", "path").join(repos, F.col("repository") == F.col("repo_name"))
    ok = M.eligible(F.col("path"), M.included(F.col("include_extensions"), DEFAULT_EXTENSIONS), matches_any(posix(F.col("path")), F.col("exclude_patterns")))
    return M.count_eligible(f, ok, "repository")


def redelivered(spark: SparkSession, d: str) -> DataFrame:
    """Pieces delivered more than once or days late, per collection."""
    c = table(spark, d, "document_chunks", "id", "collection_name", "created_at", "loaded_at")
    once = c.groupBy("collection_name", "id").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("a"), F.max("loaded_at").alias("z"))
    return once.groupBy("collection_name").agg(F.count_if(F.col("n") > 1).alias("n_again"), F.count_if(F.col("z") > F.col("a") + F.expr("interval 2 days")).alias("n_late"), F.count(F.lit(1)).alias("n_ids"))


QUERIES = {
    "snapshot_diff": snapshot_diff,
    "repair_diagnosis": repair_diagnosis,
    "completeness": completeness,
    "orphan_reap": orphan_reap,
    "upsert_delete": upsert_delete,
    "event_debounce": event_debounce,
    "rename_correlation": rename_correlation,
    "change_eligibility": change_eligibility,
    "redelivered": redelivered,
}

_DI = """dsk AS (SELECT DISTINCT 'kb_' || replace(source, '-', '_') AS collection_name, file_path FROM documents WHERE deleted_at IS NULL AND source IS NOT NULL),
idx AS (SELECT DISTINCT collection_name, file_path FROM chroma_entries WHERE deleted_at IS NULL),
diag AS (SELECT collection_name, count(*) FILTER (WHERE a) AS n_disk, count(*) FILTER (WHERE b) AS n_index, count(*) FILTER (WHERE b IS NULL) AS n_missing, count(*) FILTER (WHERE a IS NULL) AS n_extra
  FROM (SELECT *, true AS a FROM dsk) FULL JOIN (SELECT *, true AS b FROM idx) USING (collection_name, file_path) GROUP BY collection_name)"""
_GLOB = "'^' || replace(replace(replace(replace(replace(replace(regexp_replace(p, '([.+^$()|{}\\[\\]])', '\\\\\\1', 'g'), '**/', chr(1)), '**', chr(2)), '*', '[^/]*'), '?', '[^/]'), chr(1), '(.*/)?'), chr(2), '.*') || '$'"
_UUID = "lower(replace(replace(replace({c}, '{{', ''), '}}', ''), '-', ''))"

SQL = {
    "snapshot_diff": f"""WITH p AS (SELECT doc_id, content_hash AS h, file_size_bytes AS s, file_modified_at AS m, true AS was FROM documents WHERE indexed_at <= TIMESTAMP '{CUT}'),
c AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 3 = 0 THEN file_size_bytes + 1 ELSE file_size_bytes END AS s, file_modified_at AS m, true AS is_now FROM documents WHERE deleted_at IS NULL)
SELECT doc_id, CASE WHEN is_now IS NULL THEN 'deleted' WHEN was IS NULL THEN 'added' WHEN p.s IS NOT DISTINCT FROM c.s AND p.m IS NOT DISTINCT FROM c.m THEN 'unchanged'
  WHEN coalesce(p.h = c.h, false) THEN 'touched' ELSE 'modified' END AS change FROM p FULL JOIN c USING (doc_id)""",
    "repair_diagnosis": f"WITH {_DI} SELECT *, CASE WHEN n_missing > 0 THEN 'missing_files' WHEN n_extra > 0 THEN 'metadata_drift' ELSE 'complete' END AS status FROM diag",
    "completeness": f"""WITH {_DI} SELECT collection_name, eligible, n_missing, missing_percent, CASE WHEN missing_percent > 20 OR n_missing > 50 THEN 'incomplete' ELSE 'complete' END AS status FROM (
  SELECT collection_name, n_disk AS eligible, n_missing, floor(n_missing / n_disk * 1000 + 0.5) / 10 AS missing_percent FROM diag WHERE n_disk > 0)""",
    "orphan_reap": """SELECT DISTINCT collection_name FROM chroma_entries WHERE collection_name NOT IN (SELECT 'kb_' || replace(folder_name, '-', '_') FROM watched_folders WHERE deleted_at IS NULL)""",
    "upsert_delete": f"""SELECT id, document_id, chunk_index, start_offset, end_offset, loaded_at FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS r FROM document_chunks) c
WHERE r = 1 AND {_UUID.format(c="document_id")} NOT IN (SELECT {_UUID.format(c="id")} FROM documents WHERE deleted_at IS NOT NULL)""",
    "event_debounce": """SELECT user_id, max(event_id) FILTER (WHERE ts = last_ts) AS event_id, last_ts AS ts, count(*) AS n FROM (
  SELECT *, max(ts) OVER (PARTITION BY user_id, burst) AS last_ts FROM (
    SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
      SELECT event_id, user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 1 HOUR, true) AS gap FROM events)))
GROUP BY user_id, burst, last_ts""",
    "rename_correlation": """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, kind, id) AS r FROM (
  SELECT event_id AS id, user_id, ts, floor(value) AS size, CASE event_type WHEN 'error' THEN 0 ELSE 1 END AS kind FROM events WHERE event_type IN ('error', 'signup'))),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(id BIGINT, ts TIMESTAMP, size DOUBLE)[]) AS held, NULL::STRUCT(id BIGINT, ts TIMESTAMP, size DOUBLE) AS old, NULL::BIGINT AS id, NULL::DOUBLE AS size FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT w.user_id, e.r,
    CASE WHEN e.kind = 0 THEN list_append(held, {'id': e.id, 'ts': e.ts, 'size': e.size}) WHEN len(held) > 0 AND e.ts - held[-1].ts <= INTERVAL 1 DAY THEN held[:-2] ELSE held END,
    CASE WHEN e.kind = 1 AND len(held) > 0 AND e.ts - held[-1].ts <= INTERVAL 1 DAY THEN held[-1] END, e.id, e.size
  FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
SELECT old.id AS unlink_id, id AS add_id, CASE WHEN old.size = size THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM w WHERE old IS NOT NULL""",
    "change_eligibility": rf"""SELECT repository, count(*) AS total, count(*) FILTER (WHERE ok) AS eligible, count(*) FILTER (WHERE NOT ok) AS filtered FROM (
  SELECT repository, list_contains(CASE WHEN include_extensions IS NULL OR len(include_extensions) = 0
      THEN ['.js', '.ts', '.jsx', '.tsx', '.cs', '.py', '.java', '.go', '.rs', '.cpp', '.c', '.h', '.pdf', '.docx', '.md', '.txt', '.rst', '.json', '.yaml', '.yml', '.toml'] ELSE include_extensions END, ext)
    AND NOT coalesce(len(list_filter(exclude_patterns, lambda p: regexp_matches(x, {_GLOB}))) > 0, false) AS ok
  FROM (SELECT repository, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS x, lower(regexp_extract(regexp_replace(replace(path, '\', '/'), '^(\./)+', ''), '[^/](\.[^./]*)$', 1)) AS ext FROM file_inputs)
  JOIN repositories ON repository = repo_name) GROUP BY repository""",
    "redelivered": """SELECT collection_name, count(*) FILTER (WHERE n > 1) AS n_again, count(*) FILTER (WHERE z > a + INTERVAL 2 DAY) AS n_late, count(*) AS n_ids FROM (
  SELECT collection_name, id, count(*) AS n, min(created_at) AS a, max(loaded_at) AS z FROM document_chunks GROUP BY 1, 2) GROUP BY collection_name""",
}
