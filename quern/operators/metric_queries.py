"""Metric queries over the event stream and the registry, with their SQL.

An event is an update run (repository = user, duration = value, failed if its type is ``error``), a query
of the log (type = event type, cache hit if ``k`` of its properties is even) or an audit record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import metrics as M
from quern.operators.maintenance import size_guardrails
from quern.tables import table

AS_OF = "2024-01-20 00:00:00"
TYPES = ["signup", "purchase", "error", "view", "click", "architecture"]


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def _history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props").select(
        "event_id", "ts", "user_id", F.col("value").alias("duration_ms"), _k().alias("files"), (_k() * 3).alias("chunks"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status")
    )


def update_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.update_metrics(_history(spark, d))


def update_metrics_per_repo(spark: SparkSession, d: str) -> DataFrame:
    """Errors and purchases are update runs; a user without any keeps a line of zeros."""
    h = _history(spark, d)
    runs = h.join(table(spark, d, "events", "event_id", "event_type").where(F.col("event_type").isin("error", "purchase")).select("event_id"), "event_id", "left_semi")
    return M.update_metrics(M.with_all(h, runs, "user_id"), "user_id")


def update_trend(spark: SparkSession, d: str) -> DataFrame:
    return M.update_metrics(M.since(_history(spark, d), AS_OF, 7).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day")


def query_type_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.query_metrics(_log(spark, d), TYPES)


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The query log: an even ``k`` is a cache hit, ``k`` the number of results, a multiple of 17 a failure."""
    return table(spark, d, "events", "ts", "event_type", "value", "props").select("ts", F.col("event_type").alias("query_type"), F.col("value").alias("duration"), (_k() % 2 == 0).alias("hit"), _k().alias("results"), (_k() % 17 == 0).alias("failed"))


def query_trend(spark: SparkSession, d: str) -> DataFrame:
    return M.query_trend(_log(spark, d), AS_OF)


def history_last_n(spark: SparkSession, d: str) -> DataFrame:
    return M.last_n(table(spark, d, "events", "event_id", "ts", "user_id"), "user_id", 20, F.desc("ts"), F.desc("event_id"))


def rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    """Events of the same type in the hour before each event, itself included."""
    return M.rolling_count(table(spark, d, "events", "event_id", "ts", "event_type"), ["event_type"], 3_600_000_000, "n_last_hour").select("event_id", "n_last_hour")


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.latency_stats(table(spark, d, "events", "event_type", "value"), "event_type", "value")


def audit_query_page(spark: SparkSession, d: str) -> DataFrame:
    from quern.plans.predicates import audit

    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    when = audit(["error", "signup"], F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00")), F.to_timestamp_ntz(F.lit("2024-01-25 00:00:00")))
    return M.page(e, when, "event_id", 40, 20)


def status_rule(spark: SparkSession, d: str) -> DataFrame:
    """Status of a day's runs of each user, from counters of its events."""
    e = table(spark, d, "events", "ts", "user_id", "event_type")
    n = lambda *t: F.count_if(F.col("event_type").isin(*t)).alias("_".join(t))
    runs = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(n("view"), n("signup", "click"), n("purchase"), n("error"))
    chunks = F.col("signup_click") * F.when(F.col("error") > 1, 0).otherwise(2)
    return runs.select("user_id", "day", M.status_rule(F.col("view"), F.col("signup_click"), F.col("purchase"), chunks, F.col("error")).alias("status"))


def recovery_choice(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repositories", "repo_name", "source", "last_indexed_at", "branch", "local_path", "url")
    hours = F.timestamp_diff("HOUR", F.col("last_indexed_at"), F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00")))
    return r.select("repo_name", M.recovery_choice(F.col("source") == "local-folder", hours, F.col("branch"), F.col("local_path")).alias("choice"))


def guardrails(spark: SparkSession, d: str) -> DataFrame:
    """Size guardrails of each source over its live documents with the usual limits."""
    return size_guardrails(_sized(spark, d), "source")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "source", "file_size_bytes", "deleted_at").where("deleted_at is null").select("source", F.col("file_size_bytes").alias("bytes"))


def guardrails_small(spark: SparkSession, d: str) -> DataFrame:
    """The same with limits that these tables reach, forced and not."""
    limits = {"soft": (3, 20_000), "hard": (6, 60_000)}
    return size_guardrails(_sized(spark, d), "source", **limits).withColumnRenamed("verdict", "verdict_small").join(
        size_guardrails(_sized(spark, d), "source", True, **limits).select(F.col("source").alias("_s"), F.col("verdict").alias("forced")), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")


def folder_counters(spark: SparkSession, d: str) -> DataFrame:
    """What an indexing run reports for each folder: files, words in thousands as pieces, files without a text as failures."""
    docs = table(spark, d, "documents", "source", "word_count", "text").select("source", F.col("word_count").alias("chunks"), F.col("text").isNull().alias("failed"))
    return M.grouped_counters(docs, "source")


def table_listing(spark: SparkSession, d: str) -> DataFrame:
    """Index entries gathered by file as pieces of one table, with what the first piece says."""
    e = table(spark, d, "chroma_entries", "collection_name", "file_path", "chunk_index", "total_chunks", "lang")
    return M.table_listing(e, ["collection_name", "file_path"], "chunk_index", "total_chunks", "lang")


def table_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Stored pieces as cells of their document's table; those that start on a multiple of five are aligned."""
    c = table(spark, d, "document_chunks", "document_id", "start_offset").select("document_id", F.coalesce(F.col("start_offset") % 5 == 0, F.lit(False)).alias("aligned"))
    return M.table_confidence(c, ["document_id"])


QUERIES = {
    "update_metrics": update_metrics,
    "update_metrics_per_repo": update_metrics_per_repo,
    "update_trend": update_trend,
    "query_type_metrics": query_type_metrics,
    "history_last_n": history_last_n,
    "rolling_rate": rolling_rate,
    "latency_stats": latency_stats,
    "audit_query_page": audit_query_page,
    "status_rule": status_rule,
    "recovery_choice": recovery_choice,
    "guardrails": guardrails,
    "guardrails_small": guardrails_small,
    "query_trend": query_trend,
    "folder_counters": folder_counters,
    "table_listing": table_listing,
    "table_confidence": table_confidence,
}

_H = """h AS (SELECT event_id, ts, user_id, value AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS files,
  3 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunks, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events)"""
_M = """count(status) AS n_updates, round(coalesce(avg(duration_ms), 0), 6) AS avg_duration_ms, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks,
  round(coalesce(avg(CASE WHEN status = 'success' THEN 1.0::DOUBLE WHEN status IS NOT NULL THEN 0.0 END), 0), 6) AS success_rate,
  round(coalesce(avg(CASE WHEN status = 'success' THEN 0.0::DOUBLE WHEN status IS NOT NULL THEN 1.0 END), 0), 6) AS error_rate"""

SQL = {
    "update_metrics": f"WITH {_H} SELECT {_M} FROM h",
    "update_metrics_per_repo": f"WITH {_H} SELECT u.user_id, {_M} FROM (SELECT DISTINCT user_id FROM h) u LEFT JOIN (SELECT h.* FROM h JOIN events e ON e.event_id = h.event_id WHERE e.event_type IN ('error', 'purchase')) h ON u.user_id = h.user_id GROUP BY u.user_id",
    "update_trend": f"""WITH {_H} SELECT strftime(ts, '%Y-%m-%d') AS day, {_M} FROM h
WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1""",
    "query_type_metrics": f"""SELECT t.query_type, count(e.event_id) AS n, round(coalesce(avg(value), 0), 4) AS avg_duration, round(coalesce(min(value), 0), 4) AS min_duration,
  round(coalesce(max(value), 0), 4) AS max_duration, round(coalesce(avg(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE WHEN e.event_id IS NOT NULL THEN 0.0 END), 0), 6) AS hit_rate,
  round(coalesce(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0), 4) AS avg_results, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 17 = 0) AS n_errors
FROM (SELECT unnest({TYPES}) AS query_type) t LEFT JOIN events e ON e.event_type = t.query_type GROUP BY t.query_type""",
    "history_last_n": """SELECT event_id, ts, user_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT event_id, ts, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 20""",
    "rolling_rate": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_last_hour FROM events",
    "latency_stats": """SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(avg(value) FILTER (WHERE r = (n0 + 1) // 2 OR r = (n0 + 2) // 2), 4) AS median,
  max(value) FILTER (WHERE r = CAST(ceil(n0 * 95 / 100) AS BIGINT)) AS p95, max(value) FILTER (WHERE r = CAST(ceil(n0 * 99 / 100) AS BIGINT)) AS p99, round(stddev_pop(value), 4) AS stddev
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n0 FROM events WHERE value IS NOT NULL) GROUP BY event_type""",
    "audit_query_page": """WITH hits AS (SELECT event_id, ts, user_id, event_type FROM events WHERE event_type IN ('error', 'signup')
  AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00')
SELECT p.*, t.total, t.total > 60 AS has_more FROM (SELECT * FROM hits ORDER BY event_id LIMIT 20 OFFSET 40) p, (SELECT count(*) AS total FROM hits) t""",
    "status_rule": """SELECT user_id, day, CASE WHEN v > 0 AND am + del = 0 AND err = 0 THEN 'incomplete' WHEN am > 0 AND am * (CASE WHEN err > 1 THEN 0 ELSE 2 END) = 0 AND err > 0 THEN 'incomplete'
  WHEN err = 0 THEN 'success' WHEN am + del = 0 OR err >= am + del THEN 'failed' ELSE 'partial' END AS status
FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type IN ('signup', 'click')) AS am,
  count(*) FILTER (WHERE event_type = 'purchase') AS del, count(*) FILTER (WHERE event_type = 'error') AS err FROM events GROUP BY 1, 2)""",
    "recovery_choice": """SELECT repo_name, CASE WHEN source = 'local-folder' THEN 'resume' WHEN date_sub('hour', last_indexed_at, TIMESTAMP '2026-01-01 00:00:00') > 24 THEN 'full_reindex'
  WHEN branch IS NULL THEN 'full_reindex' WHEN local_path IS NULL THEN 'manual' ELSE 'resume' END AS choice FROM repositories""",
    "guardrails": """SELECT source, files, bytes, CASE WHEN files > 100000 OR bytes > 10::BIGINT * 1024 * 1024 * 1024 THEN 'refuse' WHEN files > 10000 OR bytes > 1024 * 1024 * 1024 THEN 'warn' ELSE 'ok' END AS verdict
FROM (SELECT source, count(*) AS files, CAST(coalesce(sum(file_size_bytes), 0) AS BIGINT) AS bytes FROM documents WHERE deleted_at IS NULL GROUP BY source)""",
    "guardrails_small": """SELECT source, files, bytes, CASE WHEN files > 6 OR bytes > 60000 THEN 'refuse' WHEN files > 3 OR bytes > 20000 THEN 'warn' ELSE 'ok' END AS verdict_small,
  CASE WHEN files > 3 OR bytes > 20000 THEN 'warn' ELSE 'ok' END AS forced
FROM (SELECT source, count(*) AS files, CAST(coalesce(sum(file_size_bytes), 0) AS BIGINT) AS bytes FROM documents WHERE deleted_at IS NULL GROUP BY source)""",
    "query_trend": f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 4) AS avg_duration FROM events
WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1""",
    "folder_counters": "SELECT source, count(*) AS n_files, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS n_chunks, count(*) FILTER (WHERE text IS NULL) AS n_failed FROM documents GROUP BY source",
    "table_listing": """SELECT collection_name, file_path, total_chunks, lang, n_chunks FROM (
  SELECT collection_name, file_path, total_chunks, lang, count(*) OVER (PARTITION BY collection_name, file_path) AS n_chunks,
    row_number() OVER (PARTITION BY collection_name, file_path ORDER BY chunk_index NULLS FIRST, total_chunks NULLS FIRST, lang NULLS FIRST) AS r FROM chroma_entries) WHERE r = 1""",
    "table_confidence": "SELECT document_id, round(count(*) FILTER (WHERE start_offset % 5 = 0) / count(*), 2) AS confidence FROM document_chunks GROUP BY document_id",
}
