"""A knowledge base over snapshot tables: folders are registered, indexed, updated, searched and repaired.

Every table is a ``SnapshotTable`` under one root, so writes are whole versions. The work on files is Spark
jobs; the driver only handles a repository's counters.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.api import Engine, hashing_embedder
from quern.functions import text as T
from quern.operators import chunking, metrics
from quern.operators import maintenance as M
from quern.session import checkpointed
from quern.sources import files as S
from quern.sources.snapshots import SnapshotTable

_REPOSITORY = "repo_name string, root string, status string, include_extensions array<string>, exclude_patterns array<string>, file_count long, chunk_count long, last_indexed_at timestamp, update_in_progress boolean"
_HISTORY = "repo_name string, at timestamp, files_added long, files_modified long, files_deleted long, chunks_upserted long, duration_ms long, error_count long, status string"
_JOB = "job_id string, repo_name string, status string, started_at timestamp, finished_at timestamp, message string"


class UpdateRefused(RuntimeError):
    """An update or an index run that a guard forbids; the message names it."""


class KnowledgeBase:
    """Tables under ``root`` on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[str], Sequence[float]] | None = None, buckets: int = 16) -> None:
        self.spark, self.embed = spark, embed or hashing_embedder()
        at = root.rstrip("/")
        self.repositories = SnapshotTable(spark, f"{at}/repositories", ["repo_name"])
        self.manifest = SnapshotTable(spark, f"{at}/manifest", ["repository", "file_path"], buckets=buckets)
        self.chunks = SnapshotTable(spark, f"{at}/chunks", ["repository", "file_path", "chunk_index"], ["repository", "file_path"], buckets)
        self.history_table = SnapshotTable(spark, f"{at}/history", ["repo_name", "at"])
        self.jobs = SnapshotTable(spark, f"{at}/jobs", ["job_id"])

    # Registry

    def register_local_folder(self, root: str, name: str | None = None, include_extensions: Sequence[str] = (), exclude_patterns: Sequence[str] = ()) -> str:
        """Make a folder known as a repository; its name may hold no colon, as ids do."""
        name = name or root.rstrip("/").rsplit("/", 1)[-1]
        if not name or ":" in name:
            raise ValueError(f"not a repository's name: {name!r}")
        if self._find(name) is not None:
            raise ValueError(f"{name} is registered already")
        self._put((name, root, "registered", list(include_extensions), list(exclude_patterns), 0, 0, None, False))
        return name

    def _put(self, row: tuple) -> None:
        self.repositories.upsert(self.spark.createDataFrame([row], _REPOSITORY))

    def _find(self, name: str):
        return None if self.repositories.version() is None else self.repositories.read().where(F.col("repo_name") == name).first()

    def _one(self, name: str):
        if (r := self._find(name)) is None:
            raise LookupError(f"no repository {name}")
        return r

    def list_repositories(self) -> DataFrame:
        return self.repositories.read().orderBy("repo_name") if self.repositories.version() is not None else self.spark.createDataFrame([], _REPOSITORY)

    def list_watched_folders(self) -> DataFrame:
        """(repo_name, root, status, file_count, last_indexed_at, stale_hours) of all registered folders."""
        stale = F.timestamp_diff("HOUR", F.col("last_indexed_at"), F.current_timestamp())
        return self.list_repositories().select("repo_name", "root", "status", "file_count", "last_indexed_at", stale.alias("stale_hours"))

    # Files and chunks

    def _files(self, r) -> DataFrame:
        """(repository, file_path, content, hash, size, mtime) of a repository's eligible files, ignore files heeded."""
        found = S.scan(self.spark, r["root"], list(r["include_extensions"]) or None)
        found = S.apply_ignores(found, S.ignore_files(self.spark, r["root"]))
        if r["exclude_patterns"]:
            from quern.plans.predicates import matches_any

            found = found.where(~matches_any(F.col("relative_path"), F.array(*[F.lit(p) for p in r["exclude_patterns"]])))
        text = F.make_valid_utf8(F.col("content").cast("string"))
        return found.select(F.lit(r["repo_name"]).alias("repository"), F.col("relative_path").alias("file_path"), text.alias("content"), F.sha2("content", 256).alias("hash"), "size", F.col("modified_at").alias("mtime"))

    def _chunked(self, files: DataFrame) -> DataFrame:
        """(repository, file_path, chunk_index, content, start_line, end_line, file_extension, embedding) of files."""
        cut = chunking.chunk(files.where(F.col("content").isNotNull()).select("repository", "file_path", "content"), chunking.by_lines)
        embed = self.embed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vectors = [list(map(float, embed(t))) for t in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

        rows = cut.select("repository", "file_path", "chunk_index", "content", "start_line", "end_line", T.extension(F.col("file_path")).alias("file_extension"))
        return rows.mapInArrow(run, "repository string, file_path string, chunk_index int, content string, start_line int, end_line int, file_extension string, embedding array<float>")

    def _refresh(self, r, status: str) -> None:
        mine = F.col("repository") == r["repo_name"]
        n_files = self.manifest.read().where(mine).count()
        n_chunks = self.chunks.read().where(mine).count()
        self._put((r["repo_name"], r["root"], status, r["include_extensions"], r["exclude_patterns"], n_files, n_chunks, datetime.now(UTC), False))

    # Runs

    def index(self, name: str, force: bool = False) -> str:
        """Index a repository from scratch: size guardrails, chunks, first manifest, history; the verdict of the guardrails."""
        r = self._one(name)
        began = time.time()
        files = checkpointed(self._files(r))
        guard = M.size_guardrails(files.select("repository", F.col("size").alias("bytes")), "repository", force).first()
        verdict = guard["verdict"] if guard else "ok"
        if verdict == "refuse":
            raise UpdateRefused(f"{name} has {guard['files']} files and {guard['bytes']} bytes")
        changes = files.select("repository", F.col("file_path").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("added").alias("change"))
        if self.chunks.version() is not None:
            held = self.chunks.read().where(F.col("repository") == name).select("repository", "file_path").distinct()
            gone = held.join(files, ["repository", "file_path"], "left_anti")
            changes = changes.unionByName(gone.select("repository", F.col("file_path").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("deleted").alias("change")))
        self.chunks.apply(changes, self._chunked(files))
        read = files.where(F.col("content").isNotNull())
        manifest = M.initial_manifest(files, read, ["repository", "file_path"])
        if self.manifest.version() is not None:
            self.manifest.delete(self.manifest.read().where(F.col("repository") == name).select("repository", "file_path"))
        self.manifest.upsert(manifest)
        n, bad = files.count(), files.where(F.col("content").isNull()).count()
        self._log(name, n - bad, 0, 0, began, bad, n)
        self._refresh(r, "ready")
        return verdict

    def update(self, name: str, most_changes: int = 500) -> dict:
        """Bring a repository up to date by the difference between its manifest and its files."""
        r = self._one(name)
        if r["update_in_progress"]:
            raise UpdateRefused(f"an update of {name} is in progress; reset it if it was interrupted")
        if self.manifest.version() is None:
            raise UpdateRefused(f"{name} was never indexed")
        began = time.time()
        files = checkpointed(self._files(r))
        keys = ["repository", "file_path"]
        prior = self.manifest.read().where(F.col("repository") == name)
        diff = checkpointed(M.snapshot_diff(prior, files, keys).where("change != 'unchanged'"))
        n = {x["change"]: x["n"] for x in diff.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        moving = {k: n.get(k, 0) for k in ("added", "modified", "deleted")}
        if sum(moving.values()) > most_changes:
            raise UpdateRefused(f"{sum(moving.values())} changes are more than {most_changes}: index {name} anew")
        if not sum(moving.values()):
            return {"status": "drift_detected" if self.check_completeness(name) == "incomplete" else "no_changes", **moving}
        self._put((*[r[c] for c in ("repo_name", "root", "status", "include_extensions", "exclude_patterns", "file_count", "chunk_count", "last_indexed_at")], True))
        changed = diff.where("change in ('added', 'modified', 'deleted')")
        fresh = files.join(diff.where("change in ('added', 'modified')").select(*keys), keys, "left_semi")
        self.chunks.apply(changed.select("repository", F.col("file_path").alias("path"), F.lit(None).cast("string").alias("old_path"), "change"), self._chunked(fresh))
        self.manifest.upsert(files.join(diff.where("change != 'deleted'").select(*keys), keys, "left_semi").select(*keys, "hash", "size", "mtime"))
        self.manifest.delete(diff.where("change = 'deleted'").select(*keys))
        bad = fresh.where(F.col("content").isNull()).count()
        status = self._log(name, moving["added"], moving["modified"], moving["deleted"], began, bad, sum(moving.values()))
        self._refresh(r, "error" if status == "failed" else "ready")
        return {"status": status, **moving}

    def _log(self, name: str, added: int, modified: int, deleted: int, began: float, errors: int, eligible: int) -> str:
        done = added + modified - errors
        one = self.spark.range(1).select(metrics.status_rule(F.lit(eligible), F.lit(added + modified), F.lit(deleted), F.lit(done), F.lit(errors))).first()[0]
        row = self.spark.createDataFrame([(name, datetime.now(UTC), added, modified, deleted, done, int((time.time() - began) * 1000), errors, one)], _HISTORY)
        kept = row if self.history_table.version() is None else metrics.last_n(self.history_table.read().unionByName(row), "repo_name", 20, F.desc("at")).drop("rank")
        self.history_table.write(checkpointed(kept))
        return one

    def trigger_incremental_update(self, name: str) -> str:
        """Run an update as a job; its number, by which ``get_update_status`` tells how it ended."""
        job, began = f"update-{uuid.uuid4().hex[:12]}", datetime.now(UTC)
        self._one(name)
        try:
            status, message = "completed", str(self.update(name))
        except UpdateRefused as e:
            status, message = "failed", str(e)
        self.jobs.upsert(self.spark.createDataFrame([(job, name, status, began, datetime.now(UTC), message)], _JOB))
        return job

    def get_update_status(self, job: str) -> dict:
        found = None if self.jobs.version() is None else self.jobs.read().where(F.col("job_id") == job).first()
        if found is None:
            raise LookupError(f"no job {job}")
        return found.asDict()

    def reset_update(self, name: str) -> None:
        """Clear the mark of an update that was interrupted."""
        r = self._one(name)
        self._put((*[r[c] for c in ("repo_name", "root", "status", "include_extensions", "exclude_patterns", "file_count", "chunk_count", "last_indexed_at")], False))

    def check_completeness(self, name: str) -> str:
        """``complete`` or ``incomplete`` by the share of files on disk that the index lacks; ``empty`` without files."""
        disk = self._files(self._one(name)).where(F.col("content").rlike(r"\S")).select("repository", "file_path")
        index = self.chunks.read().where(F.col("repository") == name).select("repository", "file_path")
        row = M.completeness(disk, index, ["repository", "file_path"], "repository").first()
        return row["status"] if row else "empty"

    def repair(self, name: str) -> dict:
        """Embed what the index lacks, delete what it holds beyond the disk."""
        files = checkpointed(self._files(self._one(name)))
        disk = files.where(F.col("content").rlike(r"\S")).select("repository", "file_path")
        keys = ["repository", "file_path"]
        plan = checkpointed(M.repair_plan(disk, self.chunks.read().where(F.col("repository") == name).select(*keys), keys))
        fresh = files.join(plan.where("action = 'embed'").select(*keys), keys, "left_semi")
        n = {x["action"]: x["n"] for x in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        if n:
            changes = plan.select("repository", F.col("file_path").alias("path"), F.lit(None).cast("string").alias("old_path"), F.when(F.col("action") == "embed", "added").otherwise("deleted").alias("change"))
            self.chunks.apply(changes, self._chunked(fresh))
        return {"embedded": n.get("embed", 0), "deleted": n.get("delete", 0)}

    def remove(self, name: str) -> None:
        """Forget a repository with all its rows."""
        self._one(name)
        for table in (self.chunks, self.manifest):
            if table.version() is not None:
                table.delete(table.read().where(F.col("repository") == name).select(*table.keys))
        self.repositories.delete(self.spark.createDataFrame([(name,)], "repo_name string"))

    def history(self, name: str, limit: int = 20) -> DataFrame:
        self._one(name)
        return self.history_table.read().where(F.col("repo_name") == name).orderBy(F.desc("at")).limit(limit)

    def engine(self) -> Engine:
        """The query tools over the indexed chunks."""
        c = self.chunks.read().withColumn("id", T.chunk_id(F.col("repository"), F.col("file_path"), F.col("chunk_index")))
        return Engine(self.spark, c, self.list_repositories(), embed=self.embed)

    def search(self, query: str, limit: int = 10, threshold: float = 0.7, repository: str | None = None, language: str | None = None) -> DataFrame:
        return self.engine().semantic_search(query, limit, threshold, repository, language)
