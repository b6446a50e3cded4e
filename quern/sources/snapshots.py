"""Versioned snapshot tables: keyed writes over plain Parquet folders.

Rows lie in buckets by a hash of some columns. A version is a small commit file that names the folder of
each bucket; a write makes new folders for the buckets it touches and then creates the next commit file,
which must not exist yet. So readers see the old or the new version, an interrupted write leaves the table
as it was, and of two writers at once one gets an error instead of a lost update.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators import maintenance as M

_BUCKET = "_bucket"


class ConcurrentWrite(RuntimeError):
    """Another writer made the version that this one was about to make."""


class SnapshotTable:
    """A table at ``path`` on any file system Spark can write to, keyed by ``keys``, in ``buckets`` by a hash of ``bucket_by`` (the keys)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bucket_by: list[str] | None = None, buckets: int = 1, keep: int = 2) -> None:
        self.spark, self.path, self.keys, self.bucket_by, self.buckets, self.keep = spark, path.rstrip("/"), keys, bucket_by or keys, buckets, keep
        jvm = spark._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._p(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _commits(self) -> list[int]:
        return sorted(int(x) for x in self._names("commits") if x.isdigit())

    def _commit(self, v: int) -> dict | None:
        """What a version holds, None if its writer ended before the commit was whole."""
        found = self.spark.read.text(f"{self.path}/commits/{v}").first()
        try:
            return json.loads(found[0]) if found else None
        except ValueError:
            return None

    def _current(self) -> tuple[int, dict] | None:
        for v in reversed(self._commits()):
            if (c := self._commit(v)) is not None:
                return v, c
        return None

    def version(self) -> int | None:
        now = self._current()
        return now[0] if now else None

    def _rows(self, commit: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(commit["schema"])
        paths = [f"{self.path}/data/{folder}/{_BUCKET}={k}" for k, folder in commit["folders"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        now = self._current()
        if now is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self._rows(now[1])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.bucket_by]), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, now: tuple[int, dict] | None, touched: set[int] | None) -> int:
        """Write rows as the content of the touched buckets (all if None) and commit it on top of the version read before."""
        v = (self._commits() or [0])[-1] + 1
        if now is not None and v - 1 != now[0] and any(self._commit(x) for x in range(now[0] + 1, v)):
            raise ConcurrentWrite(f"{self.path} has moved on from version {now[0]}")
        folder = f"v{v}-{uuid.uuid4().hex[:12]}"
        df.withColumn(_BUCKET, self._bucket()).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{folder}")
        made = {x.removeprefix(f"{_BUCKET}="): folder for x in self._names(f"data/{folder}") if x.startswith(_BUCKET)}
        kept = {k: f for k, f in now[1]["folders"].items() if int(k) not in touched} if now is not None and touched is not None else {}
        commit = json.dumps({"schema": df.schema.jsonValue(), "folders": kept | made})
        try:
            self._fs.mkdirs(self._p(f"{self.path}/commits"))
            out = self._fs.create(self._p(f"{self.path}/commits/{v}"), False)
        except Exception as e:
            self._fs.delete(self._p(f"{self.path}/data/{folder}"), True)
            raise ConcurrentWrite(f"version {v} of {self.path} exists") from e
        out.write(bytearray(commit.encode()))
        out.close()
        self._clean(v)
        return v

    def _clean(self, v: int) -> None:
        """Drop the commits before the last ``keep`` and folders that only they name; folders of unfinished writes stay until then."""
        old = [x for x in self._commits() if x <= v - self.keep]
        if not old:
            return
        live = {f for x in self._commits() if x > v - self.keep and (c := self._commit(x)) for f in c["folders"].values()}
        for f in self._names("data"):
            made_at = int(f[1:].split("-")[0]) if f.startswith("v") else v
            if f not in live and made_at <= v - self.keep:
                self._fs.delete(self._p(f"{self.path}/data/{f}"), True)
        for x in old:
            self._fs.delete(self._p(f"{self.path}/commits/{x}"), False)

    def write(self, df: DataFrame) -> int:
        """Write all rows as the next version."""
        return self._write(df, self._current(), None)

    def _touched(self, keys: DataFrame) -> set[int]:
        """Buckets of some keys: at most as many numbers as the table has buckets."""
        return {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}

    def upsert(self, changes: DataFrame, newest: str | None = None) -> int:
        """Put changed rows in place of those with their key; of several changes the newest wins. Only their buckets are written."""
        now = self._current()
        if now is None:
            return self.write(M.fold(changes, self.keys, newest))
        touched = self._touched(changes)
        old = self._rows(now[1], touched)
        return self._write(M.upsert(old, changes.select(*old.columns), self.keys, newest), now, touched)

    def delete(self, keys: DataFrame) -> int:
        """Remove the rows whose key is listed. Only their buckets are written."""
        now = self._current()
        if now is None:
            raise FileNotFoundError(f"no version of {self.path}")
        touched = self._touched(keys)
        return self._write(M.delete(self._rows(now[1], touched), keys), now, touched)

    def apply(self, changes: DataFrame, fresh: DataFrame) -> int:
        """Apply an update's changes (see ``maintenance.apply_changes``); the table must be bucketed by (repository, path)."""
        now = self._current()
        if now is None:
            return self.write(fresh)
        repo, path = self.bucket_by
        touched = self._touched(M.touched(changes, (repo, path)).unionByName(fresh.select(repo, path)))
        return self._write(M.apply_changes(self._rows(now[1], touched), changes, fresh, (repo, path)), now, touched)

    def drop(self) -> None:
        """Remove the table with all its versions."""
        self._fs.delete(self._p(self.path), True)

    def get(self, predicate: dict) -> DataFrame:
        """Rows by a metadata predicate, which must not be empty."""
        from quern.plans.predicates import compile_predicate

        if not predicate:
            raise ValueError("a predicate is needed")
        return self.read().where(compile_predicate(predicate))


def export_table(df: DataFrame, path: str, kind: str) -> None:
    """Write a result as ``csv``, ``json`` or ``markdown``."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "markdown":
        from quern.functions.text import escape_cell

        cells = [escape_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + " --- |" * len(df.columns),)], "value string").coalesce(1)
        head.unionByName(df.select(line.alias("value"))).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown kind {kind}")
