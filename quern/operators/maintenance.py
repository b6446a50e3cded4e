"""Incremental maintenance: snapshot diff, event correlation, repair, keyed writes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import divergence_percent, extension, rename_confidence


def snapshot_diff(prior: DataFrame, current: DataFrame, keys: list[str], paranoid: bool = False) -> DataFrame:
    """(keys, change): a prior manifest against the current files, both (keys, hash, size, mtime).

    Equal size and time mean unchanged without a look at the hash unless ``paranoid``; else equal hashes
    mean only touched. A file that could not be hashed (null) counts as added or modified. Renames are not
    told apart here.
    """
    p = prior.select(*keys, F.col("hash").alias("_ph"), F.col("size").alias("_ps"), F.col("mtime").alias("_pm"), F.lit(True).alias("_was"))
    c = current.select(*keys, F.col("hash").alias("_ch"), F.col("size").alias("_cs"), F.col("mtime").alias("_cm"), F.lit(True).alias("_is"))
    same = F.col("_ps").eqNullSafe(F.col("_cs")) & F.col("_pm").eqNullSafe(F.col("_cm")) & F.lit(not paranoid)
    change = (
        F.when(F.col("_is").isNull(), "deleted")
        .when(F.col("_was").isNull(), "added")
        .when(same, "unchanged")
        .when(F.coalesce(F.col("_ph") == F.col("_ch"), F.lit(False)), "touched")
        .otherwise("modified")
    )
    return p.join(c, keys, "full").select(*keys, change.alias("change"))


def correlate_renames(unlinks: DataFrame, adds: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """(unlink_id, add_id, confidence): one-to-one pairs of an unlink and a later add of the same key in the window.

    Both are (id, keys, ts, size). Each add takes the latest unlink of its key that is still open, like a
    closing bracket its opening one: the level of an unlink is the number of unlinks less that of adds up to
    it, that of an add the one just before it, and on a level the two alternate. If the latest open unlink is
    out of the window, so are all before it. Unpaired unlinks are deletions, unpaired adds new files.
    """
    cols = [*keys, "ts", "size"]
    both = unlinks.select(F.col("id"), *cols, F.lit(0).alias("_kind")).unionByName(adds.select(F.col("id"), *cols, F.lit(1).alias("_kind")))
    order = ("ts", "_kind", "id")
    open_after = F.sum(1 - 2 * F.col("_kind")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    w = Window.partitionBy(*keys, "_level").orderBy(*order)
    prev = lambda c: F.lag(c).over(w)
    lagged = both.withColumn("_level", open_after + F.col("_kind")).select("*", prev("_kind").alias("_pk"), prev("id").alias("_pid"), prev("ts").alias("_pts"), prev("size").alias("_psize"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_pts").cast("timestamp"))) / 1000
    return lagged.where((F.col("_kind") == 1) & (F.col("_pk") == 0) & (gap <= window_ms)).select(
        F.col("_pid").alias("unlink_id"), F.col("id").alias("add_id"), rename_confidence(F.col("_psize"), F.col("size")).alias("confidence")
    )


def debounce(events: DataFrame, keys: list[str], quiet: str, order: str) -> DataFrame:
    """The last event of each burst: bursts of a key are parted by at least the quiet period; ``n`` events each."""
    return (
        events.groupBy(*keys, F.session_window("ts", quiet))
        .agg(F.max(F.struct("ts", F.col(order).alias("_o"))).alias("_l"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("_l._o").alias(order), F.col("_l.ts").alias("ts"), "n")
    )


def change_kinds(changes: DataFrame) -> DataFrame:
    """Change kinds of a commit comparison, unknown ones as modified."""
    s = F.lower("status")
    kind = F.when(s.isin("added", "a", "copied"), "added").when(s.isin("removed", "d", "deleted"), "deleted").when(s.startswith("r"), "renamed").otherwise("modified")
    return changes.withColumn("change", kind)


def parse_name_status(lines: DataFrame) -> DataFrame:
    """(status, path, old_path) of tab-separated name-status lines."""
    p = F.split("value", "\t")
    renamed = p[0].startswith("R")
    return lines.where(F.size(p) >= 2).select(
        F.when(renamed, "renamed").when(p[0] == "A", "added").when(p[0] == "D", "removed").otherwise("modified").alias("status"),
        F.when(renamed, F.try_element_at(p, F.lit(3))).otherwise(p[1]).alias("path"),
        F.when(renamed, p[1]).alias("old_path"),
    )


def included(extensions: Column, defaults: list[str]) -> Column:
    """A repository's extensions in lower case, the defaults where it names none (null or empty)."""
    return F.when(F.coalesce(F.size(extensions), F.lit(0)) > 0, F.transform(extensions, F.lower)).otherwise(F.array(*[F.lit(x) for x in defaults]))


def eligible(path: Column, include: Column, excluded: Column) -> Column:
    """Whether a change matters: its extension is included and no pattern excludes it."""
    return F.array_contains(include, extension(path)) & ~excluded


def count_eligible(changes: DataFrame, condition: Column, *by: str) -> DataFrame:
    """Totals of eligible and filtered changes."""
    ok = F.coalesce(condition, F.lit(False))
    return changes.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("filtered"))


def repair_diagnosis(disk: DataFrame, index: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Per group: files on disk and in the index, missing, extra, and the state of the index."""
    a = disk.select(*keys).distinct().withColumn("_d", F.lit(True))
    b = index.select(*keys).distinct().withColumn("_i", F.lit(True))
    counts = a.join(b, keys, "full").groupBy(by).agg(
        F.count("_d").alias("n_disk"), F.count("_i").alias("n_index"), F.count_if(F.col("_i").isNull()).alias("n_missing"), F.count_if(F.col("_d").isNull()).alias("n_extra")
    )
    state = F.when(F.col("n_missing") > 0, "missing_files").when(F.col("n_extra") > 0, "metadata_drift").otherwise("complete")
    return counts.withColumn("status", state)


def completeness(disk: DataFrame, index: DataFrame, keys: list[str], by: str, most_percent: float = 20.0, most_files: int = 50) -> DataFrame:
    """Per group: missing files, their share in percent, and whether the index is complete enough."""
    d = repair_diagnosis(disk, index, keys, by).where("n_disk > 0")
    p = divergence_percent(F.col("n_missing"), F.col("n_disk"))
    return d.select(by, F.col("n_disk").alias("eligible"), "n_missing", p.alias("missing_percent"), F.when((p > most_percent) | (F.col("n_missing") > most_files), "incomplete").otherwise("complete").alias("status"))


def reap(manifests: DataFrame, owners: DataFrame, on: list[str]) -> DataFrame:
    """Manifests whose owner is gone."""
    return manifests.join(owners.select(*on).distinct(), on, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """The table with changed rows in place of those with their key; of several the newest wins, ties and all else by the greatest row."""
    changes = fold(changes, keys, newest)
    return table.join(changes.select(*keys), keys, "left_anti").select(*changes.columns).unionByName(changes)


def fold(rows: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """One row a key: the newest, of equals the greatest by its other columns; folded before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    first = [newest] if newest else []
    best = F.max(F.struct(*first, *[c for c in rest if c not in first])).alias("_v")
    return rows.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"_v.{c}") for c in rows.columns])


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the rows whose key is listed."""
    return table.join(keys.distinct(), keys.columns, "left_anti").select(*table.columns)


def latest(df: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """The newest delivery of each key, folded before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(newest)).alias("_v")).select(*keys, "_v.*")


def touched(changes: DataFrame, keys: tuple[str, str] = ("repository", "file_path")) -> DataFrame:
    """The files (keys) whose pieces an update clears: every changed path and every old one, also of added files."""
    repo, path = keys
    now = changes.select(F.col("repository").alias(repo), F.col("path").alias(path))
    return now.unionByName(changes.where(F.col("old_path").isNotNull()).select(F.col("repository").alias(repo), F.col("old_path").alias(path))).distinct()


def apply_changes(chunks: DataFrame, changes: DataFrame, fresh: DataFrame, keys: tuple[str, str] = ("repository", "file_path")) -> DataFrame:
    """Chunks after an update: pieces of all files that changes name go, those of ``fresh`` come in; applied again it gives the same.

    ``changes`` is (repository, path, old_path, change); ``fresh`` holds the new chunks of added, modified and
    renamed files. A path only means the file of its own repository.
    """
    gone = touched(changes, keys)
    return chunks.join(gone, list(keys), "left_anti").select(*chunks.columns).unionByName(fresh, allowMissingColumns=True)


# Guards of an update run


def volume_guard(changes: DataFrame, by: str, most: int = 500) -> DataFrame:
    """(by, n_changes, verdict): repositories with more changes than an update takes need a full run."""
    n = changes.groupBy(by).agg(F.count(F.lit(1)).alias("n_changes"))
    return n.withColumn("verdict", F.when(F.col("n_changes") > most, "full_reindex").otherwise("update"))


def base_commit_guard(repositories: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_name, base, state): ``missing`` if the commit an update starts from is not among the repository's, ``none`` before the first run."""
    known = commits.select("repo_name", F.col("sha").alias("base")).distinct().withColumn("_there", F.lit(True))
    state = F.when(F.col("base").isNull(), "none").when(F.col("_there"), "present").otherwise("missing")
    return repositories.select("repo_name", "base").join(known, ["repo_name", "base"], "left").select("repo_name", "base", state.alias("state"))


def drift(changes: DataFrame, completeness: DataFrame, by: str) -> DataFrame:
    """(by, status): ``changes`` if there are any, else ``drift_detected`` where the index is incomplete, else ``no_changes``."""
    n = changes.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    state = F.when(F.col("_n").isNotNull(), "changes").when(F.col("status") == "incomplete", "drift_detected").otherwise("no_changes")
    return completeness.select(by, "status").join(n, by, "full").select(by, state.alias("status"))


def dimension_guard(stored: DataFrame, repositories: DataFrame, default: tuple[str, str, int]) -> DataFrame:
    """(repo_name, provider, model, dimensions, stored_dimensions, verdict): the collection's embedder, else the repository's, else the default.

    ``stored`` is (repo_name, provider, model, dimensions) of the collections, ``repositories`` the same of the
    registry, nulls where nothing is known. A collection whose vectors have another size is a ``mismatch``.
    """
    s = stored.select("repo_name", F.col("provider").alias("_p"), F.col("model").alias("_m"), F.col("dimensions").alias("_d"))
    j = repositories.join(s, "repo_name", "left")
    provider, model, size = (F.coalesce(a, b, F.lit(c)) for a, b, c in zip(("_p", "_m", "_d"), ("provider", "model", "dimensions"), default, strict=True))
    own = F.coalesce("dimensions", F.lit(default[2]))
    return j.select(
        "repo_name", provider.alias("provider"), model.alias("model"), size.alias("dimensions"), F.col("_d").alias("stored_dimensions"),
        F.when(F.col("_d").isNull(), "new").when(F.col("_d") == own, "ok").otherwise("mismatch").alias("verdict"),
    )


def size_guardrails(files: DataFrame, by: str, force: bool = False, soft: tuple[int, int] = (10_000, 1 << 30), hard: tuple[int, int] = (100_000, 10 << 30)) -> DataFrame:
    """(by, files, bytes, verdict) of the eligible files of each folder: above the soft limits a warning, above the hard ones a refusal unless forced."""
    sized = files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    above = lambda limit: (F.col("files") > limit[0]) | (F.col("bytes") > limit[1])
    return sized.withColumn("verdict", F.when(above(hard) & F.lit(not force), "refuse").when(above(soft), "warn").otherwise("ok"))


def unchanged(files: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict): ``skip`` where the stored hash of the whole file is that of the content, else ``process``; no content is ``missing``."""
    s = stored.select(*keys, F.col("hash").alias("_h")).where(F.col("_h").isNotNull()).groupBy(*keys).agg(F.max("_h").alias("_h"))
    h = F.sha2("content", 256)
    return files.join(s, keys, "left").select(*keys, F.when(F.col("content").isNull(), "missing").when(h == F.lower("_h"), "skip").otherwise("process").alias("verdict"))


def initial_manifest(files: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hash, size, mtime): the first manifest holds only files that were really processed."""
    return files.join(processed.select(*keys).distinct(), keys, "left_semi").select(*keys, "hash", "size", "mtime")


def repair_plan(disk: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action): ``embed`` for files that the index lacks, ``delete`` for those it holds beyond the disk."""
    a = disk.select(*keys).distinct().withColumn("_d", F.lit(True))
    b = index.select(*keys).distinct().withColumn("_i", F.lit(True))
    return a.join(b, keys, "full").where(F.col("_d").isNull() | F.col("_i").isNull()).select(*keys, F.when(F.col("_i").isNull(), "embed").otherwise("delete").alias("action"))


def debounce_max_wait(events: DataFrame, keys: list[str], order: str, quiet_ms: int = 2000, most_ms: int = 30_000) -> DataFrame:
    """(keys, fired_at, order, n): bursts as in ``debounce``, but a piece of one fires at the latest ``most_ms`` after its first event.

    The next event behind that begins a new piece, so pieces depend on order: the events of a burst, sorted by
    the shuffle, stream through one fold that only keeps the open piece. Bursts, not keys, are what a task holds.
    """
    w = Window.partitionBy(*keys).orderBy("_at", order)
    gap = F.coalesce(F.col("_at") - F.lag("_at").over(w) >= quiet_ms, F.lit(True)).cast("int")
    marked = events.select(*keys, F.col(order), F.unix_millis(F.col("ts").cast("timestamp")).alias("_at")).withColumn("_new", gap)
    bursts = marked.withColumn("_burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    many = bursts.repartition(*keys, "_burst").sortWithinPartitions(*keys, "_burst", "_at", order)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # burst's key, start, last time, last order value, events
        for b in batches:
            done = []
            cols = [c.to_pylist() for c in b.columns]
            for *key, last, at, burst in zip(*cols, strict=True):
                at_key = (*key, burst)
                if held and held[0] == at_key and at - held[1] < most_ms:
                    held[2], held[3], held[4] = at, last, held[4] + 1
                    continue
                if held:
                    done.append(held)
                held = [at_key, at, at, last, 1]
            yield _pieces(done, b.schema)
        if held:
            yield _pieces([held], b.schema)

    def _pieces(done: list, like: pa.Schema) -> pa.RecordBatch:
        cols = [pa.array([d[0][k] for d in done], like.field(k).type) for k in range(n)]
        fired = pa.array([min(d[2] + quiet_ms, d[1] + most_ms) for d in done], pa.int64())
        return pa.RecordBatch.from_arrays([*cols, fired, pa.array([d[3] for d in done], like.field(n).type), pa.array([d[4] for d in done], pa.int64())], [*keys, "fired_at", order, "n"])

    kinds = "".join(f"{c} {events.schema[c].dataType.simpleString()}, " for c in keys)
    return many.mapInArrow(run, f"{kinds}fired_at long, {order} {events.schema[order].dataType.simpleString()}, n long")


def route_events(events: DataFrame, folders: DataFrame) -> DataFrame:
    """Events with the ``repository`` of the deepest folder that holds their path; events outside all folders drop out.

    Paths meet folders by their prefixes in an equi-join, so a hot folder is only a hot join key.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder")))
    id_cols = events.columns
    f = folders.select(F.rtrim("folder_path", F.lit("/")).alias("folder"), "repository")
    hit = events.withColumn("_p", F.explode(prefixes)).withColumns({"folder": F.col("_p.folder"), "_n": F.col("_p.n")}).join(f, "folder")
    return hit.groupBy(*id_cols).agg(F.max(F.struct("_n", "repository")).alias("_r")).select(*id_cols, F.col("_r.repository").alias("repository"))


def split_oversized(chunks: DataFrame, configured: int = 500) -> tuple[DataFrame, DataFrame]:
    """(chunks that can be embedded, errors): the bound is twice the configured size, between 6,000 and 8,000 tokens."""
    bound = min(8000, max(6000, 2 * configured))
    too_big = F.col("tokens") > bound
    return chunks.where(~too_big), chunks.where(too_big).select("*", F.concat(F.lit("chunk of "), F.col("tokens").cast("string"), F.lit(f" tokens exceeds {bound}")).alias("error"))
