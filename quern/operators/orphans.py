"""References to records that do not exist: direct orphans and the cascade below them.

A reference is *direct*ly orphaned if no live target row with its key was there in time; a row whose
target exists but is itself orphaned is an *inherited* orphan. The cascade is a fixpoint of semi-joins
down the foreign-key graph. When the graph of tables has no cycle, its depth bounds the number of
rounds and the whole fixpoint is one lazy plan; with cycles the rounds run until no new row turns up.

Defined results
* null references are no cases; the empty string is a reference like any other;
* a target with ``deleted_at`` set never counts, one with a null time counts as never there;
* a referring row without a time cannot be shown to be too early, so only the target's existence counts
  and its month is null;
* a row delivered several times is reported once (with its earliest month);
* empty tables give empty results (all references into an empty table are orphans).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import checkpointed

_UUID = r"^(?:\{[0-9a-fA-F]{4}(?:-?[0-9a-fA-F]{4}){7}\}|[0-9a-fA-F]{4}(?:-?[0-9a-fA-F]{4}){7})$"


def uuid_key(c: Column) -> Column:
    """Join key under which two texts are equal iff PostgreSQL reads them as the same UUID.

    Hex digits in any case, optional braces, an optional hyphen after each group of four. Other texts
    are kept as they are, behind a prefix no UUID key has, so they only equal themselves.
    """
    return F.when(c.rlike(_UUID), F.lower(F.translate(c, "{}-", ""))).otherwise(F.concat(F.lit("="), c))


@dataclass(frozen=True)
class Entity:
    """A table in the foreign-key graph; ``row_id`` names its rows in the report."""

    df: DataFrame
    row_id: str
    time: str
    deleted: str | None = None


@dataclass(frozen=True)
class Reference:
    """``table.field`` points to ``target.key``; ``as_uuid`` compares both as UUIDs."""

    table: str
    field: str
    target: str
    key: str
    as_uuid: bool = True


def _key(name: str, as_uuid: bool) -> Column:
    c = F.col(name).cast("string")
    return uuid_key(c) if as_uuid else c


def _refs(e: Entity, r: Reference) -> DataFrame:
    return e.df.select(
        F.col(e.row_id).cast("string").alias("row_id"),
        F.col(e.time).alias("_ref_time"),
        _key(r.field, r.as_uuid).alias("_key"),
    ).where(F.col("_key").isNotNull())


def _live(e: Entity, r: Reference) -> DataFrame:
    """Per key the earliest live target: one row a key, combined before the shuffle."""
    df = e.df if e.deleted is None else e.df.where(F.col(e.deleted).isNull())
    return (
        df.select(_key(r.key, r.as_uuid).alias("_key"), F.col(e.time).alias("_t"))
        .where(F.col("_key").isNotNull() & F.col("_t").isNotNull())
        .groupBy("_key")
        .agg(F.min("_t").alias("_there"))
    )


def direct_orphans(entities: Mapping[str, Entity], references: Sequence[Reference]) -> DataFrame:
    """(ref_table, ref_field, row_id, ref_month) of every reference without a live, timely target.

    The target side has one row a key, so a hot key can only swell the referring side, which the
    adaptive skew join splits; duplicates of a referring row are folded after the join, when only
    orphans are left.
    """
    out = None
    for r in references:
        e = entities[r.table]
        missing = (
            _refs(e, r)
            .join(_live(entities[r.target], r), "_key", "left")
            .where(F.col("_there").isNull() | (F.col("_there") > F.col("_ref_time")))
            .groupBy("row_id")
            .agg(F.min("_ref_time").alias("_t"))
            .select(
                F.lit(r.table).alias("ref_table"),
                F.lit(r.field).alias("ref_field"),
                "row_id",
                F.date_format("_t", "yyyy-MM").alias("ref_month"),
            )
        )
        out = missing if out is None else out.unionByName(missing)
    return out


def _depth(references: Sequence[Reference]) -> int | None:
    """Longest chain of tables in the foreign-key graph, None if it has a cycle."""
    edges: dict[str, set[str]] = {}
    for r in references:
        edges.setdefault(r.table, set()).add(r.target)
    best: dict[str, int] = {}

    def walk(t: str, on_path: frozenset[str]) -> int:
        if t in on_path:
            raise RecursionError
        if t not in best:
            best[t] = 1 + max((walk(n, on_path | {t}) for n in edges.get(t, ())), default=0)
        return best[t]

    try:
        return max((walk(t, frozenset()) for t in edges), default=0)
    except RecursionError:
        return None


def _children(entities: Mapping[str, Entity], references: Sequence[Reference], frontier: DataFrame) -> DataFrame | None:
    """Rows whose reference leads to a live row in the frontier (ref_table, row_id)."""
    out = None
    for r in references:
        target, e = entities[r.target], entities[r.table]
        tdf = target.df if target.deleted is None else target.df.where(F.col(target.deleted).isNull())
        orphaned = (
            tdf.select(F.col(target.row_id).cast("string").alias("row_id"), _key(r.key, r.as_uuid).alias("_key"))
            .where(F.col("_key").isNotNull())
            .join(frontier.where(F.col("ref_table") == r.target).select("row_id").distinct(), "row_id", "left_semi")
            .select("_key")
            .distinct()
        )
        hit = (
            _refs(e, r)
            .join(orphaned, "_key", "left_semi")
            .groupBy("row_id")
            .agg(F.min("_ref_time").alias("_t"))
            .select(
                F.lit(r.table).alias("ref_table"),
                F.lit(r.field).alias("ref_field"),
                "row_id",
                F.date_format("_t", "yyyy-MM").alias("ref_month"),
            )
        )
        out = hit if out is None else out.unionByName(hit)
    return out


#: Rounds of a cyclic cascade after which its pieces are written as one.
COMPACT = 16


def orphan_cascade(entities: Mapping[str, Entity], references: Sequence[Reference], keep: bool = True) -> DataFrame:
    """Direct and inherited orphans: (ref_table, ref_field, row_id, ref_month, kind, depth).

    ``kind`` is ``direct`` (depth 0) or ``inherited`` (depth = number of references up to the nearest
    row that is directly orphaned). A reference that is direct is not reported as inherited as well.
    The direct orphans go through the checkpoint folder, as every round starts from them, unless ``keep`` is off,
    for those who only take the direct ones. Without a cycle
    the rounds are a lazy plan; in a cyclic graph each round's new rows are checkpointed, alone, until
    a round brings none, however deep the chain.
    """
    keys = ["ref_table", "ref_field", "row_id"]
    depth = _depth(references)
    direct = direct_orphans(entities, references)
    if keep or depth is None:
        direct = checkpointed(direct)
    out = direct.withColumns({"kind": F.lit("direct"), "depth": F.lit(0)})
    frontier = direct.select("ref_table", "row_id").distinct()
    known = frontier
    step = 0
    while depth is None or step < depth - 1:
        step += 1
        fresh = _children(entities, references, frontier).join(out.select(keys), keys, "left_anti").withColumns({"kind": F.lit("inherited"), "depth": F.lit(step)})
        if depth is None:
            fresh = checkpointed(fresh)
            if fresh.isEmpty():
                break
        out = out.unionByName(fresh)
        frontier = fresh.select("ref_table", "row_id").distinct().join(known, ["ref_table", "row_id"], "left_anti")
        if depth is None:
            frontier = checkpointed(frontier)
        known = known.unionByName(frontier)
        if depth is None and step % COMPACT == 0:  # keeps the plans short: the pieces become one
            out, known = checkpointed(out), checkpointed(known)
    return out


def orphan_report(cascade: DataFrame) -> DataFrame:
    """Orphans per table, field and month, direct and inherited."""
    return cascade.groupBy("ref_table", "ref_field", "ref_month").agg(
        F.count_if(F.col("kind") == "direct").alias("n_direct"),
        F.count_if(F.col("kind") == "inherited").alias("n_inherited"),
        F.count(F.lit(1)).alias("n_orphans"),
    )
