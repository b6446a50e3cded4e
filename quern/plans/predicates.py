"""Metadata predicate trees and the other filters of the query tools, compiled to Columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import LANGUAGE_EXTENSIONS

_COMPARE = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),  # a missing key is unequal to every value
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
}


def compile_predicate(tree: Mapping[str, Any]) -> Column:
    """A ``$and/$or/$eq/$ne/$gt/$gte/$lt/$lte`` tree, or bare equality, as one boolean Column.

    Missing keys (nulls) satisfy ``$ne`` only. An empty tree keeps every row.
    """
    parts = []
    for key, value in tree.items():
        if key in ("$and", "$or"):
            if not value:
                raise ValueError(f"{key} needs at least one predicate")
            inner = [compile_predicate(x) for x in value]
            joined = inner[0]
            for x in inner[1:]:
                joined = joined & x if key == "$and" else joined | x
            parts.append(joined)
        elif isinstance(value, Mapping):
            for op, operand in value.items():
                if op not in _COMPARE:
                    raise ValueError(f"unknown operator {op}")
                parts.append(F.coalesce(_COMPARE[op](F.col(key), operand), F.lit(False)))
        else:
            parts.append(F.coalesce(F.col(key) == F.lit(value), F.lit(False)))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def document_types(kinds: str | Iterable[str] | None, column: str = "document_type") -> Column:
    """``all`` or nothing keeps every row; else the type must be among those given."""
    wanted = [kinds] if isinstance(kinds, str) else list(kinds or [])
    return F.lit(True) if not wanted or "all" in wanted else F.coalesce(F.col(column).isin(*wanted), F.lit(False))


def language(name: str, column: str = "file_extension") -> Column:
    """Rows whose extension belongs to a language; a language that is not known keeps every row."""
    wanted = LANGUAGE_EXTENSIONS.get(name.lower())
    return F.lit(True) if wanted is None else F.coalesce(F.lower(column).isin(*wanted), F.lit(False))


def folders(names: Iterable[str] | None, column: str = "folder") -> Column:
    """Rows of some folders; none named keeps every row, an empty list none (a search over no repository finds nothing)."""
    return F.lit(True) if names is None else F.coalesce(F.col(column).isin(*names), F.lit(False)) if (names := list(names)) else F.lit(False)


def table_mode(mode: str, column: str = "is_table") -> Column:
    """``include`` keeps all, ``only`` table chunks, ``exclude`` all but table chunks (missing = no table)."""
    is_table = F.coalesce(F.col(column), F.lit(False))
    return {"include": F.lit(True), "only": is_table, "exclude": ~is_table}[mode]


def glob_regex(pattern: Column | str) -> Column:
    """A glob as an anchored regular expression: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` inside a segment."""
    c = F.lit(pattern) if isinstance(pattern, str) else pattern
    for a, b in ((r"([.+^$()|{}\[\]])", r"\\$1"),):
        c = F.regexp_replace(c, a, b)
    for a, b in (("**/", "\u0001"), ("**", "\u0002"), ("*", "[^/]*"), ("?", "[^/]"), ("\u0001", "(.*/)?"), ("\u0002", ".*")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit("^"), c, F.lit("$"))


def matches_any(path: Column, patterns: Column) -> Column:
    """Whether any glob of an array matches; null and empty arrays match nothing."""
    return F.coalesce(F.exists(patterns, lambda p: F.regexp_like(path, glob_regex(p))), F.lit(False))


def watched(path: Column, include: Column, exclude: Column) -> Column:
    """Include and exclude globs of a watched folder: exclusion wins, no include pattern includes all."""
    any_included = F.coalesce(F.size(include) <= 0, F.lit(True)) | include.isNull() | matches_any(path, include)
    return any_included & ~matches_any(path, exclude)


def audit(
    types: Iterable[str] = (), start: Any = None, end: Any = None, token_prefix: str | None = None, email: str | None = None, success: bool | None = None, instance: str | None = None
) -> Column:
    """Audit-log filter: bounds are inclusive, criteria left out keep every row."""
    out = F.lit(True)
    if types := list(types):
        out &= F.col("event_type").isin(*types)
    if start is not None:
        out &= F.col("ts") >= F.lit(start)
    if end is not None:
        out &= F.col("ts") <= F.lit(end)
    if token_prefix:
        out &= F.col("token_hash").startswith(token_prefix)
    for column, value in (("email", email), ("success", success), ("instance", instance)):
        if value is not None:
            out &= F.col(column) == F.lit(value)
    return out


def images(
    folder: str | None = None, formats: Iterable[str] = (), date_from: Any = None, date_to: Any = None, min_width: int | None = None, min_height: int | None = None, filename: str | None = None
) -> Column:
    """Image filter: dates and sizes inclusive, ``filename`` a glob."""
    out = F.lit(True)
    if folder:
        out &= F.col("folder") == folder
    if formats := list(formats):
        out &= F.lower("format").isin(*[x.lower() for x in formats])
    if date_from is not None:
        out &= F.col("taken_at") >= F.lit(date_from)
    if date_to is not None:
        out &= F.col("taken_at") <= F.lit(date_to)
    if min_width:
        out &= F.col("width") >= min_width
    if min_height:
        out &= F.col("height") >= min_height
    if filename:
        out &= F.regexp_like(F.col("filename"), glob_regex(filename))
    return out


def scope_grants(granted: Column, required: Column) -> Column:
    """Whether granted scopes cover the required ones; ``admin`` grants all."""
    return F.array_contains(granted, "admin") | F.forall(required, lambda s: F.array_contains(granted, s))
