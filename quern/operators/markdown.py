"""Markdown structure: front matter, sections, links, code spans, tables, and their resolution.

Parsing one document needs its lines in order and runs in Arrow batches; everything that relates
documents to each other (links, mentions) is a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T

_FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
_LINK = re.compile(r"(?<!!)\[([^\]\[]*)\]\(\s*<?([^\s<>()]+)>?(?:\s+[\"'][^\"']*[\"'])?\s*\)")
_AUTO = re.compile(r"<(https?://[^>\s]+)>")
_WIKI = re.compile(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]")
_SPAN = re.compile(r"(`+)([^`\n]+?)\1(?!`)")
_RULE = re.compile(r"^\s*\|?\s*:?-{1,}:?\s*(?:\|\s*:?-{1,}:?\s*)*\|?\s*$")
_CAPTION = re.compile(r"^\*\*Table: (.+)\*\*$")


@dataclass
class Parsed:
    """Front matter, sections (title, level, start, end, parent), links and code spans with offsets, tables."""

    meta: dict[str, str] = field(default_factory=dict)
    sections: list[tuple[str, int, int, int, int]] = field(default_factory=list)
    links: list[tuple[str, str, int]] = field(default_factory=list)
    spans: list[tuple[str, int]] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)


def cells_of(line: str) -> list[str]:
    """Cells of a table row; an escaped pipe does not divide."""
    body = line.strip()
    body = body[1:] if body.startswith("|") else body
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    return [c.strip().replace("\\|", "|").replace("\\\\", "\\") for c in re.split(r"(?<!\\)\|", body)]


def parse_table(lines: list[str]) -> dict | None:
    """{caption, header, rows, columns} of a Markdown table: the header stands before the rule."""
    caption = None
    for i, line in enumerate(lines):
        if m := _CAPTION.match(line.strip()):
            caption = m.group(1)
        if i and "|" in lines[i - 1] and "-" in line and _RULE.match(line):
            header = cells_of(lines[i - 1])
            rows = []
            for row in lines[i + 1 :]:
                if "|" not in row:
                    break
                if not _RULE.match(row):
                    c = cells_of(row)
                    rows.append((c + [""] * len(header))[: len(header)])
            return {"caption": caption, "header": header, "rows": rows, "columns": len(header)}
    return None


def reassemble(chunks: list[str]) -> dict | None:
    """One table from its chunks: header and caption of the first, rows of all."""
    parts = [p for c in chunks if (p := parse_table(c.split("\n")))]
    return parts[0] | {"rows": [r for p in parts for r in p["rows"]]} if parts else None


def parse(text: str | None) -> Parsed:
    """The structure of a Markdown text; offsets are code points, sections end where the next begins."""
    out = Parsed()
    if not text:
        return out
    start = 0
    if m := _FRONT.match(text):
        for line in m.group(1).splitlines():
            key, sep, value = line.partition(":")
            if sep and key.strip() and not line[:1].isspace():
                out.meta[key.strip()] = value.strip().strip("\"'")
        start = m.end()
    fence: str | None = None
    heads: list[tuple[str, int, int]] = []
    at = 0
    table: list[str] = []
    table_at = -1
    previous = ""
    for line in text.split("\n"):
        here, at = at, at + len(line) + 1
        if here < start:
            continue
        if m := _FENCE.match(line):
            fence = None if fence and line.strip().startswith(fence) else fence or m.group(1)
            continue
        if fence:
            continue
        if table and "|" in line:
            table.append(line)
        else:
            if table:
                out.tables.append(parse_table(table) | {"offset": table_at})
                table = []
            if "|" in previous and "-" in line and _RULE.match(line) and "|" in line + previous:
                table, table_at = [previous, line], here - len(previous) - 1
        previous = line
        if m := _HEADING.match(line):
            heads.append((m.group(2), len(m.group(1)), here))
        for m in _LINK.finditer(line):
            out.links.append((m.group(2), m.group(1), here + m.start()))
        for m in _AUTO.finditer(line):
            out.links.append((m.group(1), m.group(1), here + m.start()))
        for m in _WIKI.finditer(line):
            out.links.append(("[[" + m.group(1).strip(), m.group(1).strip(), here + m.start()))
        for m in _SPAN.finditer(line):
            out.spans.append((m.group(2).strip(), here + m.start()))
    if table:
        out.tables.append(parse_table(table) | {"offset": table_at})
    stack: list[int] = []
    for i, (title, level, pos) in enumerate(heads):
        while stack and heads[stack[-1]][1] >= level:
            stack.pop()
        out.sections.append((title, level, pos, heads[i + 1][2] if i + 1 < len(heads) else len(text), stack[-1] if stack else -1))
        stack.append(i)
    return out


def table_chunks(table: dict, max_tokens: int = 500) -> list[str]:
    """A table as Markdown: whole if it fits, else rows in parts that each repeat caption and header."""
    esc = lambda c: c.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    row = lambda r: "| " + " | ".join(map(esc, r)) + " |"
    cost = lambda s: -(-len(s) // 4)
    head = ([f"**Table: {table['caption']}**", ""] if table.get("caption") else []) + [row(table["header"]), "|" + " --- |" * table["columns"]]
    rows = [row(r) for r in table["rows"]]
    whole = "\n".join([*head, *rows])
    if cost(whole) <= max_tokens or not rows:
        return [whole]
    budget = max(1, max_tokens - cost("\n".join(head)))
    out: list[str] = []
    part: list[str] = []
    used = 0
    for r in rows:
        if part and used + cost(r) > budget:
            out.append("\n".join([*head, *part]))
            part, used = [], 0
        part.append(r)
        used += cost(r)
    return [*out, "\n".join([*head, *part])]


def expand_cells(cells: list[dict], columns: int) -> list[str]:
    """A row's cell texts, spans filled with empties, cut or padded to the number of columns."""
    out: list[str] = []
    for c in cells:
        out += [c["content"], *[""] * (max(1, c.get("colSpan") or 1) - 1)]
    return (out + [""] * columns)[:columns]


def _exploded(docs: DataFrame, schema: str, rows) -> DataFrame:
    """One pass over (doc_id, text): whatever ``rows(parsed, text)`` yields, with the id before it."""
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *r) for i, t in enumerate(b.column(1).to_pylist()) for r in rows(parse(t), t)]
            cols = list(zip(*found, strict=True)) if found else [[] for _ in range(len(fields) + 1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, kinds[t]) for c, (_, t) in zip(cols[1:], fields, strict=True))], ["doc_id", *(n for n, _ in fields)]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, title, level, start_offset, end_offset, parent): parent is -1 at the top."""
    return _exploded(docs, "section int, title string, level int, start_offset int, end_offset int, parent int", lambda p, t: [(i, *s) for i, s in enumerate(p.sections)])


def links(docs: DataFrame) -> DataFrame:
    """(doc_id, target, label, offset, section, wiki): links with the deepest section that holds them."""

    def rows(p: Parsed, _):
        for target, label, at in p.links:
            wiki = target.startswith("[[")
            yield target[2:] if wiki else target, label, at, section_at(p, at), wiki

    return _exploded(docs, "target string, label string, offset int, section int, wiki boolean", rows)


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, name, offset, section, confidence): code spans that look like identifiers (high), prose names (low)."""

    def rows(p: Parsed, text):
        seen = set()
        for name, at in p.spans:
            if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", name) and len(name) >= 4 and re.search(r"^.+[A-Z]", name):
                yield name, at, section_at(p, at), "high"
        for m in re.finditer(r"\b[A-Za-z][A-Za-z0-9_]{3,}\b", text or ""):
            s = section_at(p, m.start())
            if re.search(r"^.+[A-Z]", m.group()) and (m.group(), s) not in seen:
                seen.add((m.group(), s))
                yield m.group(), m.start(), s, "low"

    return _exploded(docs, "name string, offset int, section int, confidence string", rows)


def section_at(p: Parsed, at: int) -> int:
    """Index of the deepest section that holds an offset, the first of equals; -1 outside."""
    best = -1
    for i, (_, level, a, _, _) in enumerate(p.sections):
        end = next((s[2] for s in p.sections[i + 1 :] if s[1] <= level), None)
        if a <= at and (end is None or at < end) and (best < 0 or level > p.sections[best][1]):
            best = i
    return best


def titles(docs: DataFrame) -> DataFrame:
    """(doc_id, title): front matter's title, else the first heading of level one, else the file's stem."""
    found = _exploded(docs, "meta string, heading string", lambda p, t: [(p.meta.get("title"), next((s[0] for s in p.sections if s[1] == 1), None))])
    stem = F.regexp_replace(T.display_name(F.col("file_path")), r"\.[^.]*$", "")
    return docs.select("doc_id", "file_path").join(found, "doc_id").select("doc_id", F.coalesce("meta", "heading", stem).alias("title"))


def tables(docs: DataFrame, max_tokens: int = 500) -> DataFrame:
    """(doc_id, table_index, part, content, caption, columns, rows): the documents' tables as chunks."""

    def rows(p: Parsed, _):
        for i, t in enumerate(p.tables):
            for k, c in enumerate(table_chunks(t, max_tokens)):
                yield i, k, c, t["caption"], t["columns"], len(t["rows"])

    return _exploded(docs, "table_index int, part int, content string, caption string, columns int, rows int", rows)


def resolve_links(found: DataFrame, docs: DataFrame, section_index: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links with ``node``, ``kind``: wiki links by title, stem, section, symbol; others by path, stem, else external.

    ``found`` is ``links`` with repository and file_path; ``docs`` (repository, file_path, title, node),
    ``section_index`` (repository, title, node), ``symbols`` (repository, name, node). On a key held twice the
    first node by id wins. Unresolved wiki links give no row.
    """
    key = lambda r, n: F.concat_ws("\u0001", F.col(r) if isinstance(r, str) else r, F.lower(n))
    stem = F.regexp_replace(T.display_name(F.col("file_path")), r"\.[^.]*$", "")
    path = docs.select(F.concat_ws("\u0001", "repository", "file_path").alias("_path"), F.col("node").alias("by_path"))
    by_path = path.groupBy("_path").agg(F.min("by_path").alias("by_path"))
    by_title = docs.select(key("repository", F.col("title")).alias("_k"), "node").groupBy("_k").agg(F.min("node").alias("by_title"))
    by_stem = docs.select(key("repository", stem).alias("_k"), "node").groupBy("_k").agg(F.min("node").alias("by_stem"))
    by_section = section_index.select(key("repository", F.col("title")).alias("_k"), "node").groupBy("_k").agg(F.min("node").alias("by_section"))
    by_symbol = symbols.select(key("repository", F.col("name")).alias("_k"), "node").groupBy("_k").agg(F.min("node").alias("by_symbol"))
    bare = F.regexp_replace("target", r"[#?].*$", "")
    name = F.when(F.col("wiki"), F.col("target")).otherwise(F.regexp_replace(T.display_name(bare), r"\.[^.]*$", ""))
    keyed = found.withColumns({"_path": F.concat_ws("\u0001", "repository", T.resolve_relative(F.col("file_path"), bare)), "_k": key("repository", name)})
    joined = keyed
    for t, on in ((by_path, "_path"), (by_title, "_k"), (by_stem, "_k"), (by_section, "_k"), (by_symbol, "_k")):
        joined = joined.join(t, on, "left")
    external = T.is_external_url(F.col("target"))
    node = F.when(F.col("wiki"), F.coalesce("by_title", "by_stem", "by_section", "by_symbol")).when(external, T.external_link_id(F.col("target"))).otherwise(
        F.coalesce("by_path", "by_stem", T.external_link_id(F.col("target")))
    )
    return joined.withColumn("node", node).where(F.col("node").isNotNull()).select(*found.columns, "node")


def reassembled(chunks: DataFrame) -> DataFrame:
    """(doc_id, table_index, caption, columns, n_rows, n_parts) of tables put together again from their chunks (doc_id, table_index, part, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, parts in enumerate(b.column(2).to_pylist()):
                t = reassemble([p["content"] for p in parts])
                out.append((i, t["caption"] if t else None, t["columns"] if t else 0, len(t["rows"]) if t else 0, len(parts)))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(5)]
            at = pa.array(cols[0], pa.int64())
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], ["doc_id", "table_index", "caption", "columns", "n_rows", "n_parts"])

    grouped = chunks.groupBy("doc_id", "table_index").agg(F.sort_array(F.collect_list(F.struct("part", "content"))).alias("parts"))  # the parts of one table
    return grouped.mapInArrow(run, f"doc_id {chunks.schema['doc_id'].dataType.simpleString()}, table_index int, caption string, columns int, n_rows int, n_parts int")


def nearest_heading(positions: DataFrame, heads: DataFrame) -> DataFrame:
    """Each position (doc_id, offset, ...) with the last section title at or before it: an as-of join by a window."""
    extra = [c for c in positions.columns if c not in ("doc_id", "offset")]
    a = positions.select("doc_id", "offset", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_t"), *extra)
    b = heads.select("doc_id", F.col("start_offset").alias("offset"), F.lit(0).alias("_kind"), F.col("title").alias("_t"), *[F.lit(None).cast(positions.schema[c].dataType).alias(c) for c in extra])
    w = Window.partitionBy("doc_id").orderBy("offset", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("heading", F.last("_t", ignorenulls=True).over(w)).where("_kind = 1").select("doc_id", "offset", *extra, "heading")


def breadcrumbs(positions: DataFrame, heads: DataFrame) -> DataFrame:
    """Positions (doc_id, offset, ...) with ``breadcrumb``: the last heading at or before each and those above it, outermost first.

    Above a heading stand, level by level, the last headings of a lower level before the position. A document's
    headings of each level run along with the positions in one window.
    """
    extra = [c for c in positions.columns if c not in ("doc_id", "offset")]
    blank = {c: F.lit(None).cast(positions.schema[c].dataType).alias(c) for c in extra}
    a = positions.select("doc_id", "offset", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_level"), F.lit(None).cast("string").alias("_t"), *extra)
    b = heads.select("doc_id", F.col("start_offset").alias("offset"), F.lit(0).alias("_kind"), F.col("level").alias("_level"), F.col("title").alias("_t"), *[blank[c] for c in extra])
    w = Window.partitionBy("doc_id").orderBy("offset", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"_l{k}": F.last(F.when(F.col("_level") == k, F.struct("offset", "_t")), ignorenulls=True).over(w) for k in range(1, 7)}
    leaf = F.last(F.when(F.col("_kind") == 0, F.col("_level")), ignorenulls=True).over(w)
    at = a.unionByName(b).withColumns({**last, "_leaf": leaf}).where("_kind = 1")
    # a heading is left behind by a later one of a lower level
    held = [F.greatest(F.lit(-1), *[F.col(f"_l{j}.offset") for j in range(1, k)]) if k > 1 else F.lit(-1) for k in range(1, 7)]
    path = F.array_compact(F.array(*[F.when((F.lit(k) <= F.col("_leaf")) & (F.col(f"_l{k}.offset") > held[k - 1]), F.col(f"_l{k}._t")) for k in range(1, 7)]))
    return at.select("doc_id", "offset", *extra, F.nullif(F.array_join(path, " > "), F.lit("")).alias("breadcrumb"))
