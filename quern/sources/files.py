"""Repository files as a source: scan, eligibility, ignore rules, binary formats, logs."""

from __future__ import annotations

import os
import re
import struct
import zipfile
from collections.abc import Iterator
from io import BytesIO
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import extension

#: Default extensions, folders never descended into, lock files.
DEFAULT_EXTENSIONS = ".js .ts .jsx .tsx .cs .py .java .go .rs .cpp .c .h .pdf .docx .md .txt .rst .json .yaml .yml .toml".split()
SKIPPED_FOLDERS = ("node_modules", "dist", "build", "bin", "obj", ".git", ".svn", ".hg", "_darcs")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock")
MAX_BYTES = 1 << 20
DOCUMENT_TYPES = {".pdf": "pdf", ".docx": "docx", ".md": "markdown", ".markdown": "markdown", ".txt": "txt", ".png": "image", ".jpg": "image", ".jpeg": "image", ".gif": "image", ".webp": "image", ".tif": "image", ".tiff": "image"}


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """(relative_path, path, size, modified_at, content bytes) of the eligible files under a folder.

    The file listing is Spark's own; path, size and time filters reach the scan before contents are read. Names
    with a leading underscore, which Spark's listing leaves out, are listed apart and read by their paths.
    """
    wanted = extensions or DEFAULT_EXTENSIONS
    reader = lambda: spark.read.format("binaryFile")
    raw = reader().option("recursiveFileLookup", "true").load(root)
    own = [p for p in hidden_files(spark, root) if p.rsplit("/", 1)[-1].startswith("_") or "/_" in p]
    own = [p for p in own if any(p.lower().endswith(e.lower()) for e in wanted)]
    if own:
        raw = raw.unionByName(read_paths(spark, own))
    files = raw.select(_relative(root), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")
    return files.where(eligible(F.col("relative_path"), F.col("size"), wanted))


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, modificationTime, length, content) of single files, which Spark's reader may leave out for their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(p if "://" in p else f"file://{quote(p)}")
                info = system.get_file_info(at)
                if info.type == fs.FileType.File:
                    with system.open_input_stream(at) as f:
                        rows.append((p, info.mtime, info.size, f.read()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            types = (pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "modificationTime", "length", "content"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(run, "path string, modificationTime timestamp, length long, content binary")


def _relative(root: str) -> Column:
    at = re.sub(r"^file:/+", "/", root).rstrip("/")
    return F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(at) + "/", "").alias("relative_path")


def hidden_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of files that Spark's listing leaves out: those of which a part below the root begins with ``_`` or ``.``, skipped folders aside."""
    local = re.sub(r"^file:/+", "/", root).rstrip("/")
    out: list[str] = []
    if "://" not in local:
        for folder, folders, names in os.walk(local):
            folders[:] = [x for x in folders if x not in SKIPPED_FOLDERS and not x.startswith(".")]
            under = any(x.startswith("_") for x in folder[len(local) :].split("/"))
            out += [f"{folder}/{x}" for x in names if under or x[:1] in "_."]
        return sorted(out)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while found.hasNext():
        p = found.next().getPath().toString()
        parts = p[len(root.rstrip("/")) + 1 :].split("/")
        if any(x[:1] in "_." for x in parts) and not any(x in SKIPPED_FOLDERS or x.startswith(".") for x in parts[:-1]):
            out.append(p)
    return sorted(out)


def descended(path: Column) -> Column:
    """Whether no folder of the path is skipped (version control, build output, hidden)."""
    folders = F.regexp_replace(path, r"[^/]*$", "")
    names = "|".join(re.escape(x) for x in SKIPPED_FOLDERS)
    return ~folders.rlike(rf"(^|/)(?:{names})/") & ~folders.rlike(r"(^|/)\.[^/]+/")


def eligible(path: Column, size: Column, extensions: list[str]) -> Column:
    """Whether a file is indexed: extension, no dot file, lock file or minified file, small enough, folder descended."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        extension(path).isin(*[e.lower() for e in extensions])
        & ~name.startswith(".")
        & ~name.isin(*LOCK_FILES)
        & ~name.rlike(r"\.min\.(?:js|css)$")
        & (size <= MAX_BYTES)
        & descended(path)
    )


def document_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in DOCUMENT_TYPES.items() for x in kv])
    return known[extension(path)]


def magic_type(content: Column) -> Column:
    """Document type by the first bytes: what the extension claims can be checked against it."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("25504446"), "pdf").when(h.startswith("504B0304"), "docx").when(h.startswith("89504E47") | h.startswith("FFD8FF") | h.startswith("47494638") | h.startswith("49492A00") | h.startswith("4D4D002A"), "image")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image")
    )


def ignore_regex(line: str) -> tuple[bool, str] | None:
    """(whether the rule re-includes, regular expression on the path below the rule's folder) of an ignore-file line."""
    rule = line.rstrip("\r\n")
    rule = re.sub(r"(?<!\\)\s+$", "", rule)
    if not rule or rule.startswith("#"):
        return None
    keep = rule.startswith("!")
    rule = rule[1:] if keep else rule
    only_folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.*", i + 3
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and (end := rule.find("]", i + 1)) > 0:
            out, i = out + rule[i : end + 1].replace("[!", "[^"), end + 1
        elif rule[i] == "\\" and i + 1 < len(rule):
            out, i = out + re.escape(rule[i + 1]), i + 2
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return keep, ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_folder else "(?:/.*)?$")


def apply_ignores(files: DataFrame, ignores: list[tuple[str, str]]) -> DataFrame:
    """Files that no ignore file excludes; ``ignores`` is (folder relative to the root, text) of each ignore file.

    Deeper files speak first, inside a file the last matching rule counts; the first verdict holds. The rules are
    tried in that order in Arrow batches over the paths, so thousands of them make no plan longer.
    """
    rules = []
    for folder, text in sorted(ignores, key=lambda x: -len(x[0].strip("/"))):
        prefix = folder.strip("/") + "/" if folder.strip("/") else ""
        made = [r for r in map(ignore_regex, text.splitlines()) if r]
        if made:
            rules.append((prefix, [(not keep, pattern) for keep, pattern in reversed(made)]))
    if not rules:
        return files

    @F.pandas_udf("boolean")
    def ignored(paths: pd.Series) -> pd.Series:
        ready = [(prefix, [(out, re.compile(x)) for out, x in made]) for prefix, made in rules]

        def verdict(path: str | None) -> bool:
            for prefix, made in ready:
                if path and path.startswith(prefix):
                    inner = path[len(prefix) :]
                    for out, x in made:
                        if x.search(inner):
                            return out
            return False

        return paths.map(verdict)

    return files.where(~ignored("relative_path"))


def ignore_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(folder relative to the root, text) of the ignore files under a folder: small, and rules are settled before the scan."""
    own = [p for p in hidden_files(spark, root) if p.rsplit("/", 1)[-1] == ".gitignore"]
    if not own:
        return []
    raw = read_paths(spark, own).where(F.col("length") <= MAX_BYTES)
    rows = raw.select(_relative(root), F.col("content").cast("string").alias("text")).collect()
    return [(r["relative_path"].rpartition("/")[0], r["text"]) for r in rows]


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """All rotated files of a JSON-lines audit log; lines that are no records are left out."""
    schema = "ts timestamp, event_type string, token_hash string, email string, success boolean, instance string, detail string, _bad string"
    read = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.where(F.col("_bad").isNull() & F.col("event_type").isNotNull()).drop("_bad")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_parts(data: bytes) -> tuple[str, list[tuple[str, int]], list[list[list[dict]]]]:
    """(text of the body's paragraphs, headings (title, level), tables as rows of cells with spans) of a DOCX file."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines: list[str] = []
    heads: list[tuple[str, int]] = []
    tables: list[list[list[dict]]] = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            text = "".join(t.text or "" for t in node.iter(f"{_W}t"))
            style = node.find(f"{_W}pPr/{_W}pStyle")
            m = re.fullmatch(r"[Hh]eading\s?(\d)", style.get(f"{_W}val", "")) if style is not None else None
            if m and text.strip():
                heads.append((text.strip(), int(m.group(1))))
            lines.append(text)
        elif node.tag == f"{_W}tbl":
            rows = []
            for tr in node.iter(f"{_W}tr"):
                cells = []
                for tc in tr.findall(f"{_W}tc"):
                    span = tc.find(f"{_W}tcPr/{_W}gridSpan")
                    merge = tc.find(f"{_W}tcPr/{_W}vMerge")
                    content = "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in tc.iter(f"{_W}p"))
                    continued = merge is not None and merge.get(f"{_W}val") != "restart"
                    cells.append({"content": "" if continued else content, "colSpan": int(span.get(f"{_W}val")) if span is not None else 1, "rowSpan": 0 if continued else 1})
                rows.append(cells)
            _span_rows(rows)
            tables.append(rows)
    return "\n".join(lines), heads, tables


def _span_rows(rows: list[list[dict]]) -> None:
    """Counts, in the cell where a vertical merge begins, the rows below that continue it (their own cells have 0)."""
    begun: dict[int, dict] = {}
    for row in rows:
        column = 0
        for cell in row:
            if cell["rowSpan"] == 0 and column in begun:
                begun[column]["rowSpan"] += 1
            else:
                begun[column] = cell
            column += cell["colSpan"]


def docx_properties(data: bytes) -> dict[str, str]:
    """Title and author of a DOCX file, as far as it tells them."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        if "docProps/core.xml" not in z.namelist():
            return {}
        core = ElementTree.fromstring(z.read("docProps/core.xml"))
    of = {"{http://purl.org/dc/elements/1.1/}title": "title", "{http://purl.org/dc/elements/1.1/}creator": "author"}
    return {of[e.tag]: e.text.strip() for e in core if e.tag in of and e.text and e.text.strip()}


def docx_tables(files: DataFrame) -> DataFrame:
    """(relative_path, table_index, row_index, cells) of the tables of the DOCX files of a scan; cells are (content, colSpan, rowSpan)."""
    cell = pa.list_(pa.struct([("content", pa.string()), ("colSpan", pa.int32()), ("rowSpan", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    tables = docx_parts(x)[2]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                out += [(path, i, n, r) for i, t in enumerate(tables) for n, r in enumerate(t)]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), cell), strict=True)], ["relative_path", "table_index", "row_index", "cells"])

    picked = files.where(document_type(F.col("relative_path")) == "docx").select("relative_path", "content")
    return picked.mapInArrow(run, "relative_path string, table_index int, row_index int, cells array<struct<content:string,colSpan:int,rowSpan:int>>")


def tiff_fields(data: bytes) -> dict[int, int | str]:
    """Numbers and texts of the first directory of a TIFF structure and of the photo directory below it, by tag."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    out: dict[int, int | str] = {}
    if order is None or len(data) < 8:
        return out
    todo, seen = [struct.unpack(order + "I", data[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, n = struct.unpack(order + "HHI", entry[:8])
            if kind == 3:
                out[tag] = struct.unpack(order + "H", entry[8:10])[0]
            elif kind == 4:
                out[tag] = struct.unpack(order + "I", entry[8:12])[0]
            elif kind == 2:
                begin = struct.unpack(order + "I", entry[8:12])[0] if n > 4 else at + 10 + 12 * k
                out[tag] = data[begin : begin + n].split(b"\0")[0].decode("ascii", "replace")
            if tag == 0x8769 and kind == 4:
                todo.append(out[tag])
    return out


#: Tags of a photo's time (taken, made) and camera.
_TAKEN, _MADE, _MODEL = 0x9003, 0x0132, 0x0110


def photo_fields(data: bytes) -> dict[int, int | str]:
    """The photo fields of a TIFF or JPEG file."""
    if data[:2] != b"\xff\xd8":
        return tiff_fields(data)
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return tiff_fields(data[at + 10 : at + 2 + size])
        if data[at + 1] == 0xDA or size < 2:
            break
        at += 2 + size
    return {}


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from an image's header: PNG, GIF, JPEG, WebP, TIFF."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        f = tiff_fields(data)
        return ("tiff", f[0x100], f[0x101]) if isinstance(f.get(0x100), int) and isinstance(f.get(0x101), int) else None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:4] == b"GIF8" and len(data) >= 10:
        return ("gif", *struct.unpack("<HH", data[6:10]))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return ("webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"))
        if data[12:16] == b"VP8 ":
            return ("webp", *(x & 0x3FFF for x in struct.unpack("<HH", data[26:30])))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker in (0xC0, 0xC1, 0xC2, 0xC3):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + size
    return None


def images(files: DataFrame) -> DataFrame:
    """(relative_path, size, modified_at, format, width, height, taken_at, camera) of the image files of a scan; the time it was taken, else made, else modified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *s, photo_fields(x)) for i, x in enumerate(b.column(3).to_pylist()) if x is not None and (s := image_size(x))]
            at = pa.array([f[0] for f in found], pa.int64())
            told = lambda *tags: pa.array([next((f[4][t] for t in tags if isinstance(f[4].get(t), str)), None) for f in found], pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(at) for k in range(3)), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()), told(_TAKEN, _MADE), told(_MODEL)],
                ["relative_path", "size", "modified_at", "format", "width", "height", "taken", "camera"],
            )

    picked = files.where(document_type(F.col("relative_path")) == "image").select("relative_path", "size", "modified_at", "content")
    read = picked.mapInArrow(run, "relative_path string, size long, modified_at timestamp, format string, width int, height int, taken string, camera string")
    return read.withColumn("taken_at", F.coalesce(F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")), "modified_at")).drop("taken")


def docx_texts(files: DataFrame) -> DataFrame:
    """(relative_path, text, headings, n_tables, title, author, error) of the DOCX files of a scan; a broken file only gives its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                try:
                    text, heads, tables = docx_parts(x)
                    told = docx_properties(x)
                    rows.append((text, [h for h, _ in heads], len(tables), told.get("title"), told.get("author"), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((None, None, None, None, None, str(e)[:200] or type(e).__name__))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            types = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["relative_path", "text", "headings", "n_tables", "title", "author", "error"])

    picked = files.where(document_type(F.col("relative_path")) == "docx").select("relative_path", "content")
    return picked.mapInArrow(run, "relative_path string, text string, headings array<string>, n_tables int, title string, author string, error string")


def detect_tables(items: list[tuple[float, float, float, str]], line_tolerance: float = 0.3, column_tolerance: float = 1.0) -> list[list[list[str]]]:
    """Tables in the placed texts (x, y, width, text) of one page, by geometry.

    Texts within ``line_tolerance`` of a row's first y are one row; x positions within ``column_tolerance`` of a
    cluster's running mean are one column; rows that fill two columns or more are table rows, two of them in
    succession a table.
    """
    rows: list[tuple[float, list]] = []
    for x, y, _, text in sorted((i for i in items if i[3].strip()), key=lambda i: (i[1], i[0])):
        if rows and abs(y - rows[-1][0]) <= line_tolerance:
            rows[-1][1].append((x, text))
        else:
            rows.append((y, [(x, text)]))
    clusters: list[list[float]] = []
    for x in sorted(x for _, r in rows for x, _ in r):
        if clusters and abs(x - sum(clusters[-1]) / len(clusters[-1])) <= column_tolerance:
            clusters[-1].append(x)
        else:
            clusters.append([x])
    centres = [sum(c) / len(c) for c in clusters if len(c) >= 2]
    out: list[list[list[str]]] = []
    run: list[list[str]] = []
    for _, row in [*rows, (0.0, [])]:
        cells = [""] * len(centres)
        for x, text in row:
            k = min(range(len(centres)), key=lambda i: abs(centres[i] - x), default=None)
            if k is not None and abs(centres[k] - x) <= column_tolerance:
                cells[k] = f"{cells[k]} {text}".strip()
        if sum(map(bool, cells)) >= 2:
            run.append(cells)
        else:
            if len(run) >= 2:
                used = [i for i in range(len(centres)) if any(r[i] for r in run)]
                out.append([[r[i] for i in used] for r in run])
            run = []
    return out
