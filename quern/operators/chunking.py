"""Chunkers of files and documents: by lines, by pages, by paragraphs, with section breadcrumbs.

Packing depends on its own resets, so each text is packed by a fold in an Arrow batch; texts are never
shuffled. Tokens are a quarter of the code points, rounded up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Default limits in tokens.
MAX_TOKENS, OVERLAP_TOKENS = 500, 50

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BLANK = re.compile(r"\n\n+")


@dataclass(frozen=True)
class Chunk:
    """A piece with its lines (from 1) and its code-point span in the normalised text (-1 where it has none)."""

    content: str
    start_line: int
    end_line: int
    start: int
    end: int


def tokens(text: str) -> int:
    return -(-len(text) // 4)


def normalize(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def tail_within(items: list[str], budget: int, joiner: str) -> int:
    """How many items from the end fit the budget, at least one (none for a budget of zero)."""
    if budget <= 0 or not items:
        return 0
    n, used = 0, 0
    for item in reversed(items):
        cost = tokens(item + joiner)
        if n and used + cost > budget:
            break
        used += cost
        n += 1
    return n


def by_lines(text: str | None, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, max_chunks: int | None = None) -> list[Chunk]:
    """Whole lines up to the limit; the next chunk repeats the last lines within the overlap. A long line stays whole."""
    if not text or not text.strip():
        return []
    lines = normalize(text).split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    out: list[Chunk] = []
    buffer: list[str] = []
    first = used = 0

    def flush(last: int) -> None:
        content = "\n".join(buffer)
        if content.strip():
            out.append(Chunk(content, first + 1, last, starts[first], starts[first] + len(content)))

    for i, line in enumerate(lines):
        cost = tokens(line)
        if buffer and used + cost > max_tokens:
            flush(i)
            keep = tail_within(buffer, overlap, "\n")
            if keep >= len(buffer) and len(buffer) > 1:
                keep = len(buffer) - 1
            buffer = buffer[len(buffer) - keep :] if keep else []
            first = i - keep
            buffer.append(line)
            used = tokens("\n".join(buffer))
        else:
            if not buffer:
                first = i
            buffer.append(line)
            used += cost
    flush(len(lines))
    return out[:max_chunks]


def paragraphs_of(text: str) -> list[tuple[str, int, int]]:
    """(paragraph, offset, line from 1) of the texts between blank lines, trimmed."""
    out = []
    at = 0
    for gap in (*_BLANK.finditer(text), None):
        end = gap.start() if gap else len(text)
        raw = text[at:end]
        body = raw.strip()
        if body:
            start = at + raw.index(body)
            out.append((body, start, text.count("\n", 0, start) + 1))
        at = gap.end() if gap else end
    return out


def split_paragraph(body: str, max_tokens: int) -> list[str]:
    """A paragraph over the limit: by lines if all fit, else by sentences, else by words; a giant word stays whole."""
    lines = body.split("\n")
    if len(lines) > 1 and all(tokens(x) <= max_tokens for x in lines):
        return [c.content for c in by_lines(body, max_tokens, 0)]
    out: list[str] = []

    def pack(parts: list[str], deeper: Callable[[str], list[str]] | None) -> list[str]:
        packed: list[str] = []
        current = ""
        for p in parts:
            if tokens(p) > max_tokens and deeper:
                if current:
                    packed.append(current)
                    current = ""
                packed += deeper(p)
            elif current and tokens(current + " " + p) > max_tokens:
                packed.append(current)
                current = p
            else:
                current = f"{current} {p}" if current else p
        return packed + ([current] if current else [])

    out = pack([s for s in _SENTENCE.split(body) if s], lambda s: pack(s.split(), None))
    return out


def by_paragraphs(text: str | None, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[Chunk]:
    """Paragraphs packed up to the limit; the next chunk repeats at least one whole paragraph as overlap."""
    if not text or not text.strip():
        return []
    text = normalize(text)
    out: list[Chunk] = []
    buffer: list[tuple[str, int, int]] = []
    fresh = 0  # paragraphs at the buffer's start that are overlap

    def flush() -> None:
        if len(buffer) > fresh:
            content = "\n\n".join(b for b, _, _ in buffer)
            body, start, line = buffer[fresh]
            last, begin, _ = buffer[-1]
            out.append(Chunk(content, line, text.count("\n", 0, begin + len(last)) + 1, start, begin + len(last)))

    for p in paragraphs_of(text):
        body, start, line = p
        if tokens(body) > max_tokens:
            flush()
            buffer, fresh = [], 0
            for piece in split_paragraph(body, max_tokens):
                out.append(Chunk(piece, line, line + body.count("\n"), start, start + len(body)))
            continue
        if len(buffer) > fresh and tokens("\n\n".join([*(b for b, _, _ in buffer), body])) > max_tokens:
            flush()
            keep = tail_within([b for b, _, _ in buffer], overlap, "\n\n")
            buffer = buffer[len(buffer) - keep :] if keep else []
            fresh = len(buffer)
        buffer.append(p)
    flush()
    return out


def breadcrumb(sections: list[tuple[str, int, int]], position: int, title: str | None) -> str | None:
    """Path of section titles above a position; sections are (title, level, start offset) in order."""
    before = [s for s in sections if s[2] <= position]
    if not before:
        return title
    trail = [before[-1]]
    for s in reversed(before[:-1]):
        if s[1] < trail[-1][1]:
            trail.append(s)
    return " > ".join(s[0] for s in reversed(trail))


_SCHEMA = "chunk_index int, content string, start_line int, end_line int, start_offset int, end_offset int, tokens int"
_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
_NAMES = ["chunk_index", "content", "start_line", "end_line", "start_offset", "end_offset", "tokens"]


def chunk(texts: DataFrame, how: Callable[[str | None], list[Chunk]]) -> DataFrame:
    """Chunks of a table whose last column is the text; the other columns come with each chunk."""
    keys = texts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, k, c.content, c.start_line, c.end_line, c.start, c.end, tokens(c.content))
                for i, t in enumerate(batch.column(len(keys)).to_pylist())
                for k, c in enumerate(how(t))
            ]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in batch.columns[:-1]), *(pa.array(c, t) for c, t in zip(cols[1:], _TYPES, strict=True))], [*keys, *_NAMES]
            )

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in texts.schema.fields[:-1])
    return texts.mapInArrow(run, head + _SCHEMA)


def by_pages(pages: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Line chunks of each page (doc_id, page_number, content), numbered through the document; none crosses a page.

    The index before a page is a running sum over one small row a page.
    """
    cut = chunk(pages.select("doc_id", "page_number", "content"), lambda t: by_lines(t, max_tokens, overlap))
    per_page = cut.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_page.select("doc_id", "page_number", F.coalesce(before, F.lit(0)).alias("_before"))
    return cut.join(starts, ["doc_id", "page_number"]).withColumn("chunk_index", (F.col("chunk_index") + F.col("_before")).cast("int")).drop("_before")


def ocr_summary(pages: DataFrame) -> DataFrame:
    """(doc_id, confidence, n_pages, n_skipped): mean confidence over the pages (doc_id, confidence, skipped) that were read."""
    read = ~F.coalesce("skipped", F.lit(False))
    return pages.groupBy("doc_id").agg(
        F.round(F.avg(F.when(read, F.col("confidence"))), 2).alias("confidence"), F.count(F.lit(1)).alias("n_pages"), F.count_if(~read).alias("n_skipped")
    )


def strategy(docs: DataFrame) -> DataFrame:
    """(doc_id, strategy) of documents (doc_id, text, n_pages): pages if there are any, else paragraphs if a blank line parts some, else lines; none without text."""
    even = F.regexp_replace(F.col("text"), r"\r\n?", "\n")
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"\S")
    return docs.select("doc_id", F.when(blank, "none").when(F.coalesce("n_pages", F.lit(0)) > 0, "pages").when(F.contains(even, F.lit("\n\n")), "paragraphs").otherwise("lines").alias("strategy"))
