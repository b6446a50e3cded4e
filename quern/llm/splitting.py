"""Splitting oversized texts at natural boundaries, and checking stored pieces against the same boundaries.

A text's token costs are kept as prefix sums over its code points, its boundaries as one sorted array.
A piece ends at the last boundary under the limit (found by binary search, strongest kind in the back
half of the window first), the next one starts up to ``overlap`` tokens before that end, again at a
boundary; only a run without white space that is longer than a piece is cut hard.

Defined results
* null texts and texts of at most ``max_tokens`` tokens give no pieces;
* pieces cover the text from 0 to its length, starts and ends strictly increase, neighbours overlap by
  at least one code point and at most ``overlap`` tokens;
* a run one code point shorter than a piece, or as long, behind other text cannot be kept whole with an
  overlap on both sides; it is cut hard;
* duplicate document ids are split row by row; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.orphans import uuid_key

#: Token estimate of four code points, limits of the ingestion settings.
CHARS_PER_TOKEN, MAX_TOKENS, OVERLAP_TOKENS = 4, 500, 50

_GAP = re.compile(r"[ \t\r\n]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
PARAGRAPH, SENTENCE, LINE, WORD, HARD, END = "paragraph", "sentence", "line", "word", "hard", "end"


def token_prefix(n: int) -> np.ndarray:
    """Prefix sums of token costs in code points, of which a token has ``CHARS_PER_TOKEN``, so that they stay integers."""
    return np.arange(n + 1, dtype=np.int64)


class Boundaries:
    """The sorted cut positions of a text by strength; a cut lies behind a run of white space."""

    def __init__(self, text: str) -> None:
        self.text, self.n = text, len(text)
        self.at: dict[str, list[int]] = {PARAGRAPH: [], SENTENCE: [], LINE: [], WORD: []}
        self.gaps: list[tuple[int, int]] = []
        for m in _GAP.finditer(text):
            a, b = m.span()
            self.gaps.append((a, b))
            if b < self.n:
                gap = m.group()
                self.at[WORD].append(b)
                newline = "\n" in gap
                if newline:
                    self.at[LINE].append(b)
                if a and text[a - 1] in ".!?:;":
                    self.at[SENTENCE].append(b)
                if newline and _PARAGRAPH.search(gap):
                    self.at[PARAGRAPH].append(b)
        self._ends = [b for _, b in self.gaps]

    def inside_gap(self, p: int) -> bool:
        """Whether p touches white space on either side."""
        i = bisect_left(self._ends, p)
        return i < len(self.gaps) and self.gaps[i][0] <= p

    def last(self, kind: str, low: int, high: int) -> int | None:
        """The last boundary of this kind in (low, high]."""
        at = self.at[kind]
        i = bisect_right(at, high)
        return at[i - 1] if i and at[i - 1] > low else None

    def first(self, kind: str, low: int, high: int) -> int | None:
        """The first boundary of this kind in [low, high)."""
        at = self.at[kind]
        i = bisect_left(at, low)
        return at[i] if i < len(at) and at[i] < high else None


def split(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of boundary at the end) of a text over the limit, else none."""
    n = len(text)
    prefix = token_prefix(n)
    limit, back = CHARS_PER_TOKEN * max_tokens, CHARS_PER_TOKEN * overlap
    if prefix[n] <= limit:
        return []
    b = Boundaries(text)
    out: list[tuple[int, int, str]] = []
    start = done = 0

    def reach(s: int) -> int:
        return int(np.searchsorted(prefix, prefix[s] + limit, "right")) - 1

    def end_of(s: int) -> tuple[int, str] | None:
        high = reach(s)
        least = max(done, s + 1)  # the next piece must start behind s and before this end
        middle = max(least, s + (high - s) // 2)
        for kind in (PARAGRAPH, SENTENCE, LINE):
            if (p := b.last(kind, middle, high)) is not None:
                return p, kind
        if (p := b.last(WORD, least, high)) is not None:
            return p, WORD
        return (high, WORD) if high > least and text[high - 1] in " \t\r\n" else None

    while reach(start) < n:
        found = end_of(start)
        if found is None:  # a long run: less overlap may still get it whole into one piece
            closer = next((p for p in range(done - 1, start, -1) if b.inside_gap(p)), None) if out else None
            if closer is not None:
                if reach(closer) >= n:
                    start = closer
                    break
                if (again := end_of(closer)) is not None:
                    start, found = closer, again
        end, kind = found or (reach(start), HARD)
        out.append((start, end, kind))
        low = max(start + 1, int(np.searchsorted(prefix, prefix[end] - back, "left")))
        following = next((p for k in (SENTENCE, LINE, WORD) if (p := b.first(k, low, end)) is not None), None)
        if following is None:
            following = end - 1 if text[end - 1] in " \t\r\n" and end - 1 > start else low
        start, done = following, end
    out.append((start, n, END))
    return out


def improper(text: str, pieces: Sequence[tuple[int, int, int]], max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> bool:
    """Whether stored pieces (index, start, end) are no proper cutting of the text (TESTDATA, p5_found)."""
    n, limit, back = len(text), CHARS_PER_TOKEN * max_tokens, CHARS_PER_TOKEN * overlap
    cut = sorted(pieces)
    if not cut or [c[0] for c in cut] != list(range(len(cut))) or cut[0][1] != 0 or cut[-1][2] != n:
        return True
    prefix = token_prefix(n)
    starts, ends = np.array([c[1] for c in cut]), np.array([c[2] for c in cut])
    if starts.min() < 0 or ends.max() > n or (np.diff(starts) <= 0).any() or (np.diff(ends) <= 0).any():
        return True
    size, shared = prefix[ends] - prefix[starts], prefix[ends[:-1]] - prefix[starts[1:]]
    if (size <= 0).any() or (size > limit).any() or (shared <= 0).any() or (shared > back).any():
        return True
    inner = np.concatenate([starts[1:], ends[:-1]])
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gaps = np.flatnonzero((chars == 32) | (chars == 10) | (chars == 9) | (chars == 13))
    walls = np.concatenate([[-1], gaps, [n]])
    right = np.searchsorted(walls, inner, "left")  # first white space at or behind the cut
    left, right = walls[right - 1], walls[right]
    inside = (left < inner - 1) & (right > inner)
    return bool((inside & (right - left - 1 <= limit)).any())


_PIECE = "chunk_index int, start_offset int, end_offset int, n_tokens int, boundary string"


def pieces(documents: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(doc_id, chunk_index, start_offset, end_offset, n_tokens, boundary) of every text over the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (a, z, kind) in enumerate(split(text, max_tokens, overlap)):
                    rows.append((doc, i, a, z, -(-(z - a) // CHARS_PER_TOKEN), kind))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                ["doc_id", "chunk_index", "start_offset", "end_offset", "n_tokens", "boundary"],
            )

    long = documents.select("doc_id", "text").where(F.char_length("text") > max_tokens * CHARS_PER_TOKEN)
    return long.mapInArrow(run, f"doc_id {long.schema['doc_id'].dataType.simpleString()}, {_PIECE}")


def badly_cut(documents: DataFrame, chunks: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(doc_id) of every oversized document whose stored pieces are no proper cutting.

    Rows of one document and index are folded before any shuffle; two different pieces under one index,
    a null or an index that no cutting of that text can reach only leave a mark. So the list that is
    gathered for a document never has more entries than its text has code points, however many rows a
    hot document has.
    """
    long = documents.select("doc_id", uuid_key(F.col("id")).alias("_key"), "text").where(
        F.char_length("text") > max_tokens * CHARS_PER_TOKEN
    )
    size = long.select("doc_id", "_key", F.char_length("text").alias("_n"))
    folded = (
        chunks.select(uuid_key(F.col("document_id")).alias("_key"), "chunk_index", "start_offset", "end_offset")
        .where(F.col("_key").isNotNull())
        .groupBy("_key", "chunk_index")
        .agg(
            F.min("start_offset").alias("_s"),
            F.max("start_offset").alias("_s2"),
            F.min("end_offset").alias("_e"),
            F.max("end_offset").alias("_e2"),
            F.bool_or(F.col("start_offset").isNull() | F.col("end_offset").isNull()).alias("_null"),
        )
    )
    fine = (
        ~F.col("_null") & F.col("chunk_index").isNotNull() & (F.col("_s") == F.col("_s2")) & (F.col("_e") == F.col("_e2"))
        & F.col("chunk_index").between(0, F.col("_n"))
    )
    stored = (
        folded.join(size, "_key")
        .withColumn("_fine", F.coalesce(fine, F.lit(False)))
        .groupBy("doc_id")
        .agg(
            F.bool_or(~F.col("_fine")).alias("_bad"),
            F.collect_list(F.when(F.col("_fine"), F.struct(F.col("chunk_index").cast("int").alias("i"), F.col("_s").cast("int").alias("s"), F.col("_e").cast("int").alias("e")))).alias("_pieces"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, bad, cut = (c.to_pylist() for c in batch.columns)
            keep = [
                d
                for d, t, x, p in zip(docs, texts, bad, cut, strict=True)
                if x or not p or improper(t, [(q["i"], q["s"], q["e"]) for q in p], max_tokens, overlap)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(keep, batch.schema.field(0).type)], ["doc_id"])

    known = long.select("doc_id", "text").join(stored, "doc_id", "left").select("doc_id", F.when(~F.col("_bad"), F.col("text")).alias("text"), F.coalesce("_bad", F.lit(True)).alias("_bad"), "_pieces")
    return known.mapInArrow(run, f"doc_id {long.schema['doc_id'].dataType.simpleString()}")
