"""Evaluation texts leaking into training text: winnowed fingerprints, a join on them, and extension of hits.

Both sides become words without case, punctuation and markup. Of the hashes of all k-word grams, the
least (rightmost of equals) in every window of w consecutive grams is kept; so any shared span of
k + w - 1 words has at least one kept gram on both sides. A kept gram of a document that is also a kept
gram of an item is a hit, extended word by word to the left and right; a pair counts if a span reaches
``min_words``. Sentences that stand in more than one item break an item's text.

The items are the query set: they are read in blocks of a bounded number of words, and each block's
fingerprints go to the executors (see ``block_words``); the documents are only scanned, never shuffled
or gathered.

Defined results
* null, empty and blank texts on either side give no pairs; pairs are distinct, also over repeated rows;
* items with the same text count as sharing all their sentences, so they leak nothing;
* other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.shipping import ship, unpack

#: Five-word grams; with eight grams a window, every shared span of twelve words is found.
K, WINDOW = 5, 8
MIN_WORDS = K + WINDOW - 1

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*+>|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_BROKEN = re.compile(r"(?<=[^\W\d_])(?:[-‐¬][ \t]*\r?\n[ \t>]*|­\s*)(?=[^\W\d_])")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BASE = 0x9E3779B97F4A7C15
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: str) -> list[str]:
    """The words that are compared: case, punctuation, markup, white space and line breaks do not count."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub("", text)
    if "*" in text:
        text = text.replace("*", "")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _HYPHEN.sub("", _BROKEN.sub("", text))
    return _WORD.findall(text.lower())


def _value(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _grams(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Hash of the K words from each position; grams that hold an unknown word get the largest value."""
    n = len(values) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)
    with np.errstate(over="ignore"):
        for i in range(K):
            h = h * np.uint64(_BASE) + values[i : i + n]
            whole &= known[i : i + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.where(whole, h, _FAR)


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the least gram (rightmost of equals) of every full window; grams of unknown words drop out."""
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    at = np.unique(np.arange(len(view)) + (WINDOW - 1) - view.argmin(axis=1))
    return at[grams[at] != _FAR]


class Fingerprints:
    """Kept grams of a block of items, with the items' words for extension."""

    def __init__(self, items: list[tuple[int, list[list[str]]]]) -> None:
        self.number: dict[str, int] = {}
        ids: list[int] = []
        owner: list[int] = []
        for item, segments in items:
            for segment in segments:
                if len(segment) >= MIN_WORDS:
                    ids.extend(self.number.setdefault(w, len(self.number)) for w in segment)
                    ids.append(-2)
                    owner.extend([item] * (len(segment) + 1))
        self.value = np.array([_value(w) for w in self.number] + [0], np.uint64)
        self.ids, self.owner = np.array(ids, np.int64), np.array(owner, np.int64)
        grams = _grams(self.value[np.maximum(self.ids, -1)], self.ids >= 0)
        kept = winnow(grams)
        order = np.argsort(grams[kept], kind="stable")
        self.hash, self.at = grams[kept][order], kept[order]

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(index of text, item, words of the longest shared span) of a block of texts."""
        get = self.number.get
        ids: list[int] = []
        text_of: list[int] = []
        starts = [0]
        for i, t in enumerate(texts):
            if t:
                found = [get(w, -1) for w in words(t)]
                ids.extend(found)
                ids.append(-1)
                starts.append(len(ids))
                text_of.append(i)
        doc = np.array(ids, np.int64)
        grams = _grams(self.value[np.maximum(doc, -1)], doc >= 0)
        kept = winnow(grams)
        if not len(kept) or not len(self.hash):
            return []
        low = np.searchsorted(self.hash, grams[kept], "left")
        high = np.searchsorted(self.hash, grams[kept], "right")
        best: dict[tuple[int, int], int] = {}
        mine, theirs = ids, self.ids
        n, m = len(mine), len(theirs)
        done: set[tuple[int, int]] = set()  # (diagonal, end of a span already walked)
        for p, a, z in zip(kept[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            where = int(np.searchsorted(starts, p, "right")) - 1
            for q in self.at[a:z].tolist():
                i, j = p, q
                while i > 0 and j > 0 and mine[i - 1] >= 0 and mine[i - 1] == theirs[j - 1]:
                    i, j = i - 1, j - 1
                if (i, j) in done:
                    continue
                done.add((i, j))
                length = 0
                while i + length < n and j + length < m and mine[i + length] >= 0 and mine[i + length] == theirs[j + length]:
                    length += 1
                if length >= MIN_WORDS:
                    key = (text_of[where], int(self.owner[j]))
                    best[key] = max(best.get(key, 0), length)
        return [(i, item, length) for (i, item), length in best.items()]


def item_segments(items: DataFrame) -> DataFrame:
    """(item_id, segments): the items' words, split where a sentence stands in more than one item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                (i, k, " ".join(words(s)))
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                if t
                for k, s in enumerate(_SENTENCE.split(t))
            ]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, y) for c, y in zip(cols, (pa.int64(), pa.int32(), pa.string()), strict=True)], ["item_id", "k", "sentence"]
            )

    sentences = items.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, k int, sentence string")
    shared = (
        sentences.groupBy("sentence").agg(F.min("item_id").alias("a"), F.max("item_id").alias("z")).select("sentence", (F.col("a") != F.col("z")).alias("shared"))
    )
    return (
        sentences.join(shared, "sentence")
        .groupBy("item_id")
        .agg(F.sort_array(F.collect_list(F.struct("k", "shared", "sentence"))).alias("sentences"))
    )


def _own_segments(sentences: list) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for s in sentences:
        if s["shared"]:
            out.append([])
        else:
            out[-1].extend(s["sentence"].split())
    return [x for x in out if x]


def leaks(documents: DataFrame, items: DataFrame, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_words): the longest shared span of each document and item that share enough.

    ``block_words`` bounds how many item words (about 40 bytes each) are collected and sent to the
    executors at once; a larger query set is worked off in several blocks, one scan of the documents each.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    total = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    segments = item_segments(items)
    out = None
    for k in range(blocks):
        part = segments if blocks == 1 else segments.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        shipped = ship(spark, Fingerprints([(r["item_id"], _own_segments(r["sentences"])) for r in part.collect()]))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            prints = unpack(shipped)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    b = batch.slice(at, 1000)
                    found = prints.hits(b.column(1).to_pylist())
                    docs = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [docs, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32())],
                        ["doc_id", "item_id", "n_words"],
                    )

        found = documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, f"doc_id {kind}, item_id long, n_words int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
