"""Encoding a corpus with a public byte-level BPE vocabulary by corpus-level merge replay.

The distinct pre-tokens of the whole corpus are gathered first, each once. Its table of words is then encoded
by replaying the merges: an inverted index leads from each mergeable pair to the positions where it stands;
the merges are applied in rank order, each at all its positions, and only the pairs of touched neighbours
are indexed anew. The index is split by a hash of the words, as merges never cross words. The encoded words go
back to the texts by look-up: as many as ``known_bytes`` allow, the most wide-spread first, are sent to the
executors; a word beyond that bound is replayed again with the new words of its block, with the same ids. So
texts are scanned twice and never shuffled, whatever the size of the corpus or its vocabulary.

Defined results
* null and empty texts give an empty list; strings that look like special tokens are ordinary text;
* lone surrogates (which UTF-8 cannot hold) are encoded as U+FFFD;
* duplicate ids are encoded row by row; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import checkpointed
from quern.shipping import ship, unpack

#: Fixed value: the pre-token pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACE = re.compile(r"(?<=\S) (?=\S)")
_WIDTH = 1 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files lie on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: Latin-1's printable characters, then U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeReplay:
    """A byte-level BPE vocabulary from ``.json`` (vocabulary and merges) or ``.tiktoken`` (ranks)."""

    def __init__(self, path: str, max_known: int = 400_000) -> None:
        import regex

        self.pretokens = regex.compile(PATTERN).findall
        self.max_known = max_known
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            vocab, at = model["vocab"], _byte_of_char()
            self.of_byte = [0] * 256
            for c, b in at.items():
                self.of_byte[b] = vocab[c]
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        else:
            with open(path, "rb") as f:
                vocab = {base64.b64decode(a): int(r) for a, r in map(bytes.split, f)}
            self.of_byte = [vocab[bytes([b])] for b in range(256)]
            found = []
            for token, rank in vocab.items():
                for i in range(1, len(token)):
                    if token[:i] in vocab and token[i:] in vocab:
                        found.append((rank, vocab[token[:i]], vocab[token[i:]]))
            self.merges = [(a, b, r) for r, a, b in sorted(found)]
        self.rank = {a * _WIDTH + b: r for r, (a, b, _) in enumerate(self.merges)}
        self.given: dict[str, tuple[int, ...]] = {}  # words of the corpus that came encoded
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}  # behind a space
        self.heads: dict[str, tuple[int, ...]] = {}  # at the start of a text

    def replay(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of distinct words, all encoded in one pass over the merges."""
        of_byte, rank, merges = self.of_byte, self.rank, self.merges
        symbol: list[int] = []
        bounds = [0]
        for w in words:
            symbol.extend([of_byte[b] for b in w.encode("utf-8", "replace")])
            bounds.append(len(symbol))
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for a, z in zip(bounds, bounds[1:], strict=False):
            if z > a:
                before[a], after[z - 1] = -1, -1
        where: dict[int, list[int]] = {}
        for p, q in enumerate(after):
            if q >= 0 and (r := rank.get(symbol[p] * _WIDTH + symbol[q])) is not None:
                where.setdefault(r, []).append(p)
        heap = sorted(where)
        while heap:
            r = heappop(heap)
            left, right, made = merges[r]
            at = where.pop(r)
            at.sort()
            for p in at:
                q = after[p]
                if symbol[p] != left or q < 0 or symbol[q] != right:
                    continue
                symbol[p], symbol[q] = made, -1
                z = after[p] = after[q]
                if z >= 0:
                    before[z] = p
                    if (k := rank.get(made * _WIDTH + symbol[z])) is not None:
                        if k in where:
                            where[k].append(p)
                        else:
                            where[k] = [p]
                            heappush(heap, k)
                y = before[p]
                if y >= 0 and (k := rank.get(symbol[y] * _WIDTH + made)) is not None:
                    if k in where:
                        where[k].append(y)
                    else:
                        where[k] = [y]
                        heappush(heap, k)
        return [tuple([s for s in symbol[a:z] if s >= 0]) for a, z in zip(bounds, bounds[1:], strict=False)]

    def _learn(self, pieces: Iterable[str], into: dict[str, tuple[int, ...]], lead: str) -> None:
        cut = [(p, self.pretokens(lead + p)) for p in pieces]
        fresh = {w for _, ws in cut for w in ws}.difference(self.words)
        if self.given:
            given = self.given
            self.words.update((w, given[w]) for w in fresh if w in given)
            fresh.difference_update(given)
        fresh = list(fresh)
        self.words.update(zip(fresh, self.replay(fresh), strict=True))
        words = self.words
        for p, ws in cut:
            into[p] = words[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable([words[w] for w in ws]))

    def encode(self, texts: list[str | None]) -> tuple[array, array]:
        """(offsets, ids) of a block of texts, as flat arrays."""
        if len(self.words) + len(self.chunks) + len(self.heads) > self.max_known:
            self.words, self.chunks, self.heads = {}, {}, {}
        cut = [_SPACE.split(t) if t else None for t in texts]
        heads = {c[0] for c in cut if c}
        rest: set[str] = set()
        for c in cut:
            if c:
                rest.update(c[1:] if len(c) > 1 else ())
        self._learn(heads.difference(self.heads), self.heads, "")
        self._learn(rest.difference(self.chunks), self.chunks, " ")
        ids, offsets = array("i"), array("i", [0])
        known = self.chunks.__getitem__
        for c in cut:
            if c:
                ids.extend(self.heads[c[0]])
                ids.extend(chain.from_iterable(map(known, c[1:])))
            offsets.append(len(ids))
        return offsets, ids


def replayer(path: str) -> MergeReplay:
    """The vocabulary with the words met so far, kept for all tasks of a Python worker; functions come anew with each task, the process stays."""
    held = sys.__dict__.setdefault("_quern_vocabularies", {})
    if path not in held:
        held.clear()
        held[path] = MergeReplay(path)
    return held[path]


def corpus_words(documents: DataFrame, max_known: int = 300_000) -> DataFrame:
    """(word, n): the distinct pre-tokens of the corpus with the number of batches of texts that hold them.

    A worker cuts each distinct stretch between single spaces once and folds its words before they are shuffled,
    in tables of at most about ``max_known`` entries, which are sent on and begun anew when full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pretokens = regex.compile(PATTERN).findall
        cut: dict[str, list[str]] = {}  # behind a space
        held: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "replace") for w in held], pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            chunks: set[str] = set()
            heads: set[str] = set()
            for t in b.column(0).to_pylist():
                head, *rest = _SPACE.split(t)
                heads.add(head)
                chunks.update(rest)
            words = set(chain.from_iterable(map(pretokens, heads)))
            for c in chunks:
                if (w := cut.get(c)) is None:
                    w = cut[c] = pretokens(" " + c)
                words.update(w)
            held.update(words)
            if len(held) > max_known or len(cut) > max_known:
                yield flush()
                held, cut = Counter(), {}
        yield flush()

    return documents.where("text is not null and text != ''").select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids): each distinct word of the corpus encoded once, the words of a batch of rows by one replay of the merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replayer(path)
        for b in batches:
            ids = bpe.replay([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return words.mapInArrow(run, "word binary, n long, ids array<int>")


def _within(words: DataFrame, known_bytes: int) -> DataFrame:
    """The most wide-spread words whose table takes at most ``known_bytes`` in a worker: all if they fit, else those from a count on that does."""
    cost = F.length("word") + 8 * F.size("ids") + 120
    by_count = words.groupBy(F.floor(F.log2(F.col("n") + 0.5)).alias("_b")).agg(F.sum(cost).alias("_bytes")).orderBy(F.desc("_b")).collect()  # 64 rows at most
    used, least = 0, None
    for r in by_count:
        if used + r["_bytes"] > known_bytes:
            break
        used, least = used + r["_bytes"], r["_b"]
    return words.limit(0) if least is None else words.where(F.floor(F.log2(F.col("n") + 0.5)) >= least)


def encode_corpus(documents: DataFrame, path: str | None = None, block: int = 2000, known_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, ids) of every document; ``path`` names the vocabulary file, ``block`` the texts looked up together, ``known_bytes`` bounds the table of encoded words that is sent out."""
    path = path or vocabulary_path()
    kind = documents.schema["doc_id"].dataType.simpleString()
    words = checkpointed(encoded_words(corpus_words(documents), path))
    rows = _within(words, known_bytes).select("word", "ids").toArrow()
    given = {w.decode("utf-8", "replace"): tuple(x) for w, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)}
    shipped = ship(documents.sparkSession, given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replayer(path)
        bpe.given = unpack(shipped)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                offsets, ids = bpe.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every ordinary token of a vocabulary in JSON."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    at = _byte_of_char()
    return {i: bytes(at[c] for c in token) for token, i in vocab.items() if all(c in at for c in token)}


def decoded(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): what the ids stand for."""
    path = path or vocabulary_path()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = token_bytes(path)
        for b in batches:
            texts = [b"".join([of[i] for i in ids]).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
