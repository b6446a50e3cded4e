"""Languages of documents and of the segments of mixed ones, with a confidence.

Prose is what is left of a text without code blocks, inline code, quotations, addresses, tables, front
matter and identifiers. A word's script narrows its candidates (words of another script say nothing); the
others get a score per language from a model trained on labelled documents: word counts, and character
trigrams for words it has not seen. A Viterbi pass with a switching penalty, smaller at a line's start than
inside a line, labels the words; stretches of lines in one language that hold whole sentences are segments.

The model is fitted on a bounded sample of labelled rows (``per_language`` documents a language, chosen
by hash), fitted again after rows whose label the first fit contradicts have been put right.

Defined results
* null and blank texts get no language and no segments;
* a text without prose in the scripts of the languages gets the language of its code comments if they
  have words, else none (null, confidence 0);
* ties go to the language that comes first in ``LANGUAGES``; repeated rows are labelled row by row;
* other columns are ignored; an empty table gives empty results, a table without labels no language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.sources import sample_below
from quern.shipping import ship, unpack

#: The languages with the ISO 639 codes and English names a label may have.
LANGUAGES = ("en", "de", "fr", "es", "pt", "nl")
LABELS = {
    "en": "en", "eng": "en", "english": "en",
    "de": "de", "deu": "de", "ger": "de", "german": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr",
    "es": "es", "spa": "es", "spanish": "es",
    "pt": "pt", "por": "pt", "portuguese": "pt",
    "nl": "nl", "nld": "nl", "dut": "nl", "dutch": "nl",
}
MISSING = ("", "und", "unknown", "none", "null", "mul", "mis", "zxx")

_FENCE = re.compile(r"^[ \t>]*(```+|~~~+)[^\n]*$(?:.*?^[ \t>]*\1[ \t]*$|.*\Z)", re.S | re.M)
_FRONT = re.compile(r"\A﻿?\s*---[ \t]*\r?\n.*?^---[ \t]*$", re.S | re.M)
_INLINE = re.compile(r"`[^`\n]*(?:\n[^`\n]+)?`")
#: Inside of a quotation without the signs given: all of it up to a blank line.
_IN = r"(?:[^{}\n]|\n(?!\s*\n))+"
_QUOTE = re.compile("|".join((
    rf"“{_IN.format('“”')}”", rf"„{_IN.format('„“”')}[“”]", rf"«{_IN.format('«»')}»", rf"‹{_IN.format('‹›')}›", rf"(?<![\w\"])\"{_IN.format(chr(34))}\"(?!\w)", rf"(?<!\w)‘{_IN.format('‘’')}’(?!\w)",
)))
_ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]*://\S+|\bwww\.\S+|\S+@\S+\.\w+")
_TABLE = re.compile(r"^[ \t]*\|.*$", re.M)
_RUN = re.compile(r"\S{60,}")
_CITED = re.compile(r"^[ \t]*>.*$", re.M)
_BREAK = re.compile(r"\n\s*")
_STOP = re.compile(r"[^\W\d_][)\"'”»“]*[.!?:]")
_WORD = re.compile(r"(?<![\w/.$])[^\W\d_]+(?!\w)")
#: First and last letter of the ranges of each script, and the languages written in it.
SCRIPTS = (
    ("Latin", ("AZ", "az", "ÀÖ", "Øö", "øɏ"), ("en", "de", "fr", "es", "pt", "nl")),
    ("Greek", ("Ͱ\u03ff", "ἀ\u1fff"), ()), ("Cyrillic", ("Ѐ\u052f",), ()), ("Armenian", ("Ա\u058f",), ()), ("Hebrew", ("א\u05ea",), ()), ("Arabic", ("\u0600\u06ff", "ݐ\u077f"), ()),
    ("Devanagari", ("\u0900\u097f",), ()), ("Thai", ("ก\u0e7f",), ()), ("Kana", ("ぁ\u30ff",), ()), ("Han", ("㐀\u4dbf", "一\u9fff"), ()), ("Hangul", ("가\ud7a3", "ᄀ\u11ff"), ()),
)
#: Latin letters that only some of the languages write in words of their own.
LETTERS = {
    "ä": ("de", "nl"), "ö": ("de", "nl"), "ü": ("de", "es", "pt", "nl"), "ß": ("de",), "à": ("fr", "pt", "nl"), "â": ("fr", "pt"), "ç": ("fr", "pt"), "é": ("fr", "es", "pt", "nl"), "è": ("fr", "nl"), "ê": ("fr", "pt", "nl"),
    "ë": ("fr", "nl"), "î": ("fr",), "ï": ("fr", "nl"), "ô": ("fr", "pt"), "û": ("fr",), "ù": ("fr",), "œ": ("fr",), "æ": ("fr",), "ÿ": ("fr",), "á": ("es", "pt", "nl"), "í": ("es", "pt", "nl"),
    "ó": ("es", "pt", "nl"), "ú": ("es", "pt", "nl"), "ñ": ("es",), "ã": ("pt",), "õ": ("pt",), "ĳ": ("nl",),
}


def _of_letter(c: str) -> frozenset[str]:
    """The languages that a letter may belong to: those of its script, or fewer."""
    if c in LETTERS:
        return frozenset(LETTERS[c])
    return next((frozenset(langs) for _, ranges, langs in SCRIPTS if any(r[0] <= c <= r[1] for r in ranges)), frozenset())


class Scripts:
    """Candidates of words by the script ranges of their letters."""

    def __init__(self) -> None:
        self.known: dict[str, frozenset[str]] = {}
        self.all = frozenset(LANGUAGES)

    def candidates(self, low: str) -> frozenset[str]:
        """The languages that a word in lower case may belong to: empty if its letters are of other scripts or belong nowhere together."""
        out = self.all
        if low.isascii():
            return out
        for c in low:
            if c not in self.known:
                self.known[c] = _of_letter(c)
            out = out & self.known[c]
        return out


def label_language(c: Column) -> Column:
    """The language that a label names: null if it is missing, ``?`` if it names none of the languages."""
    base = F.lower(F.trim(F.regexp_extract(F.trim(c), r"^([A-Za-z]+)", 1)))
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.when(c.isNull() | base.isin(*MISSING), None).otherwise(F.coalesce(known[base], F.lit("?")))


def _blank(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def _blank_lines(m: re.Match) -> str:
    """Blanks that keep a paragraph break on either side."""
    n = m.end() - m.start()
    return "\n\n" + " " * (n - 4) + "\n\n" if n >= 4 else " " * n


def prose(text: str, strict: bool = True) -> str:
    """The text, of the same length, with all that is no prose blanked out."""
    if "\r" in text:
        text = text.replace("\r", " ")
    if strict:
        if "---" in text:
            text = _FRONT.sub(_blank_lines, text)
        if "```" in text or "~~~" in text:
            text = _FENCE.sub(_blank_lines, text)
        if ">" in text:
            text = _CITED.sub(_blank, text)
    if "`" in text:
        text = _INLINE.sub(_blank, text)
    if "|" in text:
        text = _TABLE.sub(_blank, text)
    text = _RUN.sub(_blank, text)
    if any(q in text for q in "\"“„«‹‘"):
        text = _QUOTE.sub(_blank, text)
    return _ADDRESS.sub(_blank, text) if "://" in text or "@" in text or "www" in text else text


class LanguageModel:
    """Scores of words by language, from counts of words and of character trigrams."""

    floor, neutral, known = -4.0, 0, 1

    def __init__(self, counts: dict[str, Counter]) -> None:
        self.languages, self.scripts = LANGUAGES, Scripts()
        k = len(LANGUAGES)
        words = sorted(set().union(*counts.values())) if counts else []
        table = np.zeros((len(words), k))
        grams: dict[str, np.ndarray] = {}
        for j, lang in enumerate(LANGUAGES):
            c = counts.get(lang, Counter())
            for i, w in enumerate(words):
                if n := c.get(w):
                    table[i, j] = n
                    for g in self._grams(w):
                        if g not in grams:
                            grams[g] = np.zeros(k)
                        grams[g][j] += min(n, 20)
        total = table.sum(axis=0) + 1.0
        self.empty = not len(words)
        score = np.log((table + 0.3) / (total + 0.3 * max(1, len(words))))
        score = np.maximum(score - score.max(axis=1, keepdims=True), self.floor) if len(words) else score
        self.word = {w: score[i].astype(np.float32) for i, w in enumerate(words) if table[i].sum() >= 2}
        if grams:
            keys = list(grams)
            m = np.array([grams[g] for g in keys])
            p = np.log((m + 0.5) / (m.sum(axis=0) + 0.5 * len(keys)))
            self.gram = dict(zip(keys, p - p.mean(axis=1, keepdims=True), strict=True))
        else:
            self.gram = {}

    @staticmethod
    def _grams(w: str) -> list[str]:
        s = f"^{w}$"
        return [s[i : i + 3] for i in range(len(s) - 2)]

    def score(self, w: str) -> np.ndarray | None:
        """Scores of a word (0 for the likeliest language), None if it says nothing.

        Its script leaves the candidates; the others get the least score. Words all in capitals count if they are known.
        """
        low = w.lower()
        fits = self.scripts.candidates(low)
        if not fits or not (w.islower() or w.istitle() or low in self.word):
            return None
        if (s := self.word.get(low)) is None:
            if len(low) < 3:
                return None
            s = sum((self.gram[g] for g in self._grams(low) if g in self.gram), np.zeros(len(self.languages)))
            s = np.maximum(0.5 * (s - s.max()), self.floor / 2).astype(np.float32)
        if len(fits) < len(self.languages):
            s = np.where([x in fits for x in self.languages], s - max(v for v, x in zip(s, self.languages, strict=True) if x in fits), self.floor).astype(np.float32)
        return s


def viterbi(scores: np.ndarray, length: np.ndarray, inner: float, outer: float, first: np.ndarray) -> np.ndarray:
    """Best state of each word of many sequences at once.

    ``scores`` (words x states) holds the sequences one behind the other, longest first, ``length`` their
    lengths, ``first`` marks words that begin a paragraph. Changing state costs ``inner`` inside a
    paragraph and ``outer`` at its start.
    """
    k = scores.shape[1]
    start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
    state = np.zeros(len(scores), np.int8)
    if not len(length):
        return state
    most = int(length[0])
    back = np.full((len(scores), k), -1, np.int8)
    now = scores[start].astype(np.float64)
    alive = np.searchsorted(-length, -np.arange(most), "left")  # sequences with a word at each step
    last = np.zeros(len(length), np.int8)
    for t in range(1, most):
        n = int(alive[t])
        ended = int(alive[t - 1])
        if ended > n:
            last[n:ended] = now[n:ended].argmax(axis=1)
        rows = start[:n] + t
        cur = now[:n]
        top = cur.argmax(axis=1)
        jump = cur[np.arange(n), top] - np.where(first[rows], outer, inner)
        switch = cur < jump[:, None]
        back[rows] = np.where(switch, top[:, None], -1)
        now[:n] = np.where(switch, jump[:, None], cur) + scores[rows]
    n = int(alive[most - 1])
    last[:n] = now[:n].argmax(axis=1)
    cur = last.copy()
    for t in range(most - 1, -1, -1):
        n = int(alive[t])
        rows = start[:n] + t
        state[rows] = cur[:n]
        prior = back[rows, cur[:n]]
        cur[:n] = np.where(prior >= 0, prior, cur[:n])
    return state


class Labeller:
    """Languages of the paragraphs of blocks of texts."""

    inner, outer = 14.0, 4.0

    def __init__(self, model: LanguageModel, max_known: int = 300_000) -> None:
        self.model, self.max_known = model, max_known
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def _ids(self, found: list[str]) -> list[int]:
        number = self.number
        out = []
        for w in found:
            i = number.get(w)
            if i is None:
                s = self.model.score(w)
                i = number[w] = -1 if s is None else len(self.rows)
                if s is not None:
                    self.rows.append(s)
            if i >= 0:
                out.append(i)
        return out

    def lines(self, texts: list[str | None]) -> list[tuple | None]:
        """For each text (masked text, spans of its lines with words, words per line and language, scores per line and language)."""
        if len(self.number) > self.max_known:
            self._reset()
        units: list[tuple[int, str, list[tuple[int, int]], list[list[int]]]] = []
        for i, t in enumerate(texts):
            if not t or self.model.empty:
                continue
            for strict in (True, False):
                clean = prose(t, strict)
                spans, ids, at = [], [], 0
                for z in (*[m.start() for m in _BREAK.finditer(clean)], len(clean)):
                    if z > at and (w := self._ids(_WORD.findall(clean, at, z))):
                        spans.append((at, z))
                        ids.append(w)
                    at = z
                if ids:
                    units.append((i, clean, spans, ids))
                    break
        out: list[tuple | None] = [None] * len(texts)
        if not units:
            return out
        units.sort(key=lambda u: -sum(map(len, u[3])))
        flat = np.array([w for u in units for p in u[3] for w in p], np.int64)
        sizes = np.array([len(p) for u in units for p in u[3]], np.int64)
        length = np.array([sum(map(len, u[3])) for u in units], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        first = np.zeros(len(flat), bool)
        first[begins] = True
        scores = np.array(self.rows, np.float32)[flat]
        state = viterbi(scores, length, self.inner, self.outer, first)
        votes = np.add.reduceat((state[:, None] == np.arange(len(LANGUAGES))).astype(np.int32), begins, axis=0)
        sums = np.add.reduceat(scores.astype(np.float64), begins, axis=0)
        at = 0
        for i, clean, spans, ids in units:
            out[i] = (clean, spans, votes[at : at + len(ids)], sums[at : at + len(ids)])
            at += len(ids)
        return out


def confidence(sums: np.ndarray, best: int, words: int) -> float:
    """Share of the best language in the scores, tempered for dependent words."""
    s = np.exp((sums - sums.max()) / np.sqrt(max(1, words)))
    return float(s[best] / s.sum())


def settle(found: tuple | None, least_words: int = 6, margin: float = 1.0) -> tuple[int | None, np.ndarray, list[tuple[int, int, int, np.ndarray, int]]]:
    """(language of the text, its scores, segments (start, end, language, scores, words)) from its lines.

    Consecutive lines of one language make a stretch. A stretch in another language than the text's is a
    segment if it holds whole sentences: ``least_words`` words, a sentence's end, and ``margin`` more
    score a word than the text's language; else it joins the text's language.
    """
    if found is None:
        return None, np.zeros(len(LANGUAGES)), []
    clean, spans, votes, sums = found
    total, score = votes.sum(axis=0), sums.sum(axis=0)
    main = int(total.argmax())
    words = int(total.sum())
    if total[main] == words:
        return main, score, [(spans[0][0], spans[-1][1], main, score, words)]
    merged: list[list] = []
    for (a, z), v, s in zip(spans, votes, sums, strict=True):
        lang = int(v.argmax())
        if merged and merged[-1][2] == lang:
            merged[-1][1], merged[-1][3], merged[-1][4] = z, merged[-1][3] + s, merged[-1][4] + int(v.sum())
        else:
            merged.append([a, z, lang, s, int(v.sum())])
    out: list[tuple[int, int, int, np.ndarray, int]] = []
    for a, z, lang, s, n in merged:
        if lang != main and (n < least_words or s[lang] - s[main] < margin * n or not _STOP.search(clean, a, z)):
            lang = main
        if out and out[-1][2] == lang:
            b, _, _, t, m = out[-1]
            out[-1] = (b, z, lang, s + t, n + m)
        else:
            out.append((a, z, lang, s, n))
    return main, score, out


def train(documents: DataFrame, per_language: int = 400) -> LanguageModel:
    """Fit on about ``per_language`` labelled documents a language; the sample is drawn by a hash of the id."""
    named = documents.select("doc_id", "text", label_language(F.col("lang")).alias("_l")).where(F.col("_l").isin(*LANGUAGES))
    sizes = {r["_l"]: r["n"] for r in named.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()}
    below = F.create_map(*[F.lit(x) for lang in LANGUAGES for x in (lang, min((1 << 63) - 1, sample_below(sizes.get(lang, 0), per_language) - (1 << 63)))])
    drawn = named.where(F.col("doc_id").isNotNull() & (F.xxhash64("doc_id") < below[F.col("_l")]))
    sample = drawn.select("_l", "text").limit(4 * per_language * len(LANGUAGES)).toArrow()  # the limit only tells if one id holds very many rows
    scripts = Scripts()
    given = sample.column(1).to_pylist()
    texts = [prose(t) if t else "" for t in given]
    bags = [[w.lower() for w in _WORD.findall(t) if scripts.candidates(w.lower()) and (w.islower() or w.istitle())] for t in texts]
    labels = sample.column(0).to_pylist()
    for again in (True, False):
        counts: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}
        for lang, bag in zip(labels, bags, strict=True):
            counts[lang].update(bag)
        model = LanguageModel(counts)
        if again:
            found = Labeller(model).lines(given)
            for i, f in enumerate(found):
                main, _, segments = settle(f)
                if main is not None:
                    labels[i] = LANGUAGES[main]
                    if len({s[2] for s in segments}) > 1:
                        bags[i] = []  # mixed texts teach nothing
    return model


def _labelled(documents: DataFrame, model: LanguageModel, rows, schema: str, names: list[str], types: list, extra: tuple[str, ...] = ()) -> DataFrame:
    shipped = ship(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(unpack(shipped))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                texts = b.column(1).to_pylist()
                others = [c.to_pylist() for c in b.columns[2:]]
                out = []
                for i, f in enumerate(labeller.lines(texts)):
                    out.extend((i, *r) for r in rows(texts[i], settle(f), *(o[i] for o in others)))
                cols = list(zip(*out, strict=True)) if out else [[] for _ in range(len(types) + 1)]
                docs = b.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([docs, *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], ["doc_id", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", *extra).mapInArrow(run, f"doc_id {kind}, {schema}")


def document_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang, confidence, n_languages), one row a document; lang is null for blank texts."""

    def rows(text, settled):
        main, score, found = settled
        n = sum(x[4] for x in found)
        yield (None if main is None else LANGUAGES[main], 0.0 if main is None else confidence(score, main, n), len({x[2] for x in found}))

    return _labelled(documents, model, rows, "lang string, confidence double, n_languages int", ["lang", "confidence", "n_languages"], [pa.string(), pa.float64(), pa.int32()])


def segments(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, start_offset, end_offset, lang, confidence) of each stretch of paragraphs in one language."""

    def rows(text, settled):
        yield from ((a, z, LANGUAGES[lang], confidence(s, lang, n)) for a, z, lang, s, n in settled[2])

    return _labelled(documents, model, rows, "start_offset int, end_offset int, lang string, confidence double", ["start_offset", "end_offset", "lang", "confidence"], [pa.int32(), pa.int32(), pa.string(), pa.float64()])


def wrong_labels(documents: DataFrame, model: LanguageModel, doubt: float = 3.0) -> DataFrame:
    """(doc_id, lang): the language where the label is missing or wrong, all of a mixed document's languages.

    A label whose language scores within ``doubt`` of the best is not called wrong.
    """

    def rows(text, settled, label):
        main, score, found = settled
        langs = {s[2] for s in found}
        if main is None:
            return
        if len(langs) > 1:
            yield from ((LANGUAGES[x],) for x in sorted(langs))
        elif label != LANGUAGES[main] and not (label in LANGUAGES and score[main] - score[LANGUAGES.index(label)] < doubt):
            yield (LANGUAGES[main],)

    named = documents.select("doc_id", "text", label_language(F.col("lang")).alias("_label"))
    return _labelled(named, model, rows, "lang string", ["lang"], [pa.string()], ("_label",))
