"""Noise in text from scanned pages: broken words, misread letters, running lines, page numbers.

An averaged perceptron edits characters: before each character of a word it decides whether a letter was
lost there (insert) and for the character whether to keep, delete or replace it; another one decides at a
line's final hyphen whether the word is joined. Which operations there are is learned from the corpus: rare
words that differ from a frequent one in one short stretch of letters show what recognition makes of what
(``confusions``; a short list of well-known ones counts as one observation each, so that small inputs have
some). The perceptrons are trained on frequent words with such errors put in, and the margin from which an
edit counts comes from words held out, misread and clean. Furniture is found
by page position: lines at a page's edges that recur there on other pages of the document, or carry the
page's number (number minus page is the same on several pages), or alternate with such lines.

The model is fitted on all pages, whose words are counted; every rare word is held against the frequent ones. It holds the
trusted words, those that stand four times or more in the pages it is fitted on, and in each million of their words, and are no
misreading of another.
All pages are then judged alike: every word that is not trusted is counted over them and edited
once, and an edit with a sufficient margin counts if the word it leads to is known and clearly more frequent:
trusted words by their share in the pages of the fit, others by the counts of the pages that are judged.

Defined results
* null and empty pages have no defects and give no paragraphs; text in backquotes is never misread;
* a line with several defects gives one row each, a furniture line only its own;
* a hyphen at the end of a document's last page is judged without a second half;
* pages without a document or number are judged by themselves alone; repeated pages count as one page with
  several texts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import checkpointed
from quern.shipping import ship, unpack

#: Well-known errors of recognition (right, wrong), each worth one observation.
CONFUSIONS = (
    ("e", "c"), ("o", "0"), ("i", "í"), ("s", "5"), ("t", "+"), ("n", "ri"), ("l", "|"), ("l", "1"), ("h", "b"), ("d", "cl"), ("g", "9"), ("u", "ii"),
    ("m", "rn"), ("w", "vv"), ("rn", "m"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("b", "6"), ("z", "2"), ("a", "@"), ("q", "9"), ("i", "1"), ("i", "|"), ("i", "!"), ("l", "!"), ("o", "c"),
)
HYPHENS = "-‐‑¬­"
_END = re.compile(rf"([^\W\d_][^\W_]*(?:[+|!@][^\W_]+)*)([{HYPHENS}])[ \t\r]*$")
_START = re.compile(r"\s*([^\W_]+(?:[+|!@][^\W_]+)*)")
_TOKEN = re.compile(r"[^\W_]+(?:[+|!@][^\W_]+)*[+|]?")
#: The same, but nothing of names with underscores.
_WORDS = re.compile(r"(?<!\w)[^\W_]++(?:[+|!@][^\W_]++)*+[+|]?(?!_)")
_CODE = re.compile(r"`[^`\n]*`")
_COMPOUND = re.compile(r"(?<![\w-])([^\W\d_]+)[-‐‑]([^\W\d_]+)(?![\w-])")
_HEAD_NUMBER = re.compile(r"^\s*(?P<n>\S{1,7})\s{3,}(?P<text>\S.*?)\s*$")
_TAIL_NUMBER = re.compile(r"^\s*(?P<text>\S.*?)\s{3,}(?P<n>\S{1,7})\s*$")
_PAGE = re.compile(r"^[-–—\[(]?\s*(?:([^\W\d_][\w.]{0,7}?)\.?\s+|([^\W\d_]\.)\s*)?([\w|í!]{1,7})(?:\s*(?:/|of|von|de|van|sur|do)\s*[\w|í!]{1,7})?\s*[-–—\])]?$")
_ROMAN = re.compile(r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
#: Words before a page's number.
PAGE_WORDS = frozenset("page p pág pag página pagina seite s blz blad bladzijde folio fol".split())
_FOLD = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ri", "n"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("el", "d"))
_FOLD1 = str.maketrans("0í5+|1b96c2@!", "oistllhgheza" + "l")
_DIGIT = str.maketrans("lI|!íOoSsBgqZz", "11111005589922")
EDGE = 3


def fold(text: str) -> str:
    """A key that misread and right forms of a line share."""
    t = text.lower().translate(_FOLD1)
    for a, b in _FOLD:
        t = t.replace(a, b)
    return re.sub(r"[\W_]+", "", t)


def roman(text: str) -> int | None:
    """Value of a Roman numeral."""
    if not text or not _ROMAN.match(text):
        return None
    value, last = 0, 0
    for c in reversed(text):
        n = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c]
        value += -n if n < last else n
        last = max(last, n)
    return value


def number(token: str) -> tuple[int, bool] | None:
    """(value, whether Roman) of a page number, digits misread as letters included."""
    if re.fullmatch(r"[\dlI|!íOoSsBgqZz]+", token) and (any(map(str.isdigit, token)) or re.fullmatch(r"[lI|!O]+", token) and len(token) > 1):
        return int(token.translate(_DIGIT)), False
    low = token.lower()
    for form in (low, low.replace("í", "i").replace("|", "i").replace("1", "i").replace("!", "i"), low.replace("í", "i").replace("|", "l").replace("1", "l").replace("u", "ii")):
        if (v := roman(form)) is not None:
            return v, True
    return None


def page_mark(line: str) -> tuple[int, bool] | None:
    """(number, whether the style alone says so) if the line is only a page's number."""
    s = line.strip()
    m = _PAGE.match(s) if len(s) <= 24 else None
    if not m or (n := number(m.group(3))) is None:
        return None
    word = (m.group(1) or m.group(2) or "").rstrip(".").lower()
    if word and word not in PAGE_WORDS and fold(word) not in {fold(w) for w in PAGE_WORDS}:
        return None
    styled = bool(word) or s[0] in "-–—[(" or "/" in s or n[1] and len(m.group(3)) > 1
    return n[0], styled


def running(line: str) -> tuple[str, int | None]:
    """(text, page number) of an edge line: a short token set off by a gap is its number."""
    for pattern in (_HEAD_NUMBER, _TAIL_NUMBER):
        if (m := pattern.match(line)) and (n := number(m.group("n"))) is not None:
            return m.group("text"), n[0]
    return line.strip(), None


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
#: An edge line: side 0 is the page's top, 1 its bottom; mark is whether the line is only a number.
_EDGE = "line int, side int, rank int, mark int, key string, number int, styled boolean, plain boolean, title boolean, first string, last string"


def _fields(schema: str) -> list[list[str]]:
    return [f.strip().rsplit(" ", 1) for f in schema.split(", ")]


def _columns(rows: list[tuple], schema: str) -> list[pa.Array]:
    fields = _fields(schema)
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return [pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, fields, strict=True)]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_columns(rows, schema), [n for n, _ in _fields(schema)])


def _edge_lines(lines: list[tuple[int, str]], firsts: dict[int, str], lasts: dict[int, str]) -> list[tuple]:
    """What place and shape say of the lines at a page's edges (side 0 top, 1 bottom); ``lines`` are those that are not blank."""
    out = []
    usual = max(sorted(len(x) for _, x in lines)[len(lines) // 2], 30) if lines else 30
    top = lines[:EDGE]
    for side, part in ((0, top), (1, lines[: max(EDGE, len(lines) - EDGE) - 1 : -1])):
        for rank, (i, x) in enumerate(part):
            mark = page_mark(x)
            body, n = running(x) if "   " in x else (x.strip(), None)
            plain = title = False
            if body and not body[0].islower() and body[-1] not in _ENDS:
                words = body.count(" ") + 1
                plain = words <= 12 and not _SECTION.search(body)
                title = plain and words <= 9 and len(body) <= 0.85 * usual and body[0].isupper()
            key = None if mark or not (plain or n is not None) else fold(body) or None
            out.append((i, side, rank, int(mark is not None), key, mark[0] if mark else n, bool(mark and mark[1]), plain, title, firsts.get(i, ""), lasts.get(i, "")))
    return out


_ENDS = frozenset(".,;:!?" + HYPHENS)
_SECTION = re.compile(r"\d+\.\d+$")


def survey(text: str, trusted: frozenset[str] | set[str]) -> tuple[int, list, list, list]:
    """(number of words, edge lines, words that are not trusted, broken line ends) of a page's text.

    A word is (line, word, whether it opens its line), a line end (line, first half, second half, sign, line of the
    second half); halves of broken words are only in the latter.
    """
    low = text.lower()
    if "`" in low:
        low = _CODE.sub(" ", low)
    n, words, breaks, lines, firsts, lasts = 0, [], [], [], {}, {}
    held = None  # the last line's end, while the next line is not known
    raw = text.split("\n")
    for i, line in enumerate(low.split("\n"), 1):
        if not line or line.isspace():
            continue
        lines.append((i, raw[i - 1]))
        found = _WORDS.findall(line)
        n += len(found)
        opens = 0
        first = ""
        if found:
            body = line.lstrip()
            if body.startswith(found[0]):
                first = firsts[i] = found[0]
        if held:
            breaks.append((*held[:2], first, held[2], i))
            opens, held = (1 if first else 0), None
        stop = line.rstrip()
        if stop[-1] in HYPHENS and found and (m := _END.search(stop, stop.rfind(" ") + 1)):
            held = (i, m.group(1), m.group(2))
            lasts[i] = m.group(1) + m.group(2)
            found = found[:-1] if len(found) > opens else found
        if len(found) > opens:
            if opens:
                found = found[1:]
            for w in found:
                if w not in trusted and len(w) > 1 and not w.isdigit():
                    words.append((i, w, w is first))
    if held:
        breaks.append((*held[:2], None, held[2], None))
    return n, _edge_lines(lines, firsts, lasts), words, breaks


_SURVEY = "page_id long, doc_id long, page_number int, n int, words string, breaks string"
#: Between the parts of an entry and between entries; neither stands in a word.
_TAB, _LF = "\t", "\n"


def _packed(entries: list[tuple]) -> str:
    """Small entries as one text, which crosses to Python and back at a fraction of a list's cost."""
    return _LF.join([_TAB.join(["" if x is None else str(x) for x in e]) for e in entries])


def _unpacked(text: str) -> list[list[str]]:
    return [e.split(_TAB) for e in text.split(_LF)] if text else []


def surveyed(pages: DataFrame, trusted: frozenset[str] | set[str], with_text: bool = False) -> DataFrame:
    """One small row a page (pages of the same id stay apart by ``uid``): see ``survey``. Texts are read once; they come along if asked for."""
    shipped = ship(pages.sparkSession, frozenset(trusted))
    parts = [n for n, _ in _fields(_EDGE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpack(shipped)
        for b in batches:
            rows, edges, offsets = [], [], [0]
            texts = b.column(3).to_pylist()
            for page, doc, num, t in zip(*(c.to_pylist() for c in b.columns[:3]), texts, strict=True):
                n, at_edges, words, breaks = survey(t, known)
                rows.append((page, doc, num, n, _packed(words), _packed(breaks)))
                edges += at_edges
                offsets.append(len(edges))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(_columns(edges, _EDGE), parts))
            names = [n for n, _ in _fields(_SURVEY)]
            yield pa.RecordBatch.from_arrays([*_columns(rows, _SURVEY), lists, *([b.column(3)] if with_text else [])], [*names, "edges", *(["content"] if with_text else [])])

    base = pages.select(F.col("page_id").cast("long"), F.col("doc_id").cast("long"), F.col("page_number").cast("int"), "content").where(F.col("content").isNotNull() & (F.col("content") != ""))
    edge = ",".join(f"{n}:{t}" for n, t in _fields(_EDGE))
    return base.mapInArrow(run, f"{_SURVEY}, edges array<struct<{edge}>>" + (", content string" if with_text else "")).withColumn("uid", F.monotonically_increasing_id())


def furniture(found: DataFrame) -> DataFrame:
    """(uid, page_id, line, defect): the edge lines of surveyed pages that are a running_line or a page_number.

    Only lines that could be one are looked at. All groups are folded before they are shuffled; a document's
    lines only meet its own counts.
    """
    could = F.filter("edges", lambda e: (e["mark"] == 1) | e["plain"] | e["number"].isNotNull())
    edge = found.select("uid", "page_id", "doc_id", "page_number", F.explode(could).alias("_e")).select("uid", "page_id", "doc_id", "page_number", "_e.line", "_e.side", "_e.rank", "_e.mark", "_e.key", "_e.number", "_e.styled", "_e.plain", "_e.title")
    offset = F.col("number") - F.col("page_number")
    spread_over = (F.min("page_number").alias("_a"), F.max("page_number").alias("_z"))
    recurs = edge.where("length(key) >= 3 and plain").groupBy("doc_id", "side", "key").agg(*spread_over).where("_a < _z").select("doc_id", "side", "key", F.lit(True).alias("_recurs"))
    steady = edge.where("number is not null").groupBy("doc_id", offset.alias("_offset")).agg(*spread_over).where("_a < _z").select("doc_id", "_offset", F.lit(True).alias("_steady"))
    known = (
        edge.withColumn("_offset", offset)
        .join(recurs, ["doc_id", "side", "key"], "left")
        .join(steady, ["doc_id", "_offset"], "left")
        .withColumns({"_recurs": F.coalesce("_recurs", F.lit(False)), "_steady": F.coalesce("_steady", F.lit(False))})
        .withColumn("_runs", (F.col("mark") == 0) & ((F.col("_recurs") & F.col("plain")) | (F.col("_steady") & F.col("number").isNotNull())))
    )
    known = checkpointed(known)
    even = F.col("page_number") % 2 == 0
    per = lambda side: F.col("_runs") & (F.col("side") == side)
    own = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("rank", "side", "_runs")]
    of_doc = known.select("doc_id", "page_number", "rank", "side", "_runs").unionByName(found.select("doc_id", "page_number", *own)).groupBy("doc_id").agg(
        F.min("page_number").alias("_first"), F.max("page_number").alias("_last"),
        *[F.struct(F.min(F.when(per(k), F.col("rank"))).alias("rank"), F.count_if(per(k) & even).alias("even"), F.count_if(per(k) & ~even).alias("odd")).alias(f"_side{k}") for k in (0, 1)],
    )
    bare = (F.col("mark") == 1) & ~F.col("styled") & ~F.col("_steady")
    alone = (F.col("_first") == F.col("_last")) & (F.col("rank") == 0) & (F.col("number") < 1000)
    side = F.when(F.col("side") == 0, F.col("_side0")).otherwise(F.col("_side1"))
    here, there = F.when(even, side["even"]).otherwise(side["odd"]), F.when(even, side["odd"]).otherwise(side["even"])
    alternates = (F.col("mark") == 0) & F.col("title") & (F.col("rank") == side["rank"]) & (here == 0) & (there > 0)
    defect = F.when((F.col("mark") == 1) & (F.col("styled") | F.col("_steady")) | (bare & alone), "page_number").when(F.col("_runs") | F.coalesce(alternates, F.lit(False)), "running_line")
    return known.join(of_doc, "doc_id", "left").select("uid", "page_id", "line", defect.alias("defect")).where("defect is not null")


class Perceptron:
    """Averaged multi-class perceptron over named features."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = defaultdict(dict)
        self.total: dict[tuple[str, str], float] = defaultdict(float)
        self.stamp: dict[tuple[str, str], int] = defaultdict(int)
        self.seen = 0

    def scores(self, features: list[str], classes: list[str]) -> dict[str, float]:
        out = dict.fromkeys(classes, 0.0)
        for f in features:
            if w := self.weights.get(f):
                if len(w) < len(classes):  # most features know few of the classes
                    for c, v in w.items():
                        if c in out:
                            out[c] += v
                else:
                    for c in classes:
                        out[c] += w.get(c, 0.0)
        return out

    def learn(self, features: list[str], classes: list[str], right: str) -> bool:
        """Learn one lesson; whether it was needed."""
        self.seen += 1
        s = self.scores(features, classes)
        guess = max(classes, key=lambda c: (s[c], c))
        if guess != right:
            for f in features:
                for c, step in ((right, 1.0), (guess, -1.0)):
                    k = (f, c)
                    self.total[k] += (self.seen - self.stamp[k]) * self.weights[f].get(c, 0.0)
                    self.stamp[k] = self.seen
                    self.weights[f][c] = self.weights[f].get(c, 0.0) + step
        return guess != right

    def average(self) -> Perceptron:
        for f, w in self.weights.items():
            for c in w:
                k = (f, c)
                w[c] = (self.total[k] + (self.seen - self.stamp[k]) * w[c]) / max(1, self.seen)
        self.weights = {f: {c: v for c, v in w.items() if v} for f, w in self.weights.items()}
        self.total, self.stamp = {}, {}
        return self


def _window(word: str, i: int) -> list[str]:
    s = f"^^{word}$$"
    j = i + 2
    return [f"0{s[j]}", f"-1{s[j - 1 : j + 1]}", f"+1{s[j : j + 2]}", f"3{s[j - 1 : j + 2]}", f"-2{s[j - 2 : j + 1]}", f"+2{s[j : j + 3]}", f"5{s[j - 2 : j + 3]}"]


KEEP, DELETE, JOIN, NONE = "keep", "delete", "join", "none"
#: A right form occurs so often at least, so many times as often as the form read, and as a form the editor likes better.
LEAST, FAR, FARTHER = 4, 8, 20
#: Forms of a word that are followed up at once, the likeliest; and how rare a word is beside a frequent one that it may stand for.
BEAM, RARE = 48, 20
#: A trusted word stands ``LEAST`` times in so many words at least: what misreadings and fragments there are recurs in proportion to the pages.
WORDS = 1_000_000
#: So many clean words there are at least for one that an edit may change.
FALSE = 200


def page_words(text: str) -> list[str]:
    """Whole words of a page in lower case, halves of broken words left out, and compounds with their hyphen."""
    out: list[str] = []
    broken = False
    for line in text.split("\n"):
        if not line.strip():
            continue
        if "`" in line:
            line = _CODE.sub(" ", line)
        found = _WORDS.findall(line.lower())
        if broken and found:
            found = found[1:]
        broken = line.rstrip()[-1:] in HYPHENS and bool(_END.search(line))
        if broken and found:
            found = found[:-1]
        out += found
        if "-" in line:
            out += [f"{m[1]}-{m[2]}".lower() for m in _COMPOUND.finditer(line)]
    return out


#: A sign at a line's end.
_SIGN = re.compile(rf"[{HYPHENS}](?=[ \t\r]*$)", re.M)


def word_counts(texts: Iterable[str]) -> Counter:
    """How often each word of ``page_words`` stands in the pages; no word holds white space, so each distinct run between white space is read once."""
    runs: Counter = Counter()
    out: Counter = Counter()
    gone: Counter = Counter()
    for text in texts:
        if "‐" in text or "‑" in text:
            out.update(page_words(text))
            continue
        bare = _CODE.sub(" ", text) if "`" in text else text
        runs.update(bare.split())
        follows = -1  # where the line begins that holds a broken word's second half
        for m in _SIGN.finditer(bare):
            begin = bare.rfind("\n", 0, m.start()) + 1
            line = bare[begin : m.end()]
            if not _END.search(line, line.rfind(" ") + 1):
                continue
            found = _WORDS.findall(line.lower())
            if len(found) > (begin == follows):
                gone[found[-1]] += 1
            follows = -1
            at = bare.find("\n", m.end())
            while at >= 0:
                end = bare.find("\n", at + 1)
                after = bare[at + 1 :] if end < 0 else bare[at + 1 : end]
                if after.strip() or (bare is not text and text.split("\n")[bare.count("\n", 0, at + 1)].strip()):
                    follows = at + 1
                    if found := _WORDS.findall(after.lower()):
                        gone[found[0]] += 1
                    break
                at = end
    for run, n in runs.items():
        for w in _WORDS.findall(run.lower()):
            out[w] += n
        if "-" in run:
            for m in _COMPOUND.finditer(run):
                out[f"{m[1]}-{m[2]}".lower()] += n
    out.subtract(gone)
    return +out


def holes_of(counts: dict[str, int]) -> dict[tuple[str, str], list[tuple[str, str]]]:
    """Frequent words by what stands on either side of each of their stretches of up to two letters."""
    holes: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    for w, n in counts.items():
        if n >= RARE and len(w) >= 4 and w.isalpha():
            for i in range(len(w)):
                for k in (0, 1, 2):
                    if i + k <= len(w):
                        holes[w[:i], w[i + k :]].append((w, w[i : i + k]))
    return holes


def shown(words: Iterable[tuple[str, int]], most: int, counts: dict[str, int], holes: dict[tuple[str, str], list[tuple[str, str]]]) -> tuple[Counter, Counter]:
    """(right, wrong) stretches that words (with their numbers) show, and how many of them stand at the word's end; ``most`` is the number of the most frequent word.

    A rare word shows a stretch if it equals just one word, at least ``RARE`` times as frequent, but for the stretch.
    """
    seen: Counter = Counter()
    at_end: Counter = Counter()
    for r, n in words:
        if n * RARE > most or len(r) < 4 or r.isdigit() or "-" in r:
            continue
        best: dict[str, tuple[int, str, str, bool]] = {}
        for i in range(len(r)):
            for k in (0, 1, 2):
                if i + k > len(r):
                    continue
                for w, right in holes.get((r[:i], r[i + k :]), ()):
                    wrong = r[i : i + k]
                    if counts[w] >= RARE * n and right != wrong and (right or wrong):
                        size = len(right) + len(wrong)
                        if w not in best or size < best[w][0]:
                            best[w] = (size, right, wrong, i + k == len(r))
        if best:
            least = min(b[0] for b in best.values())
            hit = [b for b in best.values() if b[0] == least]
            if len(hit) == 1:
                seen[hit[0][1:3]] += 1
                at_end[hit[0][1:3]] += hit[0][3]
    return seen, at_end


def chosen(seen: Counter, at_end: Counter) -> dict[tuple[str, str], int]:
    """The stretches that count as confusions: errors fall anywhere in a word, endings do not; one that stands at the words' ends nearly always is an ending."""
    seen = Counter(dict.fromkeys(CONFUSIONS, 1)) + seen
    total = sum(seen.values())
    need = max(4, total // 400)
    return {c: n for c, n in seen.items() if c in CONFUSIONS or (n >= need and at_end[c] <= 0.5 * n)}


def confusions(counts: dict[str, int]) -> dict[tuple[str, str], int]:
    """(right, wrong) stretches of up to two letters with the number of rare words that show them."""
    return chosen(*shown(counts.items(), max(counts.values(), default=0), counts, holes_of(counts)))


def edit_of(right: str, wrong: str) -> tuple[list[str], list[str]]:
    """(insertions before each letter, operations on each letter) that turn a wrong stretch of letters into the right one."""
    gaps, ops = [NONE] * len(wrong), [KEEP] * len(wrong)
    if not wrong:
        return gaps, ops
    if len(right) > len(wrong):
        gaps[0] = right[: len(right) - len(wrong)]
        right = right[len(right) - len(wrong) :]
    for k, c in enumerate(wrong):
        ops[k] = DELETE if k >= len(right) else KEEP if right[k] == c else right[k]
    return gaps, ops


def least(total: int) -> int:
    """How often a trusted word stands among so many words at least."""
    return max(LEAST, -(-LEAST * total // WORDS))


class Editor:
    """The character editor with the words it trusts.

    ``counts`` holds the words that stand ``least`` times or more, rarer ones may be left out. What has to be known of all words is
    then given apart: ``total`` is their number, ``found`` their confusions, ``occur`` tells how often some forms stand among them.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, found: dict[tuple[str, str], int] | None = None, occur: Callable[[set[str]], dict[str, int]] | None = None) -> None:
        self.counts = counts
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.least = least(self.total)
        self.found = confusions(counts) if found is None else found
        self.occur = occur or (lambda forms: {w: counts[w] for w in forms if w in counts})
        self.ops: dict[str, list[str]] = {}
        self.gaps: dict[str, list[str]] = {}
        for right, wrong in sorted(self.found):
            gaps, ops = edit_of(right, wrong)
            for c, g, o in zip(wrong, gaps, ops, strict=True):
                mine = self.ops.setdefault(c, [KEEP])
                if o not in mine:
                    mine.append(o)
                if g != NONE and g not in self.gaps.setdefault(c, [NONE]):
                    self.gaps[c].append(g)
        self.usual = {c: frozenset(g) for c, g in self.gaps.items()}
        self.letters, self.lost, self.lines = Perceptron(), Perceptron(), Perceptron()
        self.threshold = 0.0
        self.trusted: dict[str, int] = {}
        self.firsts: set[str] = set()
        self.known: dict[str, str | None] = {}
        self.size = 0

    def fit(self, seed: int = 7) -> Editor:
        rng = random.Random(seed)
        frequent = sorted((w for w, n in self.counts.items() if n >= self.least and "-" not in w and not w.isdigit()), key=lambda w: (-self.counts[w], w))
        suspect = {w for w in frequent if any(self.counts.get(c, 0) >= FAR * self.counts[w] for c in self.simple_repairs(w))} | self._misread_often(frequent)
        usable = [w for w in frequent if w.isalpha() and len(w) > 2 and w not in suspect]
        weight = sorted(self.found.items(), key=lambda x: (-x[1], x[0]))
        by_first = defaultdict(list)
        for (right, wrong), n in weight:
            if right and wrong:
                by_first[right[0]].append((right, wrong, n))
        for w in usable:  # any letter may be lost before another
            for a, b in zip(w[1:], w[2:], strict=False):
                if a not in self.gaps.setdefault(b, [NONE]):
                    self.gaps[b].append(a)
        lessons: list[tuple[str, str, list[str], list[str]]] = []
        for w in usable:
            lessons.append((w, w, [NONE] * len(w), [KEEP] * len(w)))
            for turn in range(8):
                noisy, gaps, ops, i = "", [], [], 0
                loses = rng.randint(1, len(w) - 3) if turn >= 5 and len(w) >= 6 else -1
                lost = ""
                may = [k for k in range(len(w)) if any(w.startswith(x[0], k) for x in by_first.get(w[k], ()))]
                sure = rng.choice(may) if may else -1  # one error at least, where any is possible
                while i < len(w):
                    fits = [x for x in by_first.get(w[i], ()) if w.startswith(x[0], i)] if not lost and turn < 5 else []
                    if i == loses:
                        lost, i = w[i], i + 1
                        continue
                    if fits and (i == sure or rng.random() < 0.25):
                        right, wrong, _ = rng.choices(fits, [x[2] ** 0.5 for x in fits])[0]
                        g, o = edit_of(right, wrong)
                        noisy, gaps, ops, i = noisy + wrong, gaps + g, ops + o, i + len(right)
                    else:
                        noisy, gaps, ops, i = noisy + w[i], [*gaps, lost or NONE], [*ops, KEEP], i + 1
                        lost = ""
                lessons.append((w, noisy, gaps, ops))
        apart = frozenset(usable[9::10]) if len(usable) >= 100 else frozenset()  # these words are not taught in any form
        held = [x for x in lessons if x[0] in apart]
        taught = [x for x in lessons if x[0] not in apart]
        for _ in range(2):
            rng.shuffle(taught)
            for _, noisy, gaps, ops in taught:
                for i, (g, o) in enumerate(zip(gaps, ops, strict=True)):
                    near = None
                    if (classes := self.ops.get(noisy[i])) and o in classes:
                        near = _window(noisy, i)
                        self.letters.learn(near, classes, o)
                    if i and (classes := self.gaps.get(noisy[i])) and g in classes and (g != NONE or rng.random() < 0.3):
                        self.lost.learn(near or _window(noisy, i), classes, g)
        self.size = len(usable)
        self.letters.average()
        self.lost.average()
        self.trusted = {w: n for w, n in self.counts.items() if n >= self.least}
        self.threshold = self._margin(held)
        self.trusted = {w: n for w, n in self.trusted.items() if w not in suspect or not self._explained(w)}
        compounds = [w for w in self.trusted if "-" in w]
        self.firsts = {w.split("-", 1)[0] for w in compounds}
        breaks: list[tuple[tuple[str, str, str], str]] = []
        for w in usable:
            if len(w) >= 6:
                k = rng.randint(2, len(w) - 2)
                breaks.append(((w[:k], w[k:], rng.choice(HYPHENS)), JOIN))
        for w in compounds:  # together about half as many lessons as whole words give
            a, b = w.split("-", 1)
            breaks += [((a, b, "-"), KEEP)] * max(1, len(usable) // (2 * len(compounds)))
        for _ in range(12):
            rng.shuffle(breaks)
            wrong = sum(self.lines.learn(self._line_features(a, b, sign, self.trusted), [KEEP, JOIN], op) for (a, b, sign), op in breaks)
            if not wrong:
                break
        self.lines.average()
        return self

    def _margin(self, held: list[tuple[str, str, list[str], list[str]]]) -> float:
        """The least margin of a held-out misread word's right form that at most one in ``FALSE`` held-out clean words reaches with a far more frequent word."""
        right: list[float] = []
        wrong: list[float] = []
        real = self.occur({noisy for w, noisy, _, _ in held if noisy != w})
        for w, noisy, _, _ in held:
            best = {t: m for m, t in self._forms(noisy) if t in self.trusted}
            if noisy == w:
                wrong.append(max((m for t, m in best.items() if self.counts[t] >= FAR * self.counts[w]), default=-1e9))
            elif FAR * real.get(noisy, 0) <= self.counts[w]:  # else it may be a word itself
                right.append(best.get(w, -1e9))
        cuts = sorted(m for m in right if m > -1e9)
        if not cuts:
            return 0.0
        beyond = [cuts[0] - pstdev(cuts), *cuts]  # few held-out words do not show the least margin there is
        return next((c for c in beyond if FALSE * sum(m >= c for m in wrong) <= len(wrong)), cuts[-1])

    def _misread_often(self, frequent: list[str]) -> set[str]:
        """Words that any number of confusions make of one far more frequent; in many pages such misreadings recur as often as rare words."""
        single = {c: c for pair in self.found for c in pair if len(c) == 1}

        def root(c: str) -> str:
            while single.get(c, c) != c:
                c = single[c]
            return c

        longer = []
        for right, wrong in sorted(self.found):
            if len(right) == len(wrong) == 1:
                single[root(wrong)] = root(right)
            elif right and wrong:
                longer.append((right, wrong) if len(right) > len(wrong) else (wrong, right))
        alike: dict[str, list[str]] = defaultdict(list)
        roots = str.maketrans({c: root(c) for c in single})
        for w in frequent:  # words made of each other mostly share a key
            key = w
            for a, b in longer:
                key = key.replace(a, b)
            alike[key.translate(roots)].append(w)
        return {w for group in alike.values() for k, w in enumerate(group) if any(self.counts[t] >= FAR * self.counts[w] and self.made_of(t, w) for t in group[:k])}

    def made_of(self, right: str, wrong: str) -> bool:
        """Whether confusions alone make the one word of the other."""
        reached = {(0, 0)}
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            if (i, j) == (len(right), len(wrong)):
                return True
            steps = [(i + 1, j + 1)] if right[i : i + 1] == wrong[j : j + 1] != "" else []
            steps += [(i + len(a), j + len(b)) for a, b in self.found if a and b and right.startswith(a, i) and wrong.startswith(b, j)]
            for at in steps:
                if at not in reached:
                    reached.add(at)
                    todo.append(at)
        return False

    def _explained(self, w: str) -> bool:
        """Whether a word that occurs often is itself the misreading of one that occurs far more often."""
        n = self.counts[w]
        return any(self.counts.get(t, 0) >= FAR * n for m, t in self._forms(w) if m >= self.threshold)

    def simple_repairs(self, word: str) -> list[str]:
        out = []
        for right, wrong in self.found:
            if wrong and wrong in word:
                out.append(word.replace(wrong, right))
                out += [word[:i] + right + word[i + len(wrong) :] for i in range(len(word)) if word.startswith(wrong, i)]
        return out

    def _forms(self, low: str) -> list[tuple[float, str]]:
        """(margin, form) that a word in lower case may stand for, the likeliest first: scores of the edits above those of leaving all as it is."""
        if low.isdigit() or len(low) < 2:
            return []
        beam: list[tuple[float, str]] = [(0.0, "")]
        for i, c in enumerate(low):
            ops, gaps = self.ops.get(c), self.gaps.get(c) if i else None
            near = _window(low, i) if ops or gaps else None
            if gaps:
                points = self.lost.scores(near, gaps)
                base = points[NONE]
                usual = self.usual.get(c, ())
                into = [(points[g] - base, g) for g in gaps if g != NONE and (points[g] > base or g in usual)]  # a letter lost alone only where the perceptron says so
                if into:
                    beam += [(s + d, t + g) for s, t in beam for d, g in into]
            if ops:
                points = self.letters.scores(near, ops)
                base = points[KEEP]
                beam = [(s + points[o] - base, t + (c if o == KEEP else "" if o == DELETE else o)) for s, t in beam for o in ops]
            else:
                beam = [(s, t + c) for s, t in beam]
            if len(beam) > BEAM:
                beam.sort(key=lambda x: -x[0])
                beam = beam[:BEAM]
        best: dict[str, float] = {}
        for s, t in beam:
            if t != low and t and s > best.get(t, -1e9):
                best[t] = s
        return sorted(((s, t) for t, s in best.items()), key=lambda x: (-x[0], x[1]))

    def forms(self, low: str) -> list[str]:
        """The forms whose margin suffices, the likeliest first."""
        return [t for m, t in self._forms(low) if m >= self.threshold]

    def settle(self, low: str, share: float | None) -> tuple[str | None, list[str]]:
        """(right form, forms that are left to the counts of all words): what a word that is not trusted was misread from.

        ``share`` is the word's share of all words, None for a single occurrence, which is no evidence for the word.
        """
        best, left = None, []
        for t in self.forms(low):
            if (n := self.trusted.get(t)) is not None:
                if (share is None or n / self.total >= FAR * share) and (best is None or n > FARTHER * self.trusted[best]):
                    best = t
            else:
                left.append(t)
        return best, left if best is None else []

    def repair(self, word: str) -> str | None:
        """The trusted word that was misread as this one, None if it is trusted or was not misread."""
        low = word.lower()
        if low not in self.known:
            n = self.counts.get(low, 0)
            self.known[low] = None if low in self.trusted else self.settle(low, n / self.total if n > 1 else None)[0]
        return self.known[low]

    def _line_features(self, a: str, b: str, sign: str, n: dict[str, int]) -> list[str]:
        whole, compound = n.get(a + b, 0), n.get(f"{a}-{b}", 0)
        side = "whole" if whole > compound else "compound" if compound else "neither"
        return ["bias", f"sign={sign in '-‐‑'}", f"side={side}", f"side={side}&halves={a in n}{b in n}", f"halves={a in n}{b in n}", f"lower={b.islower()}"]

    def joins(self, a: str, b: str, sign: str, n: dict[str, int]) -> bool:
        s = self.lines.scores(self._line_features(a, b, sign, n), [KEEP, JOIN])
        return s[JOIN] > s[KEEP]

    def local(self, a: str, b: str, sign: str) -> bool | None:
        """Whether a line's final hyphen was put in when the word was broken, None if the trusted words do not tell."""
        if not b:
            return not (sign in "-‐‑" and a in self.trusted and a in self.firsts)
        if a + b in self.trusted or f"{a}-{b}" in self.trusted:
            return self.joins(a, b, sign, self.trusted)
        return None

    def decide(self, a: str, b: str, sign: str, fixed: dict[str, str], counts: dict[str, int]) -> bool:
        """The same where the trusted words do not tell, by what is known of the word, the compound and the halves over all pages."""
        if not counts.get(a + b) and not counts.get(f"{a}-{b}"):
            if fixed.get(a + b):
                return True
            a, b = fixed.get(a, a), fixed.get(b, b)
        n = {w: self.trusted.get(w) or counts.get(w) for w in (a, b, a + b, f"{a}-{b}")}
        return self.joins(a, b, sign, {w: k for w, k in n.items() if k})

    def join(self, a: str, b: str, sign: str) -> bool:
        """The decision by the trusted words alone."""
        a, b = a.lower(), b.lower()
        if (told := self.local(a, b, sign)) is not None:
            return told
        fixed = {w: f for w in (a + b, a, b) if (f := self.repair(w))}
        return self.decide(a, b, sign, fixed, {})

    repair_place = staticmethod(lambda fixed, half, tail=False: not (fixed.endswith(half.lower()) if tail else fixed.startswith(half.lower())))

    def shipped(self) -> Editor:
        """What is sent out: the fitted weights and the trusted words."""
        other = copy.copy(self)
        other.counts, other.known, other.occur = {}, {}, None
        return other


def _counted(pages: DataFrame) -> DataFrame:
    """(word, n): the words of all pages (see ``page_words``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = word_counts(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    there = pages.select("content").where(F.col("content").isNotNull() & (F.col("content") != ""))
    return checkpointed(there.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def _shown(words: DataFrame, most: int, counts: dict[str, int]) -> tuple[Counter, Counter]:
    """What all words show (see ``shown``)."""
    shipped = ship(words.sparkSession, {w: n for w, n in counts.items() if n >= RARE})
    schema = "right string, wrong string, n long, at_end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = unpack(shipped)
        holes = holes_of(frequent)
        for b in batches:
            seen, at_end = shown(zip(*(c.to_pylist() for c in b.columns), strict=True), most, frequent, holes)
            yield _batch([(*c, n, at_end[c]) for c, n in seen.items()], schema)

    rare = words.where((F.col("n") * RARE <= most) & (F.length("word") >= 4))
    rows = rare.mapInArrow(run, schema).groupBy("right", "wrong").agg(F.sum("n").alias("n"), F.sum("at_end").alias("at_end")).orderBy("right", "wrong").toArrow().to_pylist()
    return Counter({(r["right"], r["wrong"]): r["n"] for r in rows}), Counter({(r["right"], r["wrong"]): r["at_end"] for r in rows})


def train(pages: DataFrame) -> Editor:
    """The editor fitted on all pages; the words that may be trusted come to the driver, at most a quarter of ``WORDS``, as they are the model."""
    spark = pages.sparkSession
    words = _counted(pages)
    total, most = words.agg(F.sum("n"), F.max("n")).first()
    often = words.where(F.col("n") >= least(total or 0)).orderBy("word").toArrow()
    counts = dict(zip(often.column(0).to_pylist(), often.column(1).to_pylist(), strict=True))

    def occur(forms: set[str]) -> dict[str, int]:
        asked = spark.createDataFrame(pa.table({"word": pa.array(sorted(forms), pa.string())}))
        met = words.join(asked, "word", "left_semi").select("word", "n").toArrow()
        return dict(zip(met.column(0).to_pylist(), met.column(1).to_pylist(), strict=True))

    return Editor(counts, total or 0, chosen(*_shown(words, most or 0, counts)), occur).fit()


class Answers:
    """Stands in an editor's place with the answers to a page's questions."""

    def __init__(self, fixed: list[dict] | None, joined: list[dict] | None) -> None:
        self.fixed = {f["word"]: f["fixed"] for f in fixed or ()}
        self.joined = {(j["a"], j["b"], j["sign"]) for j in joined or ()}

    def repair(self, word: str) -> str | None:
        return self.fixed.get(word.lower())

    def join(self, a: str, b: str, sign: str) -> bool:
        return (a.lower(), b.lower(), sign) in self.joined

    repair_place = Editor.repair_place


def examine(text: str, flagged: dict[int, str], following: str, editor: Editor, preceding: str = "") -> tuple[list[tuple[int, str]], list[tuple[bool, str]]]:
    """(defects by line, paragraphs): the page's defects and its text, repaired and flowing.

    ``following`` is the first word of the next page's body, ``preceding`` what stands before the break at the
    end of the previous page (first half and sign), if a word was broken there. A paragraph is (whether a blank line or the
    page's start stands before it as a break, text).
    """
    defects: list[tuple[int, str]] = list(flagged.items())
    lines = text.split("\n")
    body = [(i, x) for i, x in enumerate(lines, 1) if i not in flagged]
    out: list[str] = []
    paragraphs: list[str] = []
    carried: tuple[str, int] | None = None  # first half of a broken word and its line
    begin = next((k for k, (_, x) in enumerate(body) if x.strip()), -1)
    for at, (i, raw) in enumerate(body):
        line = raw.rstrip()
        if not line.strip():
            if out and carried is None:
                paragraphs.append(" ".join(out))
                out = []
            continue
        end = _END.search(line)
        next_line = next((x for _, x in body[at + 1 :] if x.strip()), None)
        second = (m.group(1) if (m := _START.match(next_line)) else "") if next_line is not None else following
        broken = end is not None and "`" not in line[max(0, end.start() - 1) :] and editor.join(end.group(1), second, end.group(2))
        if broken:
            defects.append((i, "hyphenation"))
        misread = False
        pieces: list[str] = []
        done = 0
        masked = _CODE.sub(lambda m: " " * len(m.group()), line) if "`" in line else line
        tokens = list(_WORDS.finditer(masked))
        for k, m in enumerate(tokens):
            word = m.group()
            if k == 0 and carried is not None and m.start() == len(masked) - len(masked.lstrip()):
                first, line_of = carried
                carried = None
                whole = first + word
                fixed = editor.repair(whole)
                if fixed:
                    if editor.repair_place(fixed, first):
                        defects.append((line_of, "misread"))
                    if editor.repair_place(fixed, word, tail=True):
                        misread = True
                pieces += [line[done : m.start()], cased(fixed, whole) if fixed else whole]
                done = m.end()
                if out:
                    head = out[-1]
                    out[-1] = head[: len(head) - len(first)]
                    if not out[-1].strip():
                        out.pop()
                    else:
                        pieces[0] = out.pop() + pieces[0].lstrip()
                continue
            if broken and m.start() == end.start(1):
                continue
            if k == 0 and at == begin and preceding and editor.join(preceding[:-1], word, preceding[-1]):
                fixed = editor.repair(preceding[:-1] + word)
                misread |= bool(fixed) and editor.repair_place(fixed, word, tail=True)
                continue
            if fixed := editor.repair(word):
                misread = True
                pieces += [line[done : m.start()], cased(fixed, word)]
                done = m.end()
        if misread:
            defects.append((i, "misread"))
        tail = line[done : end.start(2)] if broken else line[done:]
        out.append("".join(pieces) + tail)
        out[-1] = out[-1].strip() if not broken else out[-1].lstrip()
        carried = (end.group(1), i) if broken else None
        if broken and next_line is None and following:
            fixed = editor.repair(end.group(1) + following)
            if fixed and editor.repair_place(fixed, end.group(1)):
                defects.append((i, "misread"))
    if out:
        paragraphs.append(" ".join(x for x in out if x))
    return sorted(set(defects)), [(k > 0, p) for k, p in enumerate(p.strip() for p in paragraphs) if p]


def cased(word: str, like: str) -> str:
    """The word in the capitals of the one it replaces."""
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def _placed(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Surveyed pages with their furniture lines (``flags``), their body's edge lines (``heads``), the next page's first body line (``after``) and what was broken at the end of the one before (``before``).

    A document's pages meet their neighbours on (document, number): one small row a page.
    """
    flags = marked.groupBy("uid").agg(F.collect_list("line").alias("_flags"))
    body = F.filter("edges", lambda e: ~F.array_contains(F.coalesce("_flags", F.array().cast("array<int>")), e["line"]))
    own = rows.join(flags, "uid", "left").withColumn("_body", body)
    number = F.col("page_number")
    first = F.array_min(F.transform(F.filter("_body", lambda e: e["side"] == 0), lambda e: F.struct(e["line"].alias("line"), e["first"].alias("first"), F.col("page_id").alias("page_id"))))
    last = F.array_max(F.transform("_body", lambda e: F.struct(e["line"].alias("line"), e["last"].alias("last"))))
    near = (
        own.where("doc_id is not null and page_number is not null")
        .select("doc_id", F.explode(F.array(
            F.struct((number - 1).alias("page_number"), first.alias("head"), F.lit(None).cast("struct<line:int,last:string>").alias("tail")),
            F.struct((number + 1).alias("page_number"), F.lit(None).cast("struct<line:int,first:string,page_id:bigint>").alias("head"), last.alias("tail")),
        )).alias("_n"))
        .select("doc_id", "_n.*")
        .groupBy("doc_id", "page_number")
        .agg(F.min("head").alias("after"), F.max("tail").getField("last").alias("before"))
    )
    heads = F.array_join(F.transform("_body", lambda e: F.concat_ws(_TAB, e["line"].cast("string"), e["first"])), _LF)
    lines = F.array_join(F.transform("_flags", lambda x: x.cast("string")), _TAB)
    kept = [c for c in rows.columns if c != "edges"]
    return own.join(near, ["doc_id", "page_number"], "left").select(*kept, lines.alias("flags"), heads.alias("heads"), F.coalesce(F.concat(F.col("after.line").cast("string"), F.lit(_TAB), F.coalesce(F.col("after.page_id").cast("string"), F.lit("")), F.lit(_TAB), F.coalesce("after.first", F.lit(""))), F.lit("")).alias("after"), F.coalesce("before", F.lit("")).alias("before"))


_EVENTS = "kind string, uid long, page_id long, line int, a string, b string, sign string, page2 long, line2 int"


def page_events(page: int, heads: str, words: str, breaks: str, flags: str | None, after: str, before: str, editor: Editor) -> Iterator[tuple]:
    """(kind, page, line, a, b, sign, page2, line2): ``w`` a word that may be misread, ``h`` a line end that is joined, ``q`` one that the trusted words do not settle."""
    flagged = {int(x) for x in flags.split(_TAB)} if flags else set()
    order = sorted((int(i), f[0] if f else "") for i, *f in _unpacked(heads))
    ended = []
    taken = set()  # lines whose first word is the second half of another line's last
    if before and order:
        taken.add(order[0][0])
    for line, a, b, sign, to in _unpacked(breaks):
        line, line2, page2 = int(line), int(to) if to else None, page
        if line in flagged:
            continue
        if line2 is not None and line2 in flagged:
            line2, b = next(((i, f) for i, f in order if i > line2), (None, ""))
        if line2 is None:
            at, other, b = after.split(_TAB) if after.count(_TAB) == 2 else ("", "", "")
            line2, page2 = int(at) if at else None, int(other) if other else None
        else:
            taken.add(line2)
        ended.append((line, a, b, sign, page2, line2))
    for line, word, head in _unpacked(words):
        i = int(line)
        if i not in flagged and not (head == "True" and i in taken):
            yield "w", page, i, word, None, None, None, None
    for line, a, b, sign, page2, line2 in ended:
        told = editor.local(a, b, sign)
        if told is None:
            yield "q", page, line, a, b, sign, page2, line2
        elif told:
            yield "h", page, line, a, b, sign, page2, line2
        else:
            for half, p, i in ((a, page, line), (b, page2, line2)):
                if half and half not in editor.trusted and len(half) > 1 and not half.isdigit():
                    yield "w", p, i, half, None, None, None, None


def _events(placed: DataFrame, editor: Editor) -> DataFrame:
    shipped = ship(placed.sparkSession, editor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = unpack(shipped)
        for batch in batches:
            rows = []
            for uid, page, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.extend([(k, uid, *e) for k, *e in page_events(page, *parts, fitted)])
            yield _batch(rows, _EVENTS)

    some = placed.where("words != '' or breaks != ''")
    return some.select("uid", "page_id", "heads", "words", "breaks", "flags", "after", "before").mapInArrow(run, _EVENTS)


def repairs(words: DataFrame, total: int, editor: Editor) -> DataFrame:
    """(word, n, fixed) of words (word, n of all occurrences) that are not trusted; ``total`` is the number of all words of all pages.

    Each distinct word is edited once. Forms among the trusted words are settled there; others meet the counts.
    """
    shipped = ship(words.sparkSession, editor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = unpack(shipped)
        for b in batches:
            rows = []
            for w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append((w, n, *(fitted.settle(w, n / max(1, total) if n > 1 else None) if w not in fitted.trusted else (None, []))))
            yield _batch(rows, "word string, n long, fixed string, forms array<string>")

    told = checkpointed(words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(run, "word string, n long, fixed string, forms array<string>"))
    asked = told.where("fixed is null and size(forms) > 0").select("word", F.col("n").alias("_mine"), F.posexplode("forms").alias("_k", "form"))
    often = told.where(F.col("n") >= LEAST).select(F.col("word").alias("form"), F.col("n").alias("_n"))
    usable = asked.join(often, "form").where((F.col("_mine") <= 1) | (F.col("_n") >= FAR * F.col("_mine")))
    ranked = usable.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("_n").alias("n"), "form"))).alias("_forms"))  # at most BEAM a word
    best = F.aggregate("_forms", F.lit(None).cast("struct<k:int,n:bigint,form:string>"), lambda best, x: F.when(best.isNull() | (x["n"] > FARTHER * best["n"]), x).otherwise(best))
    late = ranked.select("word", best["form"].alias("_late"))
    return told.join(late, "word", "left").select("word", "n", F.coalesce("fixed", "_late").alias("fixed"))


def _line_ends(breaks: DataFrame, answers: DataFrame, editor: Editor) -> DataFrame:
    """(a, b, sign, joined, whole, fixed_a, fixed_b): line ends that the trusted words do not settle, each once, with the repairs of the word and its halves."""
    shipped = ship(breaks.sparkSession, editor)
    schema = "a string, b string, sign string, joined boolean, whole string, fixed_a string, fixed_b string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = unpack(shipped)
        for batch in batches:
            rows = []
            for a, b, sign, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fixed = {t["word"]: t["fixed"] for t in told if t["fixed"]}
                counts = {t["word"]: t["n"] for t in told if t["n"]}
                rows.append((a, b, sign, fitted.decide(a, b, sign, fixed, counts), fixed.get(a + b), fixed.get(a), fixed.get(b)))
            yield _batch(rows, schema)

    once = breaks.select("a", "b", "sign").distinct()
    asked = once.select("a", "b", "sign", F.explode(_lookups()).alias("word"))
    told = asked.join(answers, "word").groupBy("a", "b", "sign").agg(F.collect_list(F.struct("word", "n", "fixed")).alias("_told"))
    return told.mapInArrow(run, schema)


def _lookups():
    return F.array_distinct(F.array(F.concat("a", "b"), F.concat_ws("-", "a", "b"), "a", "b"))


def _judged(pages: DataFrame, editor: Editor, with_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(placed pages, furniture lines, events, answers to words, answers to line ends)."""
    fitted = editor.shipped()
    rows = checkpointed(surveyed(pages, editor.trusted, with_text))
    marked = checkpointed(furniture(rows))
    placed = _placed(rows, marked)
    placed = checkpointed(placed) if with_text else placed
    events = checkpointed(_events(placed, fitted))
    total = rows.agg(F.sum("n")).first()[0] or 0
    ends = events.where("kind = 'q'")
    words = events.where("kind = 'w'").select(F.col("a").alias("word"), F.lit(1).alias("n")).unionByName(ends.select(F.explode(_lookups()).alias("word"), F.lit(0).alias("n")))
    answers = checkpointed(repairs(words.groupBy("word").agg(F.sum("n").alias("n")), total, fitted))
    return placed, marked, events, answers, _line_ends(ends, answers, fitted)


def defects(pages: DataFrame, editor: Editor) -> DataFrame:
    """(page_id, line_no, defect): one row per line and defect."""
    _, marked, events, answers, ends = _judged(pages, editor)
    row = lambda page, line, defect: F.struct(page.alias("page_id"), line.alias("line_no"), F.lit(defect).alias("defect"))
    here, there = (F.col("page_id"), F.col("line")), (F.col("page2"), F.col("line2"))
    wrong_start = F.col("whole").isNotNull() & ~F.col("whole").startswith(F.col("a"))
    wrong_end = F.col("whole").isNotNull() & ~F.col("whole").endswith(F.col("b"))
    misread = lambda at, c: F.when(c & at[1].isNotNull(), row(*at, "misread"))
    joined = F.array(row(*here, "hyphenation"), misread(here, wrong_start), misread(there, wrong_end & (F.col("b") != "")))
    apart = F.array(misread(here, F.col("fixed_a").isNotNull()), misread(there, F.col("fixed_b").isNotNull()))
    at_ends = events.where("kind = 'q'").join(ends, ["a", "b", "sign"]).select(F.explode(F.filter(F.when(F.col("joined"), joined).otherwise(apart), lambda x: x.isNotNull())).alias("_d")).select("_d.*")
    in_words = events.where("kind = 'w'").join(answers.where("fixed is not null").select(F.col("word").alias("a")), "a", "left_semi").select("page_id", F.col("line").alias("line_no"), F.lit("misread").alias("defect"))
    once = at_ends.unionByName(in_words).distinct()
    settled = events.where("kind = 'h'").select("page_id", F.col("line").alias("line_no"), F.lit("hyphenation").alias("defect"))
    return once.unionByName(settled).unionByName(marked.select("page_id", F.col("line").alias("line_no"), "defect"))


_PIECES = "doc_id long, page_number int, page_id long, k int, fresh boolean, text string"


def _repaired(pages: DataFrame, editor: Editor) -> DataFrame:
    """The pages' paragraphs (doc_id, page_number, page_id, k, fresh, text), repaired."""
    placed, marked, events, answers, ends = _judged(pages, editor, with_text=True)
    word = lambda w, f: F.struct(w.alias("word"), f.alias("fixed"))
    cut = F.struct("a", "b", "sign")
    none_w, none_j = F.lit(None).cast("struct<word:string,fixed:string>"), F.lit(None).cast("struct<a:string,b:string,sign:string>")
    fixed = answers.where("fixed is not null")
    of_words = events.where("kind = 'w'").join(fixed.select(F.col("word").alias("a"), "fixed"), "a").select("uid", word(F.col("a"), F.col("fixed")).alias("_f"), none_j.alias("_j"))
    told = events.where("kind = 'q'").join(ends, ["a", "b", "sign"])
    settled = events.where("kind = 'h'").withColumns({"joined": F.lit(True), "whole": F.lit(None).cast("string"), "fixed_a": F.lit(None).cast("string"), "fixed_b": F.lit(None).cast("string")})
    both = settled.select("uid", "page_id", "page2", "a", "b", "sign", "joined", "whole", "fixed_a", "fixed_b").unionByName(told.select("uid", "page_id", "page2", "a", "b", "sign", "joined", "whole", "fixed_a", "fixed_b"))
    # a word broken over two pages is the next page's affair as well
    ids = placed.select(F.col("page_id").alias("page2"), F.col("uid").alias("uid2"))
    over = both.where(~F.col("page2").eqNullSafe(F.col("page_id")) & F.col("page2").isNotNull()).join(ids, "page2").drop("uid").withColumnRenamed("uid2", "uid")
    all_ends = both.unionByName(over.select(*both.columns))
    parts = F.array(
        F.struct(none_w.alias("_f"), F.when(F.col("joined"), cut).alias("_j")),
        F.struct(F.when(F.col("whole").isNotNull(), word(F.concat("a", "b"), F.col("whole"))).alias("_f"), none_j.alias("_j")),
        F.struct(F.when(F.col("fixed_a").isNotNull(), word(F.col("a"), F.col("fixed_a"))).alias("_f"), none_j.alias("_j")),
        F.struct(F.when(F.col("fixed_b").isNotNull(), word(F.col("b"), F.col("fixed_b"))).alias("_f"), none_j.alias("_j")),
    )
    of_ends = all_ends.select("uid", F.explode(parts).alias("_p")).select("uid", "_p.*").where("_f is not null or _j is not null")
    answered = of_words.unionByName(of_ends).groupBy("uid").agg(F.collect_set("_f").alias("_fixed"), F.collect_set("_j").alias("_joined"))  # of one page's own words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, doc, num, text, flags, after, before, fixed, joined in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flagged = dict.fromkeys(map(int, flags.split(_TAB)), "furniture") if flags else {}
                _, found = examine(text, flagged, after.split(_TAB)[2] if after.count(_TAB) == 2 else "", Answers(fixed, joined), before)
                out.extend((doc, num, page, k, fresh, t) for k, (fresh, t) in enumerate(found))
            yield _batch(out, _PIECES)

    return placed.join(answered, "uid", "left").select("page_id", "doc_id", "page_number", "content", "flags", "after", "before", "_fixed", "_joined").mapInArrow(run, _PIECES)


def paragraphs(pages: DataFrame, editor: Editor) -> DataFrame:
    """(doc_id, paragraph_no, text): the documents' paragraphs, continued over page ends.

    Numbers of paragraphs begun before a page are running sums over small per-page counts; a paragraph's
    pieces meet only each other.
    """

    pieces = _repaired(pages, editor).withColumn("_ends", F.col("text").rlike(r"[.!?:][)\"'»”]*$|\d$|^#"))
    per_page = pieces.groupBy("doc_id", "page_number", "page_id").agg(F.count(F.lit(1)).alias("_n"), F.max_by("_ends", "k").alias("_closed"))
    order = Window.partitionBy("doc_id").orderBy("page_number", "page_id")
    begun = per_page.select(
        "doc_id", "page_number", "page_id",
        F.coalesce(F.sum(F.col("_n") - F.when(F.col("_closed"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    numbered = pieces.join(begun, ["doc_id", "page_number", "page_id"]).withColumn("paragraph_no", (F.col("_before") + F.col("k")).cast("int"))
    return (
        numbered.groupBy("doc_id", "paragraph_no")
        .agg(F.sort_array(F.collect_list(F.struct("page_number", "page_id", "k", "text"))).alias("_parts"))
        .select("doc_id", "paragraph_no", F.regexp_replace(F.array_join(F.transform("_parts", lambda p: p["text"]), " "), r"(?<=\p{L})[-‐¬­] (?=\p{Ll})", "").alias("text"))
    )
