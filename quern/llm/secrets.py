"""Credentials in source code and configuration: finding and masking them.

Candidates are the values that could open something: string literals (pieces joined by ``+`` as one
value), values of assignments in configuration and shell text, and what stands behind a credential's
place in addresses, headers, commands and comments. Each is described by how likely its characters are
under a character Markov model of ordinary words, by its shape, by the identifiers and words around it
and by its path. A logistic regression weighs these features. It is trained on weak labels: patterns of
well-known key formats and of credential places are positive, placeholders, references, digests and
plain words are negative, everything else stays unlabelled. Scores are calibrated on a part held out;
values at or above the threshold are secrets. Key and certificate blocks are candidates by their frame, which is
a feature and their weak label.

The model is fitted on all files: words, features and labelled candidates are counted over the whole table. Candidates
with the same features and label are folded to one lesson with their number. What a step of the fit needs are sums over the
lessons; they are made on the driver as long as the lessons are few (``KEPT``), else where the lessons lie, a Spark job a step.

Defined results
* null and empty contents hold nothing; a secret is reported on the line its value begins on (lines are
  counted by LF); several on one line give one row;
* masking puts an ``X`` for each character of a value but keeps escapes, line ends and everything else, so
  the text keeps its length; text without secrets comes out unchanged, null stays null;
* repeated rows are judged row by row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import checkpointed
from quern.shipping import ship, unpack

#: Well-known formats of keys, only used as weak labels and as a shape feature.
KNOWN = re.compile(
    r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|xox[abprs]-[\w-]{20,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{16,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}"
)
#: Key and certificate blocks: what their frame calls them, and their body.
KEY_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*(?:PRIVATE KEY|PUBLIC KEY|CERTIFICATE)(?: BLOCK)?)-----(?:\\r|\\n|\s)*(?:[A-Za-z-]+: [^\n\\]*(?:\\r|\\n|\s)+)*([A-Za-z0-9+/=]{16,}(?:(?:\\r|\\n|[\s\"'+,])*[A-Za-z0-9+/=]+)*)")
PLACEHOLDER = re.compile(
    r"\$\{|\$\(|^\$\w|\{\{|%\(|^%\w+%$|^<.*>$|process\.env|os\.environ|getenv|^env[.(]|\bvault\b|^x{4,}$|^\*+$|^\.{3,}$|^[X_-]+$|change.?me|replace.?me|^your[-_ ]|your.*here|^(?:example|sample|dummy|test|todo|tbd|none|null|redacted|secret|password|token|placeholder|foo|bar|string)$|<[a-z][\w -]*>",
    re.I,
)
DIGEST = re.compile(r"^(?:sha\d+[-:=])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$|^sha\d+-[A-Za-z0-9+/=]{20,}$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
#: Name parts that announce a secret, and those that make a name speak about one.
SECRET_WORDS = frozenset("password passwd passphrase pwd pass secret token apikey key credential credentials auth authtoken".split())
ABOUT_WORDS = frozenset(
    "name hint rule rules pattern regex mask hash checksum digest sum etag commit sha id ids uuid trace integrity public verify help text label title message banner file path dir url host user length size count limit max min policy prompt description doc example field column header_name type".split()
)

_STRING = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\\n])*`"
#: Literals joined by an operator, also over line ends; the second form joins neighbours without one, as Python does.
_JOINED = r"[ \t]*(?:\r?\n[ \t]*)?(?:\+|\.\.|\.)[ \t]*(?:\r?\n[ \t]*)?"
_LITERAL = re.compile(rf"(?:{_STRING})(?:{_JOINED}(?:{_STRING}))*")
_LITERAL_PY = re.compile(rf"(?:{_STRING})(?:(?:{_JOINED}|[ \t]*\r?\n[ \t]*|[ \t]+)[rRbBuU]?(?:{_STRING}))*")
_PIECE = re.compile(_STRING)
_URL = re.compile(r"://([^\s/:@\"'`<>]*):([^\s/@\"'`]+)@")
_SCHEME = re.compile(r"[a-zA-Z][\w+.-]*\Z")
_QUERY = re.compile(r"[?&;]([\w.-]*(?:key|token|sig|signature|secret|password|passwd|pwd|auth|credential)[\w.-]*)=([^\s\"'`<>&#;]+)", re.I)
_HEADER = re.compile(r"\b(Bearer|Basic|Token|ApiKey)[ \t]+([^\s\"'`,;<>]{6,})", re.I)
#: Options: by their name, as user:password, and the password glued to ``-p`` behind the commands that take it so.
_OPTION = re.compile(r"-(?<!\S-)-?([\w-]*(?:password|passwd|pwd|pass|token|secret|api-?key|key)[\w-]*)(?:[ \t]+|=)([^\s\"'`]+)|-(?<!\S-)(u|-user)[ \t]+([^\s:\"'`]+):([^\s\"'`]+)", re.I)
_GLUED = re.compile(r"\b(?:mysql\w*|mariadb[\w-]*|sshpass)\b[^\n|;&]*?[ \t]-p([^\s\"'`=]+)")
_SAID = re.compile(r"\b(password|passwd|pwd|passphrase|secret|token|_authToken|_password|_auth)\b(?:[ \t]+(?:(?:was|is|now|set to|changed to)\b[ \t]*)?|[ \t]*[=:][ \t]*)([^\s\"'`=:?&-][^\s\"'`]*)", re.I)
#: A credential among the settings or headers of a text with spaces.
_SETTING = re.compile(r"(?<![\w.-])([\w.-]*(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)[\w.-]*)[ \t]*[=:][ \t]*[\"']?([^\s\"'`;,&=:]+)", re.I)
_SECRETIVE = re.compile(r"pass|pwd|secret|token|key|credential|auth", re.I)
_LOGIN = re.compile(r"\blog(?:in|on)[ \t]+(?:as[ \t]+)?([^\s/]+)[ \t]*/[ \t]*([^\s\"'`]+)", re.I)
_ASSIGN = re.compile(r"^[ \t]*(?:-[ \t]+)?(?:export[ \t]+|set[ \t]+|ENV[ \t]+)?[\"']?([\w./:@-]*[\w\]])[\"']?[ \t]*[=:][ \t]*([^\s\"'`{\[#][^\s\"'`]*)[ \t]*,?[ \t\r]*$")
_LOOSE = re.compile(r"(?<![\w+/=.@:-])[\w+/=.!#@$%^&*~-]{12,}(?![\w+/=])")
_COUNT = re.compile(r"[A-Za-z_]\w*=\d{0,6}")
_COMMENT = re.compile(r"^\s*(?://|#|\*|/\*|--|<!--)|\s(?://|#)\s")
_NAMED = re.compile(r"([A-Za-z_$][\w$.\-]*)[\"']?\]?\s*(?::\s*[\w<>\[\]]+\s*)?(?::=|=>|==|=|:)\s*[\w.]*\(?[fFrRbB]?$")
_CALLED = re.compile(r"([A-Za-z_$][\w$.]*)\(([^()]*)$")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_WORD = re.compile(r"[A-Za-z]{3,}")
_JUMBLED = re.compile(r"[a-z][A-Z][A-Z]*[a-z]?[A-Z]?.*[a-z][A-Z]|[A-Z]{2}[a-z].*[A-Z]|[a-z][A-Z]{2}.*[a-z]|[a-z][A-Z]\w*[!#$%^&*]\w")
_HOST = re.compile(r"^(?:[a-z0-9-]+\.)+[a-z]{2,}(?::\d+)?$|^\d+(?:\.\d+){3}(?::\d+)?$")
_CONNECTS = re.compile(r"connect|login|logon|auth|sign_?in", re.I)
CONFIG = frozenset(".env .netrc .npmrc .sh .bash .properties .ini .cfg .conf .toml .yml .yaml .md .txt .pem .key .crt .json .xml .pypirc".split())


@dataclass(frozen=True)
class Candidate:
    """A value with its place; ``spans`` are the stretches of text that hold it."""

    value: str
    line: int
    spans: tuple[tuple[int, int], ...]
    kind: str
    name: str
    before: str
    comment: bool


def extension_of(path: str | None) -> str:
    base = re.split(r"[/\\]", path or "")[-1].lower()
    return "." + base.rsplit(".", 1)[1] if "." in base else base


def candidates(text: str, path: str | None) -> list[Candidate]:
    """Values of a text that could be secrets, each stretch of text once."""
    out: list[Candidate] = []
    ext = extension_of(path)
    config = ext in CONFIG
    lines = text.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    comments: dict[int, bool] = {}
    seen: dict[int, list[tuple[int, int]]] = {}
    taken: list[tuple[int, int]] = []
    for m in KEY_BLOCK.finditer(text) if "-----BEGIN " in text else ():
        out.append(Candidate(m.group(2), bisect_right(starts, m.start()), (m.span(2),), "block", "", m.group(1).lower(), False))
        if "PRIVATE" in m.group(1):
            taken.append((m.start(), m.end()))

    def commented(number: int) -> bool:
        if number not in comments:
            comments[number] = _COMMENT.search(lines[number - 1]) is not None
        return comments[number]

    def add(value: str, spans: list[tuple[int, int]], kind: str, name, before, number: int = 0) -> None:
        if len(value) < 5:
            return
        number = number or bisect_right(starts, spans[0][0])
        here = seen.setdefault(number, [])
        if any(a < z2 and a2 < z for a, z in spans for a2, z2 in (*here, *taken)):
            return
        here.extend(spans)
        out.append(Candidate(value, number, tuple(spans), kind, name() if callable(name) else name, before() if callable(before) else before, commented(number)))

    low = text.lower()
    if "://" in text:
        for m in _URL.finditer(text):
            head = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            if scheme := _SCHEME.search(head):
                add(m.group(2), [m.span(2)], "url", _name_before(head, scheme.start()), "")
    if "=" in text:
        for m in _QUERY.finditer(text):
            add(m.group(2), [m.span(2)], "query", m.group(1), m.group(1).lower())
    if any(x in low for x in ("bearer", "basic", "token", "apikey")):
        for m in _HEADER.finditer(text):
            number = bisect_right(starts, m.start())
            named = _ASSIGN.match(lines[number - 1])
            head = text[starts[number - 1] : m.start()]
            add(m.group(2), [m.span(2)], "header", _name_before(head, len(head)) or (named.group(1) if named else ""), m.group(1).lower())
    if "-" in text:
        for m in _OPTION.finditer(text):
            name = text[m.start() : m.end(1)] if m.group(2) else f"-{m.group(3)}"
            add(m.group(2) or m.group(5), [m.span(2) if m.group(2) else m.span(5)], "option", name if m.group(2) else "user", name.lower())
        if " -p" in text and any(x in low for x in ("mysql", "mariadb", "sshpass")):
            for m in _GLUED.finditer(text):
                add(m.group(1), [m.span(1)], "option", "password", "-p")
    if "log" in low and "/" in text:
        for m in _LOGIN.finditer(text):
            add(m.group(2), [m.span(2)], "said", "login", "/")
    if '"' in text or "'" in text or "`" in text:
        _literals(text, _LITERAL_PY if ext in (".py", ".pyw") else _LITERAL, starts, add)
    for number, line in enumerate(lines, 1):
        if len(line) < 6 or not (config or "//" in line or "#" in line or "*" in line or "--" in line) or line.isspace():
            continue
        comment = commented(number)
        if not (config or comment):
            continue
        start = starts[number - 1]
        put = lambda m, g, kind, name, before: add(m.group(g), [(start + m.start(g), start + m.end(g))], kind, name, before, number)  # noqa: B023, E731
        named = _ASSIGN.match(line)
        if named and "://" not in named.group(2):
            put(named, 2, "assigned", named.group(1), "")
        for m in _SAID.finditer(line):
            put(m, 2, "said", m.group(1), m.group(1).lower())
        if comment or ext in (".md", ".txt"):
            for m in _LOOSE.finditer(line):
                if m.group()[:1] != "/" and "//" not in m.group() and not _HOST.match(m.group()) and not _COUNT.fullmatch(m.group()):
                    put(m, 0, "loose", "", _last_word(line, m.start()))
    return out


def _literals(text: str, pattern: re.Pattern, starts: list[int], add) -> None:
    """String literals that are values: not keys, not short, with spaces only where a secret's name or setting is near."""
    for m in pattern.finditer(text):
        begin, end = m.span()
        if end - begin < 7:
            continue
        whole = m.group()
        if len(whole) > 2 and whole.find(whole[0], 1) == len(whole) - 1 and "\\" not in whole:
            pieces = [(begin, end)]
        else:
            pieces = [p.span() for p in _PIECE.finditer(text, begin, end)]
        value = "".join([text[a + 1 : z - 1] for a, z in pieces])
        if len(value) < 5:
            continue
        after = text[end : end + 2]
        if after.lstrip(" \t")[:1] == ":" and after != "::":
            continue  # a key, not a value
        number = bisect_right(starts, begin)
        head = text[starts[number - 1] : begin]
        if " " in value.strip():
            if "=" in value or ":" in value:
                for a, z in pieces:
                    for said in _SETTING.finditer(text, a + 1, z - 1):
                        add(said.group(2), [said.span(2)], "said", said.group(1), said.group(1).lower())
            name = _name_before(head, len(head)) if _SECRETIVE.search(head[-120:]) else ""
            if not (named_by := parts(name)) or named_by[-1] not in SECRET_WORDS:
                continue
        if len(pieces) > 1 and "+" not in whole and re.search(r"[\"'`][ \t\r\n]*\.[ \t\r\n]*[\"'`]", whole):
            continue
        add(value, [(a + 1, z - 1) for a, z in pieces], "literal", lambda head=head: _name_before(head, len(head)), lambda head=head: _call_before(head), number)


def _name_before(line: str, at: int) -> str:
    """The name that a value is given to."""
    head = line[max(0, at - 120) : at].rstrip("\"'`")
    tail = head.rstrip()
    if not tail or tail[-1] not in "=:>(fFrRbB" and not tail[-1].isalnum():
        return ""
    m = _NAMED.search(head)
    return m.group(1) if m else ""


_CALLEE = re.compile(r"[A-Za-z_$][\w$.]*\Z")


def _call_before(head: str) -> str:
    """The function whose argument a value is, with the argument's number."""
    head = head[-160:]
    at = head.rfind("(")
    if at <= 0 or ")" in head[at:]:
        return ""
    m = _CALLEE.search(head, max(0, at - 80), at)
    return f"{m.group()}#{head.count(',', at)}" if m else ""


def _last_word(line: str, at: int) -> str:
    found = re.findall(r"[\w-]+", line[max(0, at - 40) : at])
    return found[-1].lower() if found else ""


def parts(name: str) -> list[str]:
    """Lower-case words of an identifier: camel case, snake case and dots divide, digits drop out."""
    return [p.lower() for p in _PART.findall(name)]


def ordinary_words(texts: Iterable[str]) -> Counter:
    """Lower-case and title-case words of texts, in lower case, with their numbers."""
    seen: Counter = Counter()
    for text in texts:
        seen.update(_WORD.findall(text))
    out: Counter = Counter()
    for w, n in seen.items():
        if w.islower() or w.istitle():
            out[w.lower()] += n
    return out


def pairs_of(words: Iterable[tuple[str, int]]) -> Counter:
    """Pairs of neighbouring characters in the words that are not single, each word counted up to 50 times."""
    pairs: Counter = Counter()
    for w, n in words:
        if n > 1 and len(w) <= 20:
            s = f"^{w}$"
            for a, b in zip(s, s[1:], strict=False):
                pairs[a + b] += min(n, 50)
    return pairs


class Markov:
    """Mean log-probability of a text's characters under a bigram model of ordinary words."""

    def __init__(self, pairs: Counter) -> None:
        firsts: Counter = Counter()
        for k, n in pairs.items():
            firsts[k[0]] += n
        self.table = {k: math.log((n + 0.2) / (firsts[k[0]] + 0.2 * 40)) for k, n in pairs.items()}
        self.missing = {a: math.log(0.2 / (n + 0.2 * 40)) for a, n in firsts.items()}

    def mean(self, text: str) -> float:
        s = f"^{text.lower()}$"
        get, missing = self.table.get, self.missing
        total = 0.0
        for a, b in zip(s, s[1:], strict=False):
            p = get(a + b)
            total += p if p is not None else missing.get(a, -5.0)
        return total / (len(s) - 1)


def _bin(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


MARKOV_BINS = (-6.0, -5.5, -5.0, -4.5, -4.0, -3.6, -3.2, -2.8, -2.4)


def path_features(path: str | None) -> list[str]:
    return [f"ext={extension_of(path)}", *(f"dir={p}" for p in re.split(r"[/\\.]+", (path or "").lower())[:-1] if p)]


def features(c: Candidate, markov: Markov) -> list[str]:
    """The named features of a candidate that are present, but for its path's and whether it is in a comment; of a block only its frame and its characters."""
    v = c.value
    if c.kind == "block":
        return ["kind=block", f"frame={c.before}", f"private={'private' in c.before}", f"markov={_bin(markov.mean(v[:64]), MARKOV_BINS)}"]
    f = [f"kind={c.kind}", f"markov={_bin(markov.mean(v), MARKOV_BINS)}"]
    f.append(f"length={_bin(len(v), (8, 12, 16, 20, 24, 32, 40, 48, 64, 100, 200))}")
    lower, upper = any(map(str.islower, v)), any(map(str.isupper, v))
    digit, other = any(map(str.isdigit, v)), any(not x.isalnum() for x in v)
    f.append(f"classes={'l' * lower}{'u' * upper}{'d' * digit}{'s' * other}")
    turns = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(v, v[1:], strict=False)) / max(1, len(v) - 1)
    f.append(f"turns={_bin(turns, (0.05, 0.1, 0.2, 0.3, 0.4, 0.5))}")
    if PLACEHOLDER.search(v):
        f.append("placeholder")
    if DIGEST.match(v):
        f.append("digest")
    if KNOWN.search(v):
        f.append("known")
    if re.search(r"[\[\](){}|^\\]|\.\*", v):
        f.append("pattern")
    if "/" in v and not re.search(r"[A-Z]\d|\d[A-Z]", v) or re.match(r"^\.{0,2}/|^[\w-]+\.\w{1,5}$|^https?:", v):
        f.append("pathlike")
    if re.match(r"^[a-z]+(?:[-_. /][a-z]+)*\d{0,3}$|^[A-Z]+(?:_[A-Z]+)*$|^[a-z]+(?:[A-Z][a-z]+)+\d{0,4}$", v):
        f.append("wordlike")
    if _HOST.match(v):
        f.append("host")
    if _JUMBLED.search(v):
        f.append("jumbled")
    if re.match(r"^-?[\d.,:+-]+$", v):
        f.append("figures")
    if digit and (m := re.search(r"[A-Za-z]{3}", v)) and re.search(r"[\W_\d]", v[m.end() :]):
        f.append("word+digit")
    name = parts(c.name)
    f += [f"name={p}" for p in set(name)]
    if name and (set(name) & SECRET_WORDS):
        f.append("secretive")
        if name[-1] in ABOUT_WORDS or "public" in name or "verify" in name:
            f.append("about")
        else:
            f.append("secretive-last")
    elif name and name[-1] in ABOUT_WORDS:
        f.append("about")
    if c.before:
        call, _, index = c.before.partition("#")
        f += [f"before={p}" for p in set(parts(call) or [call])]
        if index:
            f.append(f"argument={min(int(index), 4)}")
            if _CONNECTS.search(call):
                f.append(f"connects={min(int(index), 3)}")
    return f


def weak_label(c: Candidate) -> int | None:
    """1 for values in well-known formats and places, 0 for what plainly is none, None if neither says."""
    v = c.value
    if c.kind == "block":
        return int("private" in c.before)
    if PLACEHOLDER.search(v) or v.startswith(("-", "--")):
        return 0
    name = parts(c.name)
    secretive = bool(set(name) & SECRET_WORDS) and name[-1] not in ABOUT_WORDS and not set(name) & {"public", "verify"}
    random = bool(re.search(r"\d", v) and re.search(r"[A-Za-z]", v)) or bool(_JUMBLED.search(v))
    plain = bool(re.match(r"^[a-zA-Z]+(?:[-_. /:,]+[a-zA-Z]+)*[.:,;]?$|^[\d.,:+-]+$", v)) and not _JUMBLED.search(v)
    if KNOWN.fullmatch(v):
        return 1
    if re.search(r"[\[\](){}|^\\\",]|\.\*", v):
        return 0
    if c.kind in ("url", "query"):
        return 0 if plain and len(v) < 9 else 1
    if DIGEST.match(v):
        return 1 if secretive else 0
    call, _, index = c.before.partition("#")
    if c.kind == "literal" and index and _CONNECTS.search(call):
        return 1 if int(index) >= 2 and random and not _HOST.match(v) else 0
    if plain or (_HOST.match(v) and not secretive):
        return 0
    if c.kind in ("option", "header", "said") and random and len(v) >= 6:
        return 1
    if c.kind in ("literal", "assigned") and secretive:
        return None if " " in v else 1 if random and len(v) >= 6 else 0
    if c.kind in ("literal", "assigned") and name and not set(name) & SECRET_WORDS:
        return 0
    return None


class Described:
    """Candidates' labels and features; what does not hang on the place is kept for the next candidate like it."""

    def __init__(self, markov: Markov) -> None:
        self.markov = markov
        self.kept: dict[tuple, tuple[bool, int | None, list[str]]] = {}

    def of(self, c: Candidate, of_path: list[str]) -> tuple[bool, int | None, list[str]]:
        """(whether it is plainly none, weak label, features)."""
        key = (c.kind, c.value, c.name, c.before)
        known = self.kept.get(key)
        if known is None:
            known = (ordinary(c), weak_label(c), features(c, self.markov))
            if len(c.value) <= 200:
                if len(self.kept) >= 50_000:
                    self.kept.clear()
                self.kept[key] = known
        if c.kind == "block":
            return known
        return known[0], known[1], [*known[2], f"comment={c.comment}", *of_path]


class Model:
    """Logistic regression over named features, with calibrated scores."""

    def __init__(self, markov: Markov, weights: dict[str, float], bias: float, scale: float, shift: float) -> None:
        self.markov, self.weights, self.bias, self.scale, self.shift = markov, weights, bias, scale, shift

    def scores(self, z: np.ndarray) -> np.ndarray:
        """Calibrated scores of sums of weights."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * (z + self.bias) + self.shift, -40.0, 40.0)))


def held_out(path: str | None, c: Candidate) -> bool:
    """Whether a candidate calibrates: about every fifth, by a hash of its place and value."""
    return zlib.crc32(f"{path}\t{c.spans[0][0]}\t{c.value}".encode("utf-8", "surrogatepass")) % 5 == 0


def sketch(rows: Iterable[tuple[str | None, str]], described: Described) -> tuple:
    """The candidates of files as numbers: (names of features, positions in them, number a candidate, label or -1, held out, whether it is scored, (row, line, kind, name) of those scored)."""
    names: dict[str, int] = {}
    flat: list[int] = []
    sizes, labels, held, scored, places = [], [], [], [], []
    for i, (path, text) in enumerate(rows):
        of_path = path_features(path)
        for c in candidates(text, path) if text else ():
            plain, label, f = described.of(c, of_path)
            if label is None and plain:
                continue
            flat += [names.setdefault(x, len(names)) for x in f]
            sizes.append(len(f))
            labels.append(-1 if label is None else label)
            held.append(label is not None and held_out(path, c))
            scored.append(not plain)
            if not plain:
                places.append((i, c.line, "private" if c.kind == "block" else c.kind, c.name[:100]))
    return list(names), np.array(flat, np.int32), np.array(sizes, np.int32), np.array(labels, np.int8), np.array(held, bool), np.array(scored, bool), places


def taught_names(s: tuple) -> Counter:
    """How often each feature stands in labelled candidates."""
    names, flat, sizes, labels, *_ = s
    n = np.bincount(flat[np.repeat(labels >= 0, sizes)], minlength=len(names))
    return Counter({names[i]: int(n[i]) for i in np.flatnonzero(n)})


def lessons_of(s: tuple, known: dict[str, int]) -> Counter:
    """(known features, label, held out) of labelled candidates with the number of those alike."""
    names, flat, sizes, labels, held, *_ = s
    at = np.array([known.get(x, -1) for x in names], np.int32)
    out: Counter = Counter()
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(labels >= 0):
        f = at[flat[ends[k] - sizes[k] : ends[k]]]
        f = f[f >= 0]
        f.sort()
        out[f.tobytes(), int(labels[k]), bool(held[k])] += 1
    return out


class Lessons:
    """Folded lessons as arrays."""

    def __init__(self, rows: list[tuple[bytes, int, bool, int]]) -> None:
        self.flat = np.frombuffer(b"".join(r[0] for r in rows), np.int32)
        self.row = np.repeat(np.arange(len(rows)), [len(r[0]) // 4 for r in rows])
        self.y = np.array([r[1] for r in rows], float)
        self.held = np.array([r[2] for r in rows], bool)
        self.n = np.array([r[3] for r in rows], float)

    def z(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], len(self.y)) + w[-1]

    def slope(self, w: np.ndarray, share: tuple[float, float], all_teach: bool) -> np.ndarray:
        """The weighted loss of the lessons and its gradient; the last of ``w`` is the bias."""
        z = self.z(w)
        weight = self.n * np.where(self.y == 1, share[1], share[0]) * (~self.held | all_teach)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - self.y)
        loss = (weight * (np.logaddexp(0.0, z) - self.y * z)).sum()
        return np.concatenate([[loss], np.bincount(self.flat, g[self.row], len(w) - 1), [g.sum()]])

    def spread(self, w: np.ndarray) -> np.ndarray:
        """Number and sum of the held-out lessons' z by label and bin of z."""
        z, label, n = self.z(w)[self.held], self.y[self.held].astype(int), self.n[self.held]
        at = label * len(Z_BINS) + np.searchsorted(Z_BINS[1:], z, "right")
        return np.concatenate([np.bincount(at, n, 2 * len(Z_BINS)), np.bincount(at, n * z, 2 * len(Z_BINS))])


#: Bins of the sums that calibrate; each counts by its mean.
Z_BINS = np.arange(-40.0, 40.0, 1 / 1024)


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int) -> np.ndarray:
    """The minimum of a convex function that gives its value and gradient, by limited-memory BFGS."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, back = -g, []
        for s, u, r in reversed(past):
            a = r * (s @ d)
            back.append(a)
            d = d - a * u
        if past:
            s, u, _ = past[-1]
            d = d * ((s @ u) / (u @ u))
        for (s, u, r), a in zip(past, reversed(back), strict=True):
            d = d + s * (a - r * (u @ d))
        slope, step = g @ d, 1.0 if past else 1.0 / max(1.0, float(np.abs(g).sum()))
        while True:
            to = x + step * d
            v, h = f(to)
            if v <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, u = to - x, h - g
        if value - v <= 1e-9 * value:
            return to if v < value else x
        if s @ u > 1e-12:
            past = [*past[-9:], (s, u, 1.0 / (s @ u))]
        x, value, g = to, v, h
    return x


def solved(total: Callable[[Callable[[Lessons], np.ndarray]], np.ndarray], known: dict[str, int], numbers: dict[tuple[int, bool], int], markov: Markov, rounds: int = 200, ridge: float = 1e-5) -> Model:
    """Weights and calibration; ``total`` adds up what a function says of the lessons, ``numbers`` counts candidates by label and whether they are held out."""
    if not known or not all(numbers.get((y, False), 0) + numbers.get((y, True), 0) for y in (0, 1)):
        return Model(markov, _UNTAUGHT | {"known": 8.0, "secretive-last": 2.0, "placeholder": -8.0}, -3.0, 1.0, 0.0)
    all_teach = not (numbers.get((0, False)) and numbers.get((1, False)))
    share = tuple(0.5 / (numbers.get((y, False), 0) + (numbers.get((y, True), 0) if all_teach else 0)) for y in (0, 1))

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        r = total(lambda x: x.slope(w, share, all_teach))
        free = np.append(w[:-1], 0.0)  # the bias is not drawn to zero
        return float(r[0]) + ridge / 2 * float(free @ free), r[1:] + ridge * free

    w = minimised(f, np.zeros(len(known) + 1), rounds)
    n, nz = total(lambda x: x.spread(w)).reshape(2, -1)
    scale, shift = platt(nz[n > 0] / n[n > 0], (np.flatnonzero(n > 0) >= len(Z_BINS)).astype(float), n[n > 0]) if n.any() and not all_teach else (1.0, 0.0)
    return Model(markov, _UNTAUGHT | {x: float(w[i]) for x, i in known.items()}, float(w[-1]), max(scale, 0.05), shift)


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Scale and shift that calibrate on the part held out."""
    scale, shift = 1.0, 0.0
    share = n / n.sum()
    size = max(1.0, float(share @ np.abs(z)))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -40, 40)))
        scale -= 0.05 * float(share @ ((p - y) * z)) / size
        shift -= 0.5 * float(share @ (p - y))
    return scale, shift


def _numbered(counts: dict[str, int]) -> dict[str, int]:
    """Positions of the features that stand in three labelled candidates or more."""
    return {x: i for i, x in enumerate(sorted(x for x, n in counts.items() if n >= 3))}


def fit(rows: list[tuple[str | None, str]]) -> Model:
    """Train on the weak labels of some files' candidates."""
    markov = Markov(pairs_of(ordinary_words(text for _, text in rows).items()))
    s = sketch(rows, Described(markov))
    known = _numbered(taught_names(s))
    folded = lessons_of(s, known)
    numbers: Counter = Counter()
    for (_, y, h), n in folded.items():
        numbers[y, h] += n
    lessons = Lessons(sorted((*k, n) for k, n in folded.items()))
    return solved(lambda f: f(lessons), known, numbers, markov)


#: Weights of key blocks' frames for samples that hold too few of them.
_UNTAUGHT = {"private=True": 12.0, "private=False": -12.0}


#: So many features of folded lessons are kept on the driver at most.
KEPT = 4_000_000
#: So many entries are folded in a worker before they are given on.
FOLDED = 200_000


def _markov(there: DataFrame) -> Markov:
    """The model of ordinary words, counted over all files."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = ordinary_words(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            seen.update(pairs_of(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pair", "n"])

    counted = there.select("content").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    return Markov(Counter(dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))))


def _sketches(there: DataFrame, markov: Markov) -> DataFrame:
    """(ids, sketch): one row a batch of files, packed; ``ids`` is the batch of their ids (see ``sketch``)."""
    shipped = ship(there.sparkSession, markov)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        described = Described(unpack(shipped))
        for b in batches:
            s = sketch(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True), described)
            kept = sorted({p[0] for p in s[-1]})
            at = {i: k for k, i in enumerate(kept)}
            s = (*s[:-1], [(at[i], *rest) for i, *rest in s[-1]])
            ids = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64()))], ["file_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as w:
                w.write_batch(ids)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([zlib.compress(pickle.dumps(s, 5), 1)], pa.binary())], ["ids", "sketch"])

    return checkpointed(there.select("file_id", "path", "content").mapInArrow(run, "ids binary, sketch binary"))


def _read(packed: bytes) -> tuple:
    return pickle.loads(zlib.decompress(packed))


def _taught(sketches: DataFrame, markov: Markov) -> Model:
    """The model fitted on all sketches."""
    spark = sketches.sparkSession
    packed = sketches.select("sketch")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                seen.update(taught_names(_read(x.as_py())))
                if len(seen) >= FOLDED:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["name", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["name", "n"])

    often = packed.mapInArrow(names, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n >= 3").toArrow()
    known = _numbered(dict(zip(often.column(0).to_pylist(), often.column(1).to_pylist(), strict=True)))
    shipped = ship(spark, known)

    def lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> pa.RecordBatch:
            cols = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [[] for _ in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.bool_(), pa.int64()), strict=True)], ["bag", "label", "held", "n"])

        at, seen = unpack(shipped), Counter()
        for b in batches:
            for x in b.column(0):
                seen.update(lessons_of(_read(x.as_py()), at))
                if len(seen) >= FOLDED:
                    yield given()
                    seen = Counter()
        yield given()

    folded = checkpointed(packed.mapInArrow(lessons, "bag binary, label int, held boolean, n long").groupBy("bag", "label", "held").agg(F.sum("n").alias("n")))
    by = folded.groupBy("label", "held").agg(F.sum("n").alias("n"), F.sum(F.length("bag")).alias("size")).collect()
    numbers = {(r.label, r.held): r.n for r in by}
    if sum(r.size for r in by) <= 4 * KEPT:
        rows = folded.toArrow()
        here = Lessons(sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True)))
        return solved(lambda f: f(here), known, numbers, markov)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = Lessons(list(zip(*(c.to_pylist() for c in b.columns), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(made), 5)], pa.binary())], ["lessons"])

    apart = checkpointed(folded.mapInArrow(arrays, "lessons binary")).coalesce(spark.sparkContext.defaultParallelism)

    def total(f: Callable[[Lessons], np.ndarray]) -> np.ndarray:
        asked = ship(spark, f)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ask, out = unpack(asked), None
            for b in batches:
                for x in b.column(0):
                    part = Lessons.__new__(Lessons)
                    vars(part).update(pickle.loads(x.as_py()))
                    out = ask(part) if out is None else out + ask(part)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

        sums = apart.mapInArrow(run, "sums binary").toArrow().column(0).to_pylist()
        asked.destroy()
        return np.sum([np.frombuffer(x) for x in sums], axis=0)

    return solved(total, known, numbers, markov)


def _filled(files: DataFrame) -> DataFrame:
    return files.select("file_id", "path", "content").where(F.col("content").isNotNull() & (F.col("content") != ""))


def train(files: DataFrame) -> Model:
    """Fit on all files."""
    there = _filled(files)
    markov = _markov(there)
    return _taught(_sketches(there, markov), markov)


_PLAIN = re.compile(r"[a-zA-Z]+(?:[-_. /:,]+[a-zA-Z]+)*[.:,;]?|[\d.,:+-]+")


def ordinary(c: Candidate) -> bool:
    """Whether a literal is plainly none: words or figures that no secret's name, connection or command precedes (see ``weak_label``)."""
    return c.kind == "literal" and _PLAIN.fullmatch(c.value) is not None and not _JUMBLED.search(c.value) and not (set(parts(c.name)) & SECRET_WORDS) and not _CONNECTS.search(c.before)


def found_in(text: str, path: str | None, model: Model, threshold: float = 0.5, described: Described | None = None) -> list[tuple[Candidate, float]]:
    """The secrets of a text with their scores."""
    described, of_path = described or Described(model.markov), path_features(path)
    told = [(c, described.of(c, of_path)) for c in candidates(text, path)]
    get = model.weights.get
    judged = [(c, sum([get(x, 0.0) for x in f])) for c, (plain, _, f) in told if not plain]
    scores = model.scores(np.array([z for _, z in judged], float)).tolist()
    return [(c, s) for (c, _), s in zip(judged, scores, strict=True) if s >= threshold]


_ESCAPE = re.compile(r"\\(?:u[\da-fA-F]{4}|x[\da-fA-F]{2}|.)|[\r\n\"'`+, \t]", re.S)


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with an X for each character of the spans, escapes and line ends kept."""
    out, at = [], 0
    for a, z in sorted(spans):
        if a < at:
            continue
        out.append(text[at:a])
        pos = a
        for m in _ESCAPE.finditer(text, a, z):
            out += ["X" * (m.start() - pos), m.group()]
            pos = m.end()
        out.append("X" * (z - pos))
        at = z
    return "".join(out) + text[at:]


def _judged(sketches: DataFrame, model: Model, threshold: float, kind: str) -> DataFrame:
    shipped = ship(sketches.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = unpack(shipped)
        get = fitted.weights.get
        for batch in batches:
            for ids, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, flat, sizes, _, _, scored, places = _read(packed)
                w = np.array([get(x, 0.0) for x in names], float)
                z = np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[flat], len(sizes))[scored]
                best: dict[tuple[int, int], tuple] = {}
                for (i, line, what, name), s in zip(places, fitted.scores(z).tolist(), strict=True):
                    if s >= threshold and ((i, line) not in best or s > best[i, line][-1]):
                        best[i, line] = (i, line, what, name, s)
                cols = list(zip(*(best[k] for k in sorted(best)), strict=True)) or [[] for _ in range(5)]
                of = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks().take(pa.array(cols[0], pa.int64()))
                types = (pa.int32(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([of, *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], ["file_id", "line_no", "kind", "name", "score"])

    return sketches.mapInArrow(run, f"file_id {kind}, line_no int, kind string, name string, score double")


def secrets(files: DataFrame, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """(file_id, line_no, kind, name, score): one row for each line on which a secret begins.

    Without a model one is fitted on these files, whose candidates are then sought only once.
    """
    there = _filled(files)
    markov = model.markov if model else _markov(there)
    found = _sketches(there, markov)
    return _judged(found, model or _taught(found, markov), threshold, files.schema["file_id"].dataType.simpleString())


def redacted(files: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(file_id, content, n_secrets) of every file, secrets masked."""
    shipped = ship(files.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = unpack(shipped)
        described = Described(fitted.markov)
        for batch in batches:
            texts, counts = [], []
            for path, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = found_in(text, path, fitted, threshold, described) if text else []
                texts.append(mask(text, [s for c, _ in found for s in c.spans]) if found else text)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["file_id", "content", "n_secrets"])

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "path", "content").mapInArrow(run, f"file_id {kind}, content string, n_secrets int")
