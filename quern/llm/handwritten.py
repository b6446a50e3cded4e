"""Files that no one wrote by hand: generated, minified, vendored or data blobs.

Every file with a code extension gets layout statistics, with the insides of string literals and comments
set apart: longest and mean line, shares of white space, letters and digits, and names, density of numeric
literals, longest encoded run, and the share of lines that repeat with nothing but their numbers changed.
Thresholds on them, tuned per language, find minified text, data blobs and generated code without a
header. A leading comment may say of its own file that a tool generated it or that it is third-party.
A copy of third-party code is also known by its code standing, comments and layout aside, in another
repository: files meet on a hash of their code, so only hashes are shuffled.

Defined results
* null, empty and very short contents are hand-written; other extensions are no cases;
* a file scanned twice in one repository is no copy of itself; a null repository takes part in no copy;
* a file that is several things has the first reason of: generated, minified, data, vendored;
* repeated rows are judged row by row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.sources import language
from quern.session import checkpointed


@dataclass(frozen=True)
class Thresholds:
    """When a language's layout is no hand's: all of a group's conditions must hold."""

    minified_line: int = 240  # longest line of code without the insides of strings ...
    minified_space: float = 0.10  # ... and its share of white space at most
    minified_share: float = 0.25  # ... and the share of such lines in the code at least,
    tight_space: float = 0.07  # or white space of all code lines at most ...
    tight_line: float = 45.0  # ... at a mean length of at least ...
    tight_size: int = 300  # ... in so much code at least
    data_names: float = 0.06  # share of names outside literals at most ...
    data_size: int = 250  # ... in a text of at least so many characters ...
    data_literals: float = 0.75  # ... of which literals and their punctuation make up at least ...
    data_words: int = 6  # ... with so many words outside literals at most
    encoded_run: int = 72  # or an encoded run of at least so many characters (lines of a key in text have 64) ...
    encoded_share: float = 0.60  # ... in a text of which such runs make up at least ...
    encoded_alnum: float = 0.70  # ... and letters and digits at least
    dense_numbers: float = 0.75  # or numbers among names and numbers at least ...
    dense_literals: float = 0.75  # ... with literals and their punctuation at least ...
    dense_figures: int = 50  # ... and so many numbers at least
    numbered: float = 0.30  # share of lines that repeat but for their numbers at least ...
    numbered_lines: int = 12  # ... in at least so many lines


#: Fixed values, tuned per language: how dense hand-written code may be.
THRESHOLDS = {
    "python": Thresholds(minified_space=0.06, numbered_lines=9),
    "javascript": Thresholds(),
    "typescript": Thresholds(),
    "java": Thresholds(minified_space=0.08, data_names=0.15, data_words=14, numbered_lines=9),
    "go": Thresholds(minified_space=0.08, data_names=0.10, data_words=10),
}
#: Code shorter than this is too common to show a copy.
COPY_SIZE = 250

_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|^\W*auto-?generated\b|\bcode generated (?:by|from)\b|\bbuilt by [^\n]*edit the\b"
    r"|\bthis (?:file|code|module|class) (?:was|is|has been) (?:(?:automatically|auto-?|machine)[ -]?)?(?:generated|produced|created|emitted|written) (?:by|from)\b"
    r"|\bthis (?:file|code) (?:was|is) (?:automatically|auto)[ -]?(?:generated|produced)\b"
    r"|^\W*(?:automatically )?(?:generated|produced) (?:by|from|with|using)\b|^\W*generated (?:file|code)\b",
    re.I | re.M,
)
_THIRD_PARTY = re.compile(
    r"\bredistribution and use\b|\bpermission is hereby granted\b|\blicen[cs]ed under\b|\bunder the [\w .-]{1,40}licen[cs]e\b|\bsee (?:the )?licen[cs]e\b"
    r"|\(c\) the \S+ contributors\b|^\W*copyright [\d, -]*\S+ project\b|\bspdx-license-identifier\b|^\W*@license\b",
    re.I | re.M,
)
_COMMENTED = {
    "python": re.compile(r"(?P<string>[A-Za-z]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))|(?P<comment>#[^\n]*)"),
    "c": re.compile(r"(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`?)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"),
}
_HEAD = {
    "python": re.compile(r"\A(?:\s*(?:#[^\n]*|[rR]?\"\"\"[\s\S]*?\"\"\"))*"),
    "c": re.compile(r"\A(?:\s*(?://[^\n]*|/\*[\s\S]*?\*/|#![^\n]*))*"),
}
#: A text that begins so is JSON under a wrong extension, which is no reason by itself.
_JSON = re.compile(r"\s*[{\[]")
_NAME = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?)")
_DIGITS = re.compile(r"\d+")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_GAPS = re.compile(r"\s+")


@dataclass
class Layout:
    """Statistics of one text."""

    max_line: int
    mean_line: float
    space: float
    alnum: float
    numbers: float
    encoded: int
    encoded_share: float
    figures: int
    names: float
    words: int
    literals: float
    minified: float
    tight: bool
    numbered: float
    lines: int
    head: str
    code: str


def layout(text: str, lang: str, limits: Thresholds) -> Layout:
    """The statistics the thresholds stand on."""
    text = text.replace("\r", "")
    family = "python" if lang == "python" else "c"
    n = max(1, len(text))
    head = _HEAD[family].match(text).group()
    literal = 0
    encoded = 0
    in_runs = 0

    def strip(m: re.Match) -> str:
        nonlocal literal, encoded, in_runs
        if m.lastgroup == "comment":
            return ""
        s = m.group()
        literal += len(s)
        for run in _ENCODED.findall(s):
            encoded = max(encoded, len(run))
            in_runs += len(run)
        return '""'

    bare = _COMMENTED[family].sub(strip, text)
    lines = [x for x in map(str.strip, bare.split("\n")) if x]
    code = "".join(_GAPS.sub("", bare).split('""'))
    names = _NAME.findall(bare)
    figures = _NUMBER.findall(bare)
    solid = max(1, len(code) + literal)
    dense = sum(len(x) for x in lines if len(x) >= limits.minified_line and len(_GAPS.findall(x)) / len(x) <= limits.minified_space and len(_NAME.findall(x)) * 12 >= len(x))
    joined = "".join(lines)
    tight = len(joined) >= limits.tight_size and len(joined) >= limits.tight_line * len(lines) and len(_GAPS.findall(joined)) <= limits.tight_space * len(joined) and 12 * len(names) >= len(joined)
    forms: dict[str, set[str]] = {}
    count: dict[str, int] = {}
    for x in lines:
        k = _DIGITS.sub("0", x)
        forms.setdefault(k, set()).add(x)
        count[k] = count.get(k, 0) + 1
    numbered = sum(count[k] for k, v in forms.items() if len(v) >= 3 and any(c.isalpha() for c in k))
    return Layout(
        max_line=max(map(len, text.split("\n"))),
        mean_line=n / (text.count("\n") + 1),
        space=sum(map(text.count, " \t\n")) / n,
        alnum=len(re.findall(r"[^\W_]", text)) / n,
        numbers=len(figures) / max(1, len(figures) + len(names)),
        encoded=encoded,
        encoded_share=in_runs / solid,
        figures=len(figures),
        names=sum(map(len, names)) / solid,
        words=len(names),
        literals=(literal + sum(map(len, figures)) + sum(map(bare.count, "[]{},:;()=-"))) / solid,
        minified=dense / max(1, len(joined)),
        tight=tight,
        numbered=numbered / max(1, len(lines)),
        lines=len(lines),
        head=head,
        code=code,
    )


def reason(text: str, lang: str, s: Layout, limits: Thresholds) -> str | None:
    """Why a text is not hand-written, as far as it shows itself."""
    if _GENERATED.search(s.head):
        return "generated"
    if s.minified >= limits.minified_share or s.tight:
        return "minified"
    plain = s.names <= limits.data_names and s.words <= limits.data_words and s.literals >= limits.data_literals
    coded = s.encoded >= limits.encoded_run and s.encoded_share >= limits.encoded_share and s.alnum >= limits.encoded_alnum
    dense = s.numbers >= limits.dense_numbers and s.literals >= limits.dense_literals and s.figures >= limits.dense_figures
    if len(text) >= limits.data_size and not _JSON.match(text) and (plain or coded or dense):
        return "data"
    if s.lines >= limits.numbered_lines and s.numbered >= limits.numbered:
        return "generated"
    return "vendored" if _THIRD_PARTY.search(s.head) else None


_STATS = ("max_line", "mean_line", "space", "alnum", "numbers", "encoded", "names", "numbered")
_SCHEMA = "reason string, code_hash binary, max_line int, mean_line double, space double, alnum double, numbers double, encoded int, names double, numbered double"


def described(files: DataFrame) -> DataFrame:
    """(file_id, repository, path, reason, code_hash, statistics) of every file with a code extension and a content."""
    code = files.select("file_id", "repository", "path", language(F.col("path")).alias("_lang"), "content").where(F.col("_lang").isNotNull() & (F.col("content") != ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                s = layout(text, lang, THRESHOLDS[lang])
                digest = blake2b(s.code.encode("utf-8", "replace"), digest_size=16).digest() if len(s.code) >= COPY_SIZE else None
                rows.append((reason(text, lang, s, THRESHOLDS[lang]), digest, *(getattr(s, x) for x in _STATS)))
            types = [pa.string(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["file_id", "repository", "path", "reason", "code_hash", *_STATS]
            )

    kind = files.schema["file_id"].dataType.simpleString()
    return code.mapInArrow(run, f"file_id {kind}, repository string, path string, {_SCHEMA}")


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, repository, path, reason) and statistics of every file that no one wrote by hand there.

    The descriptions, small rows, go through the checkpoint folder, so texts are read and described once.
    Hashes are folded per code before the shuffle (least and greatest repository), and only codes that
    stand in two repositories are joined back, so a code that a third of all files share stays one row.
    """
    all_files = checkpointed(described(files))
    copied = (
        all_files.where(F.col("code_hash").isNotNull() & F.col("repository").isNotNull())
        .groupBy("code_hash")
        .agg(F.min("repository").alias("_a"), F.max("repository").alias("_z"))
        .where(F.col("_a") != F.col("_z"))
        .select("code_hash", F.lit("vendored").alias("_copied"))
    )
    return (
        all_files.join(copied, "code_hash", "left")
        .withColumn("reason", F.coalesce("reason", F.when(F.col("repository").isNotNull(), F.col("_copied"))))
        .where(F.col("reason").isNotNull())
        .select("file_id", "repository", "path", "reason", *_STATS)
    )
