"""Source files that do not parse in the language of their extension.

A lexer of the language with a pushdown stack finds unterminated literals, unbalanced delimiters,
premature ends and merge-conflict markers; a parser over its tokens finds what else cannot stand where
it does (misspelt keywords, another language's text). JSON is decided by its lexer and a pushdown automaton of
its whole grammar. Python texts that pass the lexer and stack meet the grammar of the interpreter that runs
the workers, so which version's syntax counts is that of the cluster's Python.

Defined results
* null contents and other extensions are no cases; empty and blank code files are valid, an empty JSON
  text is not (a JSON text holds one value);
* conflict markers inside comments, strings and templates are text;
* Python text nested deeper than its own parser goes is judged by the lexer and stack alone;
* repeated rows are judged row by row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.syntax.lexing import CONFLICT, Broken
from quern.llm.parsing import check
from quern.llm.sources import clean_path, extension, language

#: Python as far as the stack needs it: literals, comments, delimiters, line ends, and stretches of anything else.
_PYTHON = re.compile(
    r"(?P<plain>[^\"'#()\[\]{}\\\n]+)|(?P<nl>\n)|(?P<comment>#[^\n]*)|(?P<join>\\\r?\n)"
    r"|(?P<triple>\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*\"\"\"|\'\'\'(?:\\[\s\S]|(?!\'\'\')[^\\])*\'\'\')"
    r"|(?P<string>\"(?!\"\")(?:\\[\s\S]|[^\"\\\n])*\"|'(?!'')(?:\\[\s\S]|[^'\\\n])*'|\"\"(?!\")|''(?!'))"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<quote>[\"'])|(?P<other>.)"
)
#: The tokens of strict JSON (RFC 8259).
_JSON = re.compile(
    r"(?P<space>[ \t\r\n]+)|(?P<value>\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|(?:true|false|null)(?!\w))|(?P<open>[\[{])|(?P<close>[\]}])|(?P<mark>[,:])"
)
_PAIR = {"(": ")", "[": "]", "{": "}"}


def _scan(text: str) -> None:
    """The lexer and delimiter stack of Python texts."""
    stack: list[tuple[str, int]] = []
    line, pos, match, n = 1, 0, _PYTHON.match, len(text)
    conflict = CONFLICT.search(text) is not None
    while pos < n:
        if conflict and (pos == 0 or text[pos - 1] == "\n") and text[pos] in "<>|=" and CONFLICT.match(text, pos):
            raise Broken("conflict_marker", line, text[pos : pos + 40].split("\n")[0])
        m = match(text, pos)
        kind, pos = m.lastgroup, m.end()
        if kind == "nl":
            line += 1
        elif kind == "triple" or kind == "join":
            line += m.group().count("\n")
        elif kind == "quote":
            raise Broken("unterminated_literal", line, "string")
        elif kind == "open":
            stack.append((m.group(), line))
        elif kind == "close":
            value = m.group()
            if not stack:
                raise Broken("unbalanced_delimiter", line, f"{value!r} closes nothing")
            opened, at = stack.pop()
            if _PAIR[opened] != value:
                raise Broken("unbalanced_delimiter", line, f"{value!r} does not match {opened!r} of line {at}")
        elif kind == "string":
            line += m.group().count("\n")
    if stack:
        raise Broken("premature_end", line, f"{stack[-1][0]!r} of line {stack[-1][1]} stays open")


#: The pushdown automaton of JSON: what may come where (value, key, colon, comma or end of the innermost container).
_VALUE, _KEY, _COLON, _MORE = "value", "key", "':'", "',' or an end"


def _json(text: str) -> None:
    """The whole grammar of JSON: tokens and a stack of open containers; a text holds one value."""
    stack: list[tuple[str, int]] = []
    want, fresh = _VALUE, False  # fresh: right behind an opening sign, where its closing one may stand
    pos, n, match = 0, len(text), _JSON.match
    line_at = lambda p: text.count("\n", 0, p) + 1
    while pos < n:
        m = match(text, pos)
        if m is None:
            if text[pos] in "<>|=" and (pos == 0 or text[pos - 1] == "\n") and CONFLICT.match(text, pos):
                raise Broken("conflict_marker", line_at(pos), text[pos : pos + 40].split("\n")[0])
            if text[pos] == '"':
                raise Broken("unterminated_literal", line_at(pos), "string")
            raise Broken("bad_token", line_at(pos), text[pos : pos + 20].split("\n")[0])
        kind = m.lastgroup
        if kind == "space":
            pos = m.end()
            continue
        value = m.group()
        if kind == "close":
            if not stack:
                raise Broken("unbalanced_delimiter", line_at(pos), f"{value!r} closes nothing")
            opened, at = stack.pop()
            if _PAIR[opened] != value:
                raise Broken("unbalanced_delimiter", line_at(pos), f"{value!r} does not match {opened!r} of line {line_at(at)}")
            if not (fresh or want == _MORE):
                raise Broken("unexpected_token", line_at(pos), f"{value!r} where {want} is due")
            want, fresh = _MORE, False
        elif want == _MORE:
            if value != "," or not stack:
                raise Broken("unexpected_token", line_at(pos), f"{value[:20]!r} behind a whole value" if not stack else f"{value[:20]!r} where {want} is due")
            want, fresh = (_KEY if stack[-1][0] == "{" else _VALUE), False
        elif want == _COLON:
            if value != ":":
                raise Broken("unexpected_token", line_at(pos), f"{value[:20]!r} where {want} is due")
            want = _VALUE
        elif want == _KEY:
            if kind != "value" or value[0] != '"':
                raise Broken("unexpected_token", line_at(pos), f"{value[:20]!r} where a {want} is due")
            want, fresh = _COLON, False
        elif kind == "open":
            stack.append((value, pos))
            want, fresh = (_KEY if value == "{" else _VALUE), True
        elif kind == "value":
            want, fresh = _MORE, False
        else:
            raise Broken("unexpected_token", line_at(pos), f"{value!r} where a {want} is due")
        pos = m.end()
    if stack or want != _MORE:
        raise Broken("premature_end", line_at(n), f"{stack[-1][0]!r} of line {line_at(stack[-1][1])} stays open" if stack else "no value")


def _python(text: str) -> None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except SyntaxError as e:
        message = e.msg or "invalid syntax"
        early = e.lineno is not None and e.lineno > text.rstrip().count("\n")
        due = message.startswith("expected") and early
        raise Broken("premature_end" if due else "unexpected_token", e.lineno or 1, message) from None
    except ValueError as e:
        raise Broken("bad_token", 1, str(e)) from None


_FSTRING = re.compile(r"\b(?:[fF][rR]?|[rR][fF])[\"']")


def _parsed(text: str, language: str) -> None:
    """The lexer, stack and parser of a language; a text nested too deeply for the usual recursion gets as much as its length may need."""
    try:
        check(text, language)
    except RecursionError:
        usual = sys.getrecursionlimit()
        sys.setrecursionlimit(usual + 60 * len(text))
        try:
            check(text, language)
        finally:
            sys.setrecursionlimit(usual)


def fault(text: str, kind: str) -> tuple[str, int, str] | None:
    """(kind, line, message) of what makes a text invalid in a language, None if it is valid."""
    found: Broken | None = None
    try:
        if kind == "json":
            _json(text)
        elif kind == "python":
            if text.strip():
                _python_text(text)
        elif text.strip():
            _parsed(text, {"javascript": "js", "typescript": "ts"}.get(kind, kind))
    except Broken as e:
        found = e
    return (found.kind, found.line, found.message[:200]) if found else None


def _python_text(text: str) -> None:
    """What the lexer and stack find decides; what passes them, and quotes nested in f-strings, goes to the parser."""
    hint: Broken | None = None
    try:
        _scan(text)
    except Broken as e:
        if not _FSTRING.search(text):
            raise
        hint = e
    try:
        _python(text)
    except Broken as e:
        raise hint or e from None
    except (RecursionError, MemoryError):
        if hint:
            raise hint from None


def broken_files(files: DataFrame) -> DataFrame:
    """(file_id, repository, path, language, error_type, line_no, message) of every file that does not parse."""
    claimed = files.select(
        "file_id", "repository", "path", F.when(extension(F.col("path")) == ".json", "json").otherwise(language(F.col("path"))).alias("language"), "content"
    ).where(F.col("language").isNotNull() & F.col("content").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            found = [(i, f) for i, (lang, t) in enumerate(zip(langs, texts, strict=True)) if (f := fault(t, lang))]
            kept = batch.take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns[:4], pa.array([f[0] for _, f in found], pa.string()), pa.array([f[1] for _, f in found], pa.int32()), pa.array([f[2] for _, f in found], pa.string())],
                ["file_id", "repository", "path", "language", "error_type", "line_no", "message"],
            )

    kind = files.schema["file_id"].dataType.simpleString()
    return claimed.mapInArrow(run, f"file_id {kind}, repository string, path string, language string, error_type string, line_no int, message string")


def broken_rates(files: DataFrame) -> DataFrame:
    """(repository, language, n_files, n_broken, rate) over all files with a content in a known language."""
    lang = F.when(extension(F.col("path")) == ".json", "json").otherwise(language(F.col("path")))
    totals = (
        files.select("repository", lang.alias("language"), F.col("content").isNotNull().alias("there"))
        .where(F.col("language").isNotNull() & F.col("there"))
        .groupBy("repository", "language")
        .agg(F.count(F.lit(1)).alias("n_files"))
    )
    broken = broken_files(files).groupBy("repository", "language").agg(F.count(F.lit(1)).alias("n_broken"))
    same = totals["repository"].eqNullSafe(broken["repository"]) & (totals["language"] == broken["language"])
    n = F.coalesce("n_broken", F.lit(0))
    return totals.join(broken, same, "left").select(
        totals["repository"], totals["language"], "n_files", n.alias("n_broken"), (n / F.col("n_files")).alias("rate")
    )


def log_agreement(files: DataFrame, errors: DataFrame) -> DataFrame:
    """(state, n_files): how the ingestion log and the check agree on files, by repository and cleaned path.

    Only log entries about a file's own text count (``extraction_error``, ``file_error``); an entry without a
    path finds its file through ``node_id``.
    """
    node = F.regexp_extract("node_id", r"^File:[^:]*:(.*)$", 1)
    logged = (
        errors.where(F.col("error_type").isin("extraction_error", "file_error"))
        .select("repository", clean_path(F.coalesce("file_path", F.when(node != "", node))).alias("_path"))
        .where(F.col("_path").isNotNull())
        .distinct()
        .withColumn("_logged", F.lit(True))
    )
    broken = broken_files(files).select("repository", clean_path(F.col("path")).alias("_path")).distinct().withColumn("_broken", F.lit(True))
    state = F.when(F.col("_logged") & F.col("_broken"), "logged and broken").when(F.col("_broken"), "broken, not logged").otherwise("logged, not broken")
    return broken.join(logged, ["repository", "_path"], "full").select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n_files"))
