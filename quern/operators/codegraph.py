"""Code parsing and the code graph: entities with their metadata, imports, exports, calls, nodes and edges.

Python is parsed with its own grammar; JavaScript, TypeScript, Java and Go are read from the tokens of their
lexers (``codetokens``); the other languages, and files whose lexer fails, by line patterns over text whose
comments and strings are blanked out. A file is parsed once, in Arrow batches, into one row of arrays;
resolving imports, calls and base types to nodes is a set of joins over such rows.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graph as G
from quern.operators.codetokens import Entity, Reader
from quern.session import checkpointed
from quern.syntax.lexing import Broken

#: Files above this size are not parsed.
MAX_SIZE = 1 << 20


@dataclass
class Code:
    """What a file declares and uses; lines count from 1."""

    entities: list[Entity] = field(default_factory=list)
    imports: list[tuple[str, str, str, bool, bool, int]] = field(default_factory=list)  # source, name, alias, type only, side effect, line
    exports: list[tuple[str, str, int]] = field(default_factory=list)  # name, source of a re-export, line
    calls: list[tuple[str, str, str, bool, int]] = field(default_factory=list)  # name, expression, caller, awaited, line
    error: str | None = None


_BLANK = {
    "c": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`?"),
    "hash": re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'"),
}
_N = r"([A-Za-z_$][\w$]*)"
#: Per language the declarations' patterns (kind, pattern, whether its match exports the name).
_DECLARED: dict[str, list[tuple[str, re.Pattern]]] = {
    "javascript": [
        ("function", re.compile(rf"^[ \t]*(?P<x>export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*{_N}\s*(?:<[^>]*>)?\(", re.M)),
        ("class", re.compile(rf"^[ \t]*(?P<x>export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+{_N}", re.M)),
        ("interface", re.compile(rf"^[ \t]*(?P<x>export\s+)?interface\s+{_N}", re.M)),
        ("type_alias", re.compile(rf"^[ \t]*(?P<x>export\s+)?type\s+{_N}\s*(?:<[^=]*>)?=", re.M)),
        ("enum", re.compile(rf"^[ \t]*(?P<x>export\s+)?(?:const\s+)?enum\s+{_N}", re.M)),
        ("function", re.compile(rf"^[ \t]*(?P<x>export\s+)?(?:const|let|var)\s+{_N}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=\n]+)?=>", re.M)),
        ("variable", re.compile(rf"^(?P<x>export\s+)?(?:const|let|var)\s+{_N}\b(?!\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=\n]+)?=>)", re.M)),
        ("method", re.compile(rf"^[ \t]+(?P<x>)(?:(?:public|private|protected|static|readonly|async|override|get|set)\s+)*\*?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|constructor\b)#?{_N}\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?::\s*[^{{;=]+)?\{{", re.M)),
    ],
    "java": [
        ("class", re.compile(rf"^[ \t]*(?P<x>public\s+)?(?:(?:private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+{_N}", re.M)),
        ("interface", re.compile(rf"^[ \t]*(?P<x>public\s+)?(?:(?:private|protected|static|abstract)\s+)*@?interface\s+{_N}", re.M)),
        ("enum", re.compile(rf"^[ \t]*(?P<x>public\s+)?(?:(?:private|protected|static)\s+)*enum\s+{_N}", re.M)),
        ("method", re.compile(rf"^[ \t]+(?P<x>public\s+)?(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?!return\b|new\b|else\b|throw\b)(?:<[^>]+>\s+)?[\w$][\w$.<>\[\], ?]*[\w$>\]]\s+{_N}\s*\([^;{{}}]*\)\s*(?:throws [\w., ]+)?[{{;]", re.M)),
        ("property", re.compile(rf"^[ \t]+(?P<x>public\s+)?(?:(?:public|private|protected|static|final|volatile|transient)\s+)+[\w$][\w$.<>\[\], ?]*\s+{_N}\s*(?:=|;)", re.M)),
    ],
    "go": [
        ("method", re.compile(rf"^func\s+\([^)]*\)\s*(?P<x>){_N}\s*\(", re.M)),
        ("function", re.compile(rf"^func\s+(?P<x>){_N}\s*[\[(]", re.M)),
        ("interface", re.compile(rf"^type\s+(?P<x>){_N}(?:\[[^\]]*\])?\s+interface\b", re.M)),
        ("class", re.compile(rf"^type\s+(?P<x>){_N}(?:\[[^\]]*\])?\s+struct\b", re.M)),
        ("type_alias", re.compile(rf"^type\s+(?P<x>){_N}\s+(?!interface\b|struct\b)[\w*\[\]=.(]", re.M)),
        ("variable", re.compile(rf"^(?:var|const)\s+(?P<x>){_N}\b", re.M)),
    ],
    "rust": [
        ("function", re.compile(rf"^[ \t]*(?P<x>pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern)\s+)*fn\s+{_N}", re.M)),
        ("class", re.compile(rf"^[ \t]*(?P<x>pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+{_N}", re.M)),
        ("enum", re.compile(rf"^[ \t]*(?P<x>pub(?:\([^)]*\))?\s+)?enum\s+{_N}", re.M)),
        ("interface", re.compile(rf"^[ \t]*(?P<x>pub(?:\([^)]*\))?\s+)?trait\s+{_N}", re.M)),
    ],
    "c": [
        ("function", re.compile(rf"^(?P<x>)[A-Za-z_][\w \t*:<>,&]*?[\s*&]{_N}\s*\([^;{{}}]*\)\s*(?:const\s*)?\{{", re.M)),
        ("class", re.compile(rf"^[ \t]*(?P<x>)(?:typedef\s+)?(?:struct|class|union)\s+{_N}[^;{{]*\{{", re.M)),
        ("enum", re.compile(rf"^[ \t]*(?P<x>)(?:typedef\s+)?enum\s+(?:class\s+)?{_N}", re.M)),
    ],
    "csharp": [
        ("class", re.compile(rf"^[ \t]*(?P<x>public\s+)?(?:(?:internal|private|protected|static|sealed|abstract|partial)\s+)*(?:class|struct|record)\s+{_N}", re.M)),
        ("interface", re.compile(rf"^[ \t]*(?P<x>public\s+)?(?:(?:internal|private|protected|partial)\s+)*interface\s+{_N}", re.M)),
        ("enum", re.compile(rf"^[ \t]*(?P<x>public\s+)?(?:(?:internal|private|protected)\s+)*enum\s+{_N}", re.M)),
        ("method", re.compile(rf"^[ \t]+(?P<x>public\s+)?(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed)\s+)+[\w<>\[\],.? ]+\s+{_N}\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?:=>|\{{|;)?", re.M)),
    ],
    "ruby": [
        ("function", re.compile(r"^[ \t]*(?P<x>)def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", re.M)),
        ("class", re.compile(r"^[ \t]*(?P<x>)(?:class|module)\s+([A-Z]\w*)", re.M)),
    ],
    "php": [
        ("function", re.compile(rf"^[ \t]*(?P<x>)(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?{_N}", re.M)),
        ("class", re.compile(rf"^[ \t]*(?P<x>)(?:(?:final|abstract|readonly)\s+)*(?:class|trait)\s+{_N}", re.M)),
        ("interface", re.compile(rf"^[ \t]*(?P<x>)interface\s+{_N}", re.M)),
    ],
}
for _a, _b in (("typescript", "javascript"), ("tsx", "javascript"), ("jsx", "javascript"), ("cpp", "c")):
    _DECLARED[_a] = _DECLARED[_b]

_SCRIPT_IMPORT = re.compile(r"^[ \t]*import\s+(?:type\s+)?(?:[\w$*{}\s,]+?\s+from\s+)?[\"']([^\"'\n]+)[\"']", re.M)
_LINE_IMPORT = {
    "java": re.compile(r"^[ \t]*import\s+(?:static\s+)?(?P<source>[\w.]+(?:\.\*)?)\s*;", re.M),
    "csharp": re.compile(r"^[ \t]*using\s+(?:static\s+)?(?P<source>[\w.]+)\s*;", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub\s+)?use\s+(?P<source>[\w:]+)", re.M),
    "php": re.compile(r"^[ \t]*use\s+(?P<source>[\w\\]+)", re.M),
    "c": re.compile(r"^[ \t]*#\s*include\s*[<\"](?P<source>[^>\"\n]+)[>\"]", re.M),
    "ruby": re.compile(r"^[ \t]*require(?:_relative)?\s*\(?[\"'](?P<source>[^\"'\n]+)[\"']", re.M),
}
_LINE_IMPORT["cpp"] = _LINE_IMPORT["c"]
_CALL = re.compile(r"(?P<await>\bawait\s+)?(?P<expr>[A-Za-z_$][\w$]*(?:\s*(?:\?\.|\.|::|->)\s*[A-Za-z_$][\w$]*)*)\s*(?:<[\w$, .\[\]]*>)?\(")
_NO_CALL = frozenset("if for while switch catch return function new typeof sizeof await throw else do case in of and or not elif def class func fn match loop foreach using lock super this import require constructor synchronized".split())


def _blank(text: str, family: str) -> str:
    """Comments and strings as blanks of the same length, quotes and line ends kept."""
    return _BLANK[family].sub(lambda m: re.sub(r"[^\n\"'`]", " ", m.group()) if m.group()[0] in "\"'`" else re.sub(r"[^\n]", " ", m.group()), text)


def _block_end(text: str, start: int) -> int:
    """Offset behind the brace that closes the first one after ``start``; the line's end if there is none."""
    open_at = text.find("{", start)
    line_end = text.find("\n", start)
    line_end = len(text) if line_end < 0 else line_end
    semicolon = text.find(";", start)
    if open_at < 0 or (0 <= semicolon < open_at and semicolon <= line_end):
        return line_end
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, open_at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def parse_tokens(text: str, lang: str) -> Code:
    """Entities, imports, exports and calls of a file in a language that has a lexer here; ``Broken`` if it fails."""
    r = Reader(text, lang)
    r.read()
    return Code(sorted(r.entities, key=lambda e: (e.start, e.name)), r.imports(), r.exports(), r.calls())


def parse_other(text: str, lang: str) -> Code:
    """The same by patterns, for languages without a lexer and for texts that are broken."""
    out = Code()
    clean = _blank(text, "hash" if lang in ("ruby",) else "c")
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect_right(starts, at)
    seen: set[tuple[str, int]] = set()
    spans: list[tuple[int, int, str]] = []
    for kind, pattern in _DECLARED.get(lang, ()):
        for m in pattern.finditer(clean):
            name = m.group(m.lastindex)
            at = m.start(m.lastindex)
            line = line_of(at)
            if (name, line) in seen or name in _NO_CALL:
                continue
            seen.add((name, line))
            end = _block_end(clean, at)
            exported = bool(m.group("x")) if lang in ("javascript", "typescript", "tsx", "jsx", "java", "csharp", "rust") else name[:1].isupper() if lang == "go" else True
            signature = text[m.start() : text.find("\n", at) if text.find("\n", at) > 0 else len(text)].strip().rstrip("{").strip()
            out.entities.append(Entity(kind, name, line, line_of(max(at, end - 1)), exported, signature))
            if kind in ("function", "method"):
                spans.append((at, end, name))
    if lang in ("javascript", "typescript", "tsx", "jsx"):
        out.imports = [(m.group(1), "", "", False, False, line_of(m.start())) for m in _SCRIPT_IMPORT.finditer(text)]
    elif lang in _LINE_IMPORT:
        for m in _LINE_IMPORT[lang].finditer(text):
            source = m.group("source")
            out.imports.append((source, re.split(r"[./\\:]+", source)[-1], "", False, False, line_of(m.start())))
    declared_at = {(e.name, e.start) for e in out.entities}
    open_spans: list[tuple[int, str]] = []
    rest = sorted(spans, reverse=True)
    for m in _CALL.finditer(clean):
        expr = re.sub(r"\s+", "", m.group("expr"))
        name = re.split(r"\?\.|\.|::|->", expr)[-1]
        line = line_of(m.start("expr"))
        while rest and rest[-1][0] <= m.start():
            a, z, owner = rest.pop()
            open_spans.append((z, owner))
        while open_spans and open_spans[-1][0] <= m.start():
            open_spans.pop()
        if name in _NO_CALL or (name, line) in declared_at:
            continue
        out.calls.append((name, expr, open_spans[-1][1] if open_spans else "", bool(m.group("await")), line))
    return out


def _python_parameters(args: ast.arguments) -> list[tuple[str, str]]:
    plain = [*args.posonlyargs, *args.args]
    out = [(a.arg, a.annotation) for a in plain]
    out += [("*" + args.vararg.arg, args.vararg.annotation)] if args.vararg else []
    out += [(a.arg, a.annotation) for a in args.kwonlyargs]
    out += [("**" + args.kwarg.arg, args.kwarg.annotation)] if args.kwarg else []
    return [(n, ast.unparse(t) if t else "") for n, t in out]


def parse_python(text: str) -> Code:
    """Entities, imports and calls of a Python file."""
    out = Code()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        out.error = str(e)[:200]
        return out

    def walk(node: ast.AST, owner: str, in_class: str) -> None:
        for child in ast.iter_child_nodes(node):
            inside, cls = owner, in_class
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                args = ", ".join(a.arg for a in (*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs))
                word = "async def" if isinstance(child, ast.AsyncFunctionDef) else "def"
                marks = [ast.unparse(d) for d in child.decorator_list]
                flags = ["async"] * (word != "def") + ["static"] * ("staticmethod" in marks) + ["abstract"] * any(m.endswith("abstractmethod") for m in marks)
                flags += ["generator"] * any(isinstance(x, ast.Yield | ast.YieldFrom) for x in ast.walk(child))
                out.entities.append(
                    Entity("method" if in_class else "function", child.name, child.lineno, child.end_lineno or child.lineno, not child.name.startswith("_"), f"{word} {child.name}({args})", in_class, _python_parameters(child.args), ast.unparse(child.returns) if child.returns else "", flags, doc=" ".join((ast.get_docstring(child) or "").split()))
                )
                inside, cls = child.name, ""
            elif isinstance(child, ast.ClassDef):
                out.entities.append(Entity("class", child.name, child.lineno, child.end_lineno or child.lineno, not child.name.startswith("_"), f"class {child.name}", extends=[ast.unparse(b) for b in child.bases], doc=" ".join((ast.get_docstring(child) or "").split())))
                cls = child.name
            elif isinstance(child, ast.Assign) and isinstance(node, ast.Module):
                for t in child.targets:
                    if isinstance(t, ast.Name):
                        out.entities.append(Entity("variable", t.id, child.lineno, child.end_lineno or child.lineno, not t.id.startswith("_"), t.id))
            elif isinstance(child, ast.Import):
                out.imports += [(a.name, a.name.rsplit(".", 1)[-1], a.asname or "", False, False, child.lineno) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                source = "." * child.level + (child.module or "")
                out.imports += [(source, a.name, a.asname or "", False, False, child.lineno) for a in child.names]
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else "[chained]" if isinstance(f, ast.Call) else "[dynamic]"
                out.calls.append((name, ast.unparse(f), owner, isinstance(node, ast.Await), child.lineno))
            walk(child, inside, cls)

    walk(tree, "", "")
    return out


def parse(text: str | None, lang: str) -> Code:
    """A file's code; oversized, unknown and unparsable files give an error and what could be read."""
    if text is None:
        return Code(error="no content")
    if len(text) > MAX_SIZE:
        return Code(error="file exceeded the size limit")
    if lang == "python":
        return parse_python(text)
    if lang in _TOKENS:
        try:
            return parse_tokens(text, lang)
        except Broken as e:  # what can be read is kept, as is the error
            out = parse_other(text, lang)
            out.error = str(e)[:200]
            return out
    return parse_other(text, lang) if lang in _DECLARED else Code(error="unknown language")


_TOKENS = frozenset("javascript typescript jsx java go".split())


_PARTS = {
    "entities": "kind string, name string, start_line int, end_line int, exported boolean, signature string, owner string, parameters array<struct<name:string,type:string>>, returns string, flags array<string>, extends array<string>, implements array<string>, generics array<string>, doc string",
    "imports": "source string, name string, alias string, type_only boolean, side_effect boolean, line int",
    "exports": "name string, source string, line int",
    "calls": "name string, expression string, caller string, awaited boolean, line int",
}
_TEXTS = pa.list_(pa.string())
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": _TEXTS, "array<struct<name:string,type:string>>": pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))}


def _rows(code: Code, part: str) -> list[tuple]:
    if part != "entities":
        return getattr(code, part)
    return [(e.kind, e.name, e.start, e.end, e.exported, e.signature, e.owner, [{"name": n, "type": t} for n, t in e.parameters], e.returns, e.flags, e.extends, e.implements, e.generics, e.doc) for e in code.entities]


def parse_files(files: DataFrame, *parts: str) -> DataFrame:
    """(repository, path, language, content_key, error, parts): one row a file in a known language, each part an array of structs; one parse a file."""
    schemas = {p: [f.strip().rsplit(" ", 1) for f in _PARTS[p].split(", ")] for p in parts}
    names = ["repository", "path", "language", "content_key", "error", *parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [parse(t, lang) for lang, t in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)]
            cols = []
            for p, fields in schemas.items():
                flat = [_rows(c, p) for c in codes]
                offsets = [0, *accumulate(map(len, flat))]
                values = list(zip(*chain.from_iterable(flat), strict=True)) or [[] for _ in fields]
                struct = pa.StructArray.from_arrays([pa.array(v, _KINDS[t]) for v, (_, t) in zip(values, fields, strict=True)], [n for n, _ in fields])
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([c.error for c in codes], pa.string()), *cols], names)

    known = files.select("repository", T.posix(F.col("path")).alias("path"), T.detect_language(F.col("path")).alias("language"), F.xxhash64("content").alias("content_key"), "content").where(F.col("language") != "unknown")
    arrays = "".join(f", {p} array<struct<{','.join(f'{n}:{t}' for n, t in f)}>>" for p, f in schemas.items())
    return known.mapInArrow(run, f"repository string, path string, language string, content_key long, error string{arrays}")


def parsed(files: DataFrame, part: str) -> DataFrame:
    """One kind of findings of all files (repository, path, content): entities, metadata, imports, exports, calls or errors."""
    if part == "errors":
        return parse_files(files).where("error is not null").select("repository", "path", "language", "error")
    found = explode_part(parse_files(files, "entities" if part == "metadata" else part), "entities" if part == "metadata" else part)
    basic = ("kind", "name", "start_line", "end_line", "exported", "signature")
    if part == "entities":
        return found.select("repository", "path", "language", *basic)
    return found


def explode_part(rows: DataFrame, part: str) -> DataFrame:
    return rows.select("repository", "path", "language", F.explode(part).alias("_p")).select("repository", "path", "language", "_p.*")


def filter_entities(entities: DataFrame, kinds: Sequence[str] = (), exported_only: bool = False) -> DataFrame:
    """Entities of some kinds (all if none is given), exported ones only if asked for."""
    keep = F.col("kind").isin(*kinds) if kinds else F.lit(True)
    return entities.where(keep & F.col("exported") if exported_only else keep)


def filter_exports(exports: DataFrame, re_exports: bool = True) -> DataFrame:
    """Exports without those that pass on another module's, if these are switched off."""
    return exports if re_exports else exports.where(F.coalesce("source", F.lit("")) == "")


def filter_imports(imports: DataFrame, external: bool = True, type_only: bool = True, side_effect: bool = True) -> DataFrame:
    """Imports without those kinds that are switched off."""
    keep = F.lit(True)
    if not external:
        keep &= ~T.is_external_package(F.col("source"))
    if not type_only:
        keep &= ~F.col("type_only")
    if not side_effect:
        keep &= ~F.col("side_effect")
    return imports.where(keep)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with ``target_path`` for relative ones that lead to a file of the repository, by trying extensions."""
    bare = F.regexp_replace("source", r"\.(?:js|mjs|jsx|ts|mts|tsx)$", "")
    dotted = F.concat(F.when(F.col("source").startswith(".."), "../").otherwise("./"), F.regexp_replace(F.regexp_replace("source", r"^\.+", ""), r"\.", "/"))
    wanted = T.resolve_relative(F.col("path"), F.when(F.col("language") == "python", dotted).otherwise(bare))
    keyed = imports.withColumn("_stem", F.when(F.col("source").startswith("."), F.concat_ws("\u0001", "repository", wanted)))
    stem = F.regexp_replace(F.regexp_replace("path", r"\.[^./]*$", ""), r"/(?:index|__init__)$", "")
    targets = files.select("repository", T.posix(F.col("path")).alias("path")).select(F.concat_ws("\u0001", "repository", stem).alias("_stem"), F.col("path").alias("target_path")).groupBy("_stem").agg(F.min("target_path").alias("target_path"))
    return keyed.join(targets, "_stem", "left").drop("_stem")


def build_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the code graph: repositories, files, entities and modules with CONTAINS, DEFINES, IMPORTS, CALLS, EXTENDS, IMPLEMENTS.

    Relative imports become edges between files where the file is there, others edges to global modules. Edges
    know their import types. A call leads to the first function or class of its name in the repository, a base
    type to the first class there. Of files of one repository and path the one with the least hash of its
    content counts. Texts are parsed once and never shuffled.
    """
    of = files.where(F.col("repository").isNotNull() & F.col("path").isNotNull())
    parsed_all = parse_files(of, "entities", "imports", "calls")
    best = F.min_by(F.struct("entities", "imports", "calls", "language"), F.coalesce("content_key", F.lit(0))).alias("_b")
    rows = checkpointed(parsed_all.groupBy("repository", "path").agg(best).select("repository", "path", "_b.*"))
    base = of.select("repository", T.posix(F.col("path")).alias("path")).distinct()
    file_id = T.node_id("File", F.col("repository"), F.col("path"))
    none = lambda: F.lit(None).cast("string")
    ent = explode_part(rows, "entities").withColumn("id", T.node_id(T.entity_label(F.col("kind")), F.col("repository"), F.col("path"), F.col("name"), F.col("start_line")))
    imp = resolve_imports(explode_part(rows, "imports"), base).withColumn(
        "dst", F.when(F.col("target_path").isNotNull(), T.node_id("File", F.col("repository"), F.col("target_path"))).otherwise(T.node_id(F.when(T.is_external_package(F.col("source")), "Module:npm").otherwise("Module:local"), F.col("source")))
    )
    nodes = (
        base.select(T.node_id("Repository", F.col("repository")).alias("id"), F.lit("Repository").alias("label"), "repository", F.col("repository").alias("name"), none().alias("path")).distinct()
        .unionByName(base.select(file_id.alias("id"), F.lit("File").alias("label"), "repository", T.display_name(F.col("path")).alias("name"), "path"))
        .unionByName(ent.groupBy("id").agg(F.min(F.struct(T.entity_label(F.col("kind")).alias("label"), "repository", "name", "path")).alias("_e")).select("id", "_e.label", "_e.repository", "_e.name", "_e.path"))
        .unionByName(imp.where("target_path is null").select(F.col("dst").alias("id"), F.lit("Module").alias("label"), none().alias("repository"), F.col("source").alias("name"), none().alias("path")).distinct())
    )
    first = ent.where(F.col("kind").isin("function", "method", "class")).groupBy("repository", "name").agg(F.min("id").alias("dst"))
    callers = ent.where(F.col("kind").isin("function", "method")).groupBy("repository", "path", F.col("name").alias("caller")).agg(F.min("id").alias("src"))
    edge = lambda df, kind: df.select("src", "dst", F.lit(kind).alias("type"))
    calls = edge(explode_part(rows, "calls").select("repository", "path", "name", "caller").distinct().join(first, ["repository", "name"]).join(callers, ["repository", "path", "caller"]), "CALLS")
    types = ent.where(F.col("kind").isin("class", "interface")).groupBy("repository", "name").agg(F.min("id").alias("dst"))
    bare = F.regexp_extract("_base", r"([\w$]+)\s*(?:[<(\[].*)?$", 1)

    def bases(part: str, kind: str) -> DataFrame:
        named = ent.select("repository", F.col("id").alias("src"), F.explode(part).alias("_base")).withColumn("name", bare)
        return edge(named.join(types, ["repository", "name"]).where(F.col("src") != F.col("dst")), kind)

    edges = (
        base.select(T.node_id("Repository", F.col("repository")).alias("src"), file_id.alias("dst"), F.lit("CONTAINS").alias("type"))
        .unionByName(ent.select(file_id.alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("type")))
        .unionByName(imp.select(file_id.alias("src"), "dst", F.lit("IMPORTS").alias("type")))
        .unionByName(calls).unionByName(bases("extends", "EXTENDS")).unionByName(bases("implements", "IMPLEMENTS"))
        .dropDuplicates(["src", "dst", "type"])
    )
    return nodes, edges


def ingest_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after some files (repository, path, content) came in or changed: what they held goes, what they hold now comes in."""
    changed = files.select("repository", T.posix(F.col("path")).alias("path"))
    return G.replace_files(nodes, edges, changed, build_graph(files))


def import_kinds(imports: DataFrame) -> DataFrame:
    """Imports with ``import_type``: type, namespace, default, side-effect or named."""
    return imports.withColumn("import_type", T.import_type(F.col("type_only"), F.col("name") == "*", F.col("name") == "default", F.col("side_effect")))


def signatures(metadata: DataFrame) -> DataFrame:
    """Functions and methods with ``full_signature``, made of their parameters and types."""
    typed = F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), F.nullif(p["type"], F.lit("")).alias("type")))
    full = T.function_signature(F.col("name"), F.array_contains("flags", "async"), typed, F.nullif(F.col("returns"), F.lit("")))
    return metadata.where(F.col("kind").isin("function", "method")).withColumn("full_signature", full)
