"""Scalar functions of ingestion and search, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of a file extension in chunk metadata.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "jsx", ".mjs": "javascript", ".cjs": "javascript",
    ".java": "java", ".py": "python", ".pyw": "python", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php",
}


#: The extensions that a search for a language looks at.
LANGUAGE_EXTENSIONS = {
    "python": (".py", ".pyw", ".pyi"), "typescript": (".ts", ".tsx", ".mts", ".cts"), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "java": (".java",), "csharp": (".cs",), "go": (".go",), "rust": (".rs",),
    "ruby": (".rb",), "php": (".php",), "swift": (".swift",), "kotlin": (".kt", ".kts"), "scala": (".scala",), "c": (".c", ".h"), "cpp": (".cpp", ".hpp", ".cc", ".hh", ".cxx", ".hxx"), "markdown": (".md", ".mdx"),
    "json": (".json",), "yaml": (".yaml", ".yml"), "html": (".html", ".htm"), "css": (".css", ".scss", ".sass", ".less"),
}


def language_of_extension(ext: Column) -> Column:
    """The language that an extension belongs to in searches, null for others."""
    known = F.create_map(*[F.lit(x) for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts for x in (e, lang)])
    return known[F.lower(ext)]


def estimate_tokens(c: Column) -> Column:
    """Token estimate: a quarter of the code points, rounded up."""
    return F.ceil(F.char_length(c) / 4).cast("long")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_id(repository: Column, path: Column, index: Column) -> Column:
    return F.concat_ws(":", repository, path, index.cast("string"))


def table_chunk_id(repository: Column, path: Column, table: Column, part: Column) -> Column:
    return F.concat(repository, F.lit(":"), path, F.lit(":table-"), table.cast("string"), F.lit(":"), part.cast("string"))


def parse_table_id(c: Column) -> Column:
    """(repository, path, index) of ``repo:path:index``; the path may hold colons."""
    parts = F.split(c, ":")
    n = F.size(parts)
    return F.when(
        n >= 3,
        F.struct(parts[0].alias("repository"), F.array_join(F.slice(parts, 2, n - 2), ":").alias("path"), F.try_element_at(parts, n).try_cast("int").alias("index")),
    )


def node_id(label: Column | str, *rest: Column) -> Column:
    return F.concat_ws(":", F.lit(label) if isinstance(label, str) else label, *[x.cast("string") for x in rest])


def document_node_id(repository: Column, path: Column) -> Column:
    return node_id("Document", repository, path)


def external_link_id(url: Column) -> Column:
    return F.concat(F.lit("ExternalLink:"), F.substring(F.sha1(url), 1, 16))


def section_id(path: Column, index: Column, level: Column, title: Column) -> Column:
    return F.concat(F.lit("Section:"), F.substring(F.sha1(F.concat_ws("|", path, index.cast("string"), level.cast("string"), title)), 1, 12))


def posix(path: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, ``''`` without one."""
    return F.lower(F.regexp_extract(posix(path), r"[^/](\.[^./]*)$", 1))


def detect_language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(known[extension(path)], F.lit("unknown"))


def normalize_line_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def snippet(c: Column, limit: int = 500, tolerance: int = 50) -> Column:
    """The first ``limit`` characters, cut back to the last space if it is within ``tolerance``, with an ellipsis."""
    head = F.substring(c, 1, limit)
    space = F.lit(limit) - F.locate(" ", F.reverse(head)) + 1  # position of the last space, from 1
    has = F.locate(" ", head) > 0
    cut = F.when(has & (space - 1 > limit - tolerance), F.substring(head, F.lit(1), space - 1)).otherwise(head)
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(cut, F.lit("...")))


def display_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def package_of(path: Column) -> Column:
    return F.split(path, "/")[0]


def module_of(path: Column) -> Column:
    """Second segment of a path, null if there is none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, parts[1])


def collection_name(c: Column) -> Column:
    """Storage name of a collection: lower case, other characters as single underscores, at most 63 characters."""
    base = F.concat(F.lit("repo_"), F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), "_+", "_"))
    trimmed = F.regexp_replace(base, "_+$", "")
    return F.when(F.char_length(trimmed) <= 63, trimmed).otherwise(F.concat(F.substring(trimmed, 1, 54), F.lit("_"), F.substring(F.sha1(c), 1, 8)))


def resolve_relative(base: Column, target: Column) -> Column:
    """``target`` seen from the folder of ``base``, with ``.`` and ``..`` folded away; null if it leaves the root."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    parts = F.filter(F.split(F.concat(F.when(target.startswith("/"), F.lit("")).otherwise(folder), target), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))

    def step(acc: Column, p: Column) -> Column:
        up = p == ".."
        return F.struct(
            F.when(~up, F.concat(acc["at"], F.array(p))).when(F.size(acc["at"]) > 0, F.slice(acc["at"], F.lit(1), F.size(acc["at"]) - 1)).otherwise(acc["at"]).alias("at"),
            (acc["inside"] & (~up | (F.size(acc["at"]) > 0))).alias("inside"),
        )

    done = F.aggregate(parts, start, step)
    return F.when(done["inside"], F.array_join(done["at"], "/"))


def is_external_package(source: Column) -> Column:
    return ~(source.startswith(".") | source.startswith("/"))


def is_external_url(c: Column) -> Column:
    return c.rlike(r"^(?i)(?:[a-z][a-z0-9+.-]*:|//)")


def import_type(is_type: Column, is_namespace: Column, is_default: Column, is_side_effect: Column) -> Column:
    return F.when(is_type, "type").when(is_namespace, "namespace").when(is_default, "default").when(is_side_effect, "side-effect").otherwise("named")


def function_signature(name: Column, is_async: Column, parameters: Column, returns: Column) -> Column:
    """``[async ]name(p: T, ...): R`` from an array of (name, type); types default to any and void."""
    inner = F.array_join(F.transform(parameters, lambda p: F.concat(p["name"], F.lit(": "), F.coalesce(p["type"], F.lit("any")))), ", ")
    return F.concat(F.when(is_async, "async ").otherwise(""), name, F.lit("("), inner, F.lit("): "), F.coalesce(returns, F.lit("void")))


def entity_label(kind: Column) -> Column:
    return (
        F.when(kind.isin("function", "method"), "Function")
        .when(kind.isin("class", "interface", "enum", "type_alias"), "Class")
        .when(kind.isin("variable", "property"), "Variable")
        .otherwise("Entity")
    )


def looks_like_identifier(c: Column) -> Column:
    """Prose rule: at least four characters with a capital behind the first."""
    return (F.char_length(c) >= 4) & c.rlike(r"^.+[A-Z]")


def looks_like_code_span(c: Column) -> Column:
    """Code-span rule: a dotted name that also looks like an identifier."""
    return looks_like_identifier(c) & c.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$")


def identifier_tokens(c: Column) -> Column:
    """Distinct name-like tokens of a text (ASCII names of four characters or more)."""
    return F.array_distinct(F.filter(F.split(c, r"[^A-Za-z0-9_]+"), lambda t: t.rlike(r"^[A-Za-z][A-Za-z0-9_]{3,}$")))


def wikilinks(c: Column) -> Column:
    """Targets of ``[[target|alias]]`` links."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda t: F.trim(F.split(t, r"\|")[0]))


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def anchor_slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), " ", "-")


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def escape_cell(c: Column) -> Column:
    """A Markdown table cell: pipes and backslashes escaped, line ends as spaces."""
    return F.regexp_replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def unescape_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\|"), F.lit("|")), F.lit("\\\\"), F.lit("\\"))


def csv_cell(c: Column) -> Column:
    """A CSV field, quoted where it must be."""
    return F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def rename_confidence(old_size: Column, new_size: Column) -> Column:
    return (
        F.when(old_size.isNotNull() & new_size.isNotNull(), F.when(old_size == new_size, 0.9).otherwise(0.7))
        .when(old_size.isNotNull(), 0.9)
        .otherwise(0.7)
    )


def divergence_percent(missing: Column, eligible: Column) -> Column:
    """Share of eligible files that are missing, in percent with one decimal, half up."""
    return F.when(eligible > 0, F.floor(missing / eligible * 1000 + F.lit(0.5)) / 10).otherwise(F.lit(0.0))


def elapsed(ms: Column) -> Column:
    """A duration in words: seconds, minutes, hours or days, whichever fits."""
    s = F.floor(ms / 1000)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ")  , F.floor((s % 3600) / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d")))
    )


def backoff_ms(attempt: Column, initial: int = 1000, factor: float = 2.0, most: int = 60_000) -> Column:
    return F.least(F.lit(float(initial)) * F.pow(F.lit(factor), attempt), F.lit(float(most))).cast("long")


def pdf_date(c: Column) -> Column:
    """A PDF date ``D:YYYYMMDDHHmmSS+hh'mm'`` as a UTC timestamp; parts from the month on may be missing, null if it is none."""
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(c, _PDF_DATE, i), F.lit("")), F.lit(default))
    local = F.try_to_timestamp(
        F.concat(F.regexp_extract(c, _PDF_DATE, 1), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"))
    )
    shift = (part(8, "0").cast("int") * 60 + part(9, "0").cast("int")) * F.when(part(7, "Z") == "-", 1).when(part(7, "Z") == "+", -1).otherwise(0)
    return F.when(c.rlike(_PDF_DATE), F.timestamp_add("MINUTE", shift, local))


_PDF_DATE = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([Zz+-])(?:(\d{2})'?(?:(\d{2})'?)?)?)?$"
