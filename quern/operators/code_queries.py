"""Code-graph queries over the repositories' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import codegraph as C
from quern.operators import graph as G
from quern.tables import spread, table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "file_inputs", "repository", "path", "content"))


def code_entities(spark: SparkSession, d: str) -> DataFrame:
    return C.parsed(_files(spark, d), "entities")


def code_imports(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return C.resolve_imports(C.parsed(f, "imports"), f)


def code_exports(spark: SparkSession, d: str) -> DataFrame:
    return C.parsed(_files(spark, d), "exports")


def code_calls(spark: SparkSession, d: str) -> DataFrame:
    return C.parsed(_files(spark, d), "calls")


def code_errors(spark: SparkSession, d: str) -> DataFrame:
    return C.parsed(_files(spark, d), "errors")


def code_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.counts(*C.build_graph(_files(spark, d)))


def code_file_dependents(spark: SparkSession, d: str) -> DataFrame:
    """How much depends on each file: files that import it, and the score of all that do so through others."""
    nodes, edges = C.build_graph(_files(spark, d))
    return G.impact_scores(nodes.where("label = 'File'").select("id"), edges.where(F.col("dst").startswith("File:")), ("IMPORTS",))


def code_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods with parameters, result, flags and documentation."""
    return C.signatures(C.parsed(_files(spark, d), "metadata"))


def code_entities_exported(spark: SparkSession, d: str) -> DataFrame:
    return C.filter_entities(C.parsed(_files(spark, d), "entities"), ("class", "function", "interface"), True)


def code_imports_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Imports of the repositories' own files with their types, side effects left out."""
    return C.import_kinds(C.filter_imports(C.parsed(_files(spark, d), "imports"), external=False, side_effect=False))


def code_exports_own(spark: SparkSession, d: str) -> DataFrame:
    return C.filter_exports(C.parsed(_files(spark, d), "exports"), False)


def code_declared(spark: SparkSession, d: str) -> DataFrame:
    """Functions of Go and exported functions of scripts that stand at a line's start."""
    f = _files(spark, d).where("repository is not null")
    rows = C.parse_files(f, "entities").where("language in ('go', 'typescript', 'javascript')")
    top = C.explode_part(rows, "entities").where("kind = 'function' and (language = 'go' or signature rlike '^export (async )?function')")
    return top.select("repository", "path", "name").distinct()


def code_imported(spark: SparkSession, d: str) -> DataFrame:
    """Sources of scripts' imports and packages of Java's that stand on lines of their own."""
    rows = C.parse_files(_files(spark, d).where("repository is not null"), "imports").where("language in ('typescript', 'javascript', 'java')")
    return C.explode_part(rows, "imports").where("not (name = '*' and alias = '' and language != 'java')").select("repository", "path", "source").distinct()


QUERIES = {
    "code_entities": code_entities,
    "code_imports": code_imports,
    "code_exports": code_exports,
    "code_calls": code_calls,
    "code_errors": code_errors,
    "code_graph_counts": code_graph_counts,
    "code_file_dependents": code_file_dependents,
    "code_metadata": code_metadata,
    "code_declared": code_declared,
    "code_imported": code_imported,
    "code_entities_exported": code_entities_exported,
    "code_imports_filtered": code_imports_filtered,
    "code_exports_own": code_exports_own,
}

SQL: dict[str, str] = {
    "code_declared": r"""WITH l AS (SELECT repository, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path, lower(regexp_extract(path, '\.[^.]*$')) AS ext, unnest(string_split(content, chr(10))) AS x FROM file_inputs WHERE repository IS NOT NULL)
SELECT DISTINCT repository, path, regexp_extract(x, CASE WHEN ext = '.go' THEN '^func (\w+)[\[(]' ELSE '^export (?:async )?function\*? ?(\w+)' END, 1) AS name FROM l
WHERE (ext = '.go' AND regexp_matches(x, '^func (\w+)[\[(]')) OR (ext IN ('.ts', '.mts', '.js', '.mjs') AND regexp_matches(x, '^export (?:async )?function\*? ?(\w+)'))""",
    "code_imported": r"""WITH l AS (SELECT repository, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path, lower(regexp_extract(path, '\.[^.]*$')) AS ext, unnest(string_split(content, chr(10))) AS x FROM file_inputs WHERE repository IS NOT NULL)
SELECT DISTINCT repository, path, CASE WHEN ext = '.java' THEN regexp_extract(x, '^import (?:static )?([\w.*]+) *;', 1) ELSE regexp_extract(x, '^import (?:[^''"]* from )?[''"]([^''"]+)[''"]', 1) END AS source FROM l
WHERE (ext = '.java' AND regexp_matches(x, '^import (?:static )?([\w.*]+) *;')) OR (ext IN ('.ts', '.mts', '.js', '.mjs') AND regexp_matches(x, '^import (?:[^''"]* from )?[''"]([^''"]+)[''"]'))""",
}
