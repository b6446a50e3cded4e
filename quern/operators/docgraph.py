"""The graph of documents: nodes for documents, sections and external links, edges between them and to code.

Everything is a join over small rows that one pass over the texts gives; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import markdown as M
from quern.session import checkpointed


def mention_edges(mentions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, type, confidence) of mentions (repository, src, name, confidence) whose name is exactly that of a symbol.

    ``symbols`` is (repository, name, id), one row a name (see ``graph.symbol_index``). Of several mentions of
    a pair the surest counts.
    """
    s = symbols.select("repository", "name", F.col("id").alias("dst"))
    hit = mentions.join(s, ["repository", "name"])
    return hit.groupBy("src", "dst").agg(F.min("confidence").alias("confidence")).select("src", "dst", F.lit("MENTIONS").alias("type"), "confidence")  # high before low


def foreign_mentions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, type): mentions that lead out of their document's repository, or to a node without one."""
    of = nodes.select("id", "repository")
    m = edges.where("type = 'MENTIONS'").select("src", "dst", "type")
    a, b = of.select(F.col("id").alias("src"), F.col("repository").alias("_from")), of.select(F.col("id").alias("dst"), F.col("repository").alias("_to"))
    j = m.join(a, "src").join(b, "dst", "left")
    return j.where(F.col("_to").isNull() | (F.col("_to") != F.col("_from"))).select("src", "dst", "type").distinct()


def build_document_graph(docs: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents (doc_id, repository, file_path, text).

    Nodes: Document, Section, ExternalLink (id, label, repository, name, path). Edges: HAS_SECTION from a document to
    its top sections, CONTAINS_SECTION from a section to those below it, LINKS_TO from a document to what its
    links lead to, MENTIONS from a document to symbols (repository, name, id) of its own repository.
    Documents without a path get no node; a path that stands in a repository twice is one document, the one of least ``doc_id``.
    """
    named = docs.where(F.col("file_path").isNotNull() & F.col("repository").isNotNull())
    first = named.groupBy("repository", "file_path").agg(F.min("doc_id").alias("doc_id"))
    base = named.join(first.select("doc_id"), "doc_id", "left_semi").select("doc_id", "repository", "file_path", "text")
    small = base.drop("text").withColumn("node", T.document_node_id(F.col("repository"), F.col("file_path")))
    titled = checkpointed(small.join(M.titles(base), "doc_id"))
    section = T.section_id(F.col("file_path"), F.col("section"), F.col("level"), F.col("title"))
    heads = checkpointed(M.sections(base).join(small, "doc_id").withColumn("section_node", section))
    links = checkpointed(_links(base, small, titled, heads, symbols))
    mentions = M.mentions(base).join(small, "doc_id").select("repository", F.col("node").alias("src"), "name", "confidence")
    none = lambda: F.lit(None).cast("string")
    external = links.where(F.col("node").startswith("ExternalLink:")).groupBy("node").agg(F.min("target").alias("target"))
    nodes = (
        titled.select(F.col("node").alias("id"), F.lit("Document").alias("label"), "repository", F.col("title").alias("name"), F.col("file_path").alias("path"))
        .unionByName(heads.groupBy(F.col("section_node").alias("id")).agg(F.min(F.struct("repository", "title", "file_path")).alias("_s")).select("id", F.lit("Section").alias("label"), F.col("_s.repository").alias("repository"), F.col("_s.title").alias("name"), F.col("_s.file_path").alias("path")))
        .unionByName(external.select(F.col("node").alias("id"), F.lit("ExternalLink").alias("label"), none().alias("repository"), F.col("target").alias("name"), none().alias("path")))
    )
    above = heads.select("doc_id", F.col("section").alias("parent"), F.col("section_node").alias("src"))
    sure = none().alias("confidence")
    edges = (
        heads.where("parent < 0").select(F.col("node").alias("src"), F.col("section_node").alias("dst"), F.lit("HAS_SECTION").alias("type"), sure)
        .unionByName(heads.where("parent >= 0").join(above, ["doc_id", "parent"]).select("src", F.col("section_node").alias("dst"), F.lit("CONTAINS_SECTION").alias("type"), sure))
        .unionByName(links.select("src", F.col("node").alias("dst"), F.lit("LINKS_TO").alias("type"), sure))
        .dropDuplicates(["src", "dst", "type"])
        .unionByName(mention_edges(mentions, symbols))
    )
    return nodes, edges


def _links(base: DataFrame, small: DataFrame, titled: DataFrame, heads: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, target, node) of all links that lead somewhere."""
    found = M.links(base).join(small.withColumnRenamed("node", "src"), "doc_id")
    sections = heads.select("repository", "title", F.col("section_node").alias("node"))
    return M.resolve_links(found, titled, sections, symbols.select("repository", "name", F.col("id").alias("node"))).select("src", "target", "node")
