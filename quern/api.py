"""The query tools in one place: arguments are checked, then a DataFrame is returned.

Limits follow the tools' interface; a query vector is given or made by an embedder, a function of a text.
"""

from __future__ import annotations

import hashlib
import math
import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graph as G
from quern.operators import metrics as Met
from quern.operators import vectors as V
from quern.plans import predicates as P


def hashing_embedder(dimensions: int = 64) -> Callable[[str], list[float]]:
    """A deterministic embedder for work without a model: signed hashed words, unit length."""

    def embed(text: str) -> list[float]:
        v = [0.0] * dimensions
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dimensions] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    return embed


def _between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")


class Engine:
    """Tools over registered DataFrames: ``chunks`` (id, embedding, content, metadata), ``repositories``, ``nodes``, ``edges``."""

    def __init__(self, spark: SparkSession, chunks: DataFrame | None = None, repositories: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, embed: Callable[[str], Sequence[float]] | None = None) -> None:
        self.spark, self.chunks, self.repositories, self.nodes, self.edges = spark, chunks, repositories, nodes, edges
        self.embed = embed or hashing_embedder()
        self.ttl, self.most, self._kept = 300.0, 100, {}

    def _search(self, rows: DataFrame, query: str | Sequence[float], limit: int, threshold: float) -> DataFrame:
        _between("limit", limit, 1, 50)
        _between("threshold", threshold, 0, 1)
        if isinstance(query, str) and not 1 <= len(query.strip()) <= 1000:
            raise ValueError("a query has 1 to 1000 characters")
        vector = list(self.embed(query) if isinstance(query, str) else query)
        q = F.array(*[F.lit(float(x)) for x in vector])
        scored = rows.withColumn("similarity", F.round(V.similarity(F.col("embedding"), q), 6)).drop("embedding")
        return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(limit)

    def semantic_search(self, query: str | Sequence[float], limit: int = 10, threshold: float = 0.7, repository: str | None = None, language: str | None = None) -> DataFrame:
        """Chunks of the repositories that are ready (or in error); one named must exist and not be indexing."""
        rows = self.chunks
        if self.repositories is not None:
            if repository is not None:
                state = self.repositories.where(F.col("repo_name") == repository).select("status").first()
                if state is None:
                    raise LookupError(f"no repository {repository}")
                if state[0] not in ("ready", "error"):
                    raise RuntimeError(f"repository {repository} is {state[0]}")
            usable = self.repositories.where(F.col("status").isin("ready", "error")).select(F.col("repo_name").alias("repository"))
            rows = rows.join(usable, "repository", "left_semi")
        if repository is not None:
            rows = rows.where(F.col("repository") == repository)
        if language is not None:
            rows = rows.where(P.language(language))
        found = self._search(rows, query, limit, threshold)
        return found.withColumn("snippet", T.snippet(F.col("content"))).drop("content") if "content" in found.columns else found

    def search_all(self, query: str | Sequence[float], documents: Callable[[], DataFrame] | None, limit: int = 10, threshold: float = 0.7, **code) -> tuple[DataFrame, list[str]]:
        """(results, warnings): chunks of code and of documents in one list, tagged by ``source_type``; failing documents are only a warning."""
        found = self.semantic_search(query, limit, threshold, **code).withColumn("source_type", F.lit("code"))
        try:
            if documents is None:
                raise LookupError("there is no document search")
            other = documents().withColumn("source_type", F.lit("document"))
        except Exception as e:  # noqa: BLE001 - code results do not depend on documents
            return found, [f"document search failed: {e}"]
        return found.unionByName(other, allowMissingColumns=True).orderBy(F.desc("similarity"), "source_type", "id").limit(limit), []

    def search_documents(self, query: str | Sequence[float], limit: int = 10, threshold: float = 0.7, document_types: Sequence[str] = ("all",), tables: str = "include", folder: str | None = None) -> DataFrame:
        rows = self.chunks.where(P.document_types(document_types) & P.table_mode(tables))
        return self._search(rows.where(P.folders(None if folder is None else [folder])), query, limit, threshold)

    def search_images(self, images: DataFrame, limit: int = 20, **criteria) -> DataFrame:
        _between("limit", limit, 1, 100)
        return images.where(P.images(**criteria)).orderBy("filename").limit(limit)

    def list_indexed_repositories(self) -> DataFrame:
        return self.repositories.orderBy("repo_name")

    def get_dependencies(self, start: str, depth: int = 1, types: Sequence[str] = G.DEPENDENCY_TYPES, include_external: bool = True) -> DataFrame:
        """Dependencies of a node; without externals modules from outside the repositories are left out."""
        _between("depth", depth, 1, G.MAX_HOPS)
        found = G.dependencies(self._one(start), self.edges, types, depth)
        return found if include_external else found.where(~F.col("node").startswith("Module:npm"))

    def get_dependents(self, start: str, depth: int = 1, types: Sequence[str] = G.DEPENDENCY_TYPES, include_cross_repo: bool = False) -> DataFrame:
        """Dependents of a node, only its own repository's unless ``include_cross_repo``."""
        _between("depth", depth, 1, G.MAX_HOPS)
        found = G.dependents(self._one(start), self.edges, types, depth)
        if include_cross_repo:
            return found
        own = self.nodes.where(F.col("id") == start).select("repository")
        mine = self.nodes.join(own, "repository", "left_semi").select(F.col("id").alias("node"))
        return found.join(mine, "node", "left_semi")

    def find_path(self, start: str, target: str, max_hops: int = G.MAX_HOPS) -> DataFrame:
        _between("max_hops", max_hops, 1, 20)
        return G.shortest_paths(self._one(start), self._one(target), self.edges, max_hops)

    def get_architecture(self, repository: str | None = None, level: str = "packages", scope: str | None = None) -> DataFrame:
        files = self.nodes.where(F.col("label") == "File")
        if level == "entities":
            own = files.where(F.col("repository") == repository) if repository else files
            return G.entities(own.where(F.col("path").startswith(scope)) if scope else own, self.edges)
        files = files.select("repository", "path")
        return G.architecture(files.where(F.col("repository") == repository) if repository else files, level, scope)

    def get_graph_metrics(self, log: DataFrame, types: Sequence[str]) -> DataFrame:
        return Met.query_metrics(log, list(types))

    def get_context(self, seeds: Sequence[str], limit: int = 20) -> DataFrame:
        _between("limit", limit, 1, 100)
        return G.expand_context(self.spark.createDataFrame([(s,) for s in seeds], "id string"), self.nodes, self.edges, limit)

    def cached(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        """The result of a query for a while: kept by Spark, dropped after ``ttl`` seconds or when more than ``most`` are kept, the oldest first."""
        now = time.monotonic()
        for k in [k for k, (_, at) in self._kept.items() if now - at > self.ttl]:
            self._kept.pop(k)[0].unpersist()
        if key not in self._kept:
            while len(self._kept) >= self.most:
                self._kept.pop(next(iter(self._kept)))[0].unpersist()
            self._kept[key] = (make().persist(), now)
        return self._kept[key][0]

    def forget(self, repository: str) -> None:
        """Drop kept results whose key names a repository."""
        for k in [k for k in self._kept if repository in k]:
            self._kept.pop(k)[0].unpersist()

    def within(self, seconds: float, run: Callable[[], object]) -> object:
        """What ``run`` returns, or TimeoutError once its Spark jobs have been cancelled after so many seconds."""
        tag = f"quern-{uuid.uuid4().hex}"
        timer = threading.Timer(seconds, lambda: self.spark.interruptTag(tag))
        began = time.monotonic()
        self.spark.addTag(tag)
        timer.start()
        try:
            return run()
        except Exception as e:
            if time.monotonic() - began >= seconds:
                raise TimeoutError(f"the query took longer than {seconds} s") from e
            raise
        finally:
            timer.cancel()
            self.spark.removeTag(tag)

    def _one(self, node: str) -> DataFrame:
        return self.spark.createDataFrame([(node,)], "id string")
