"""Vector similarity search: filter, score, threshold, top-k, exactly or over the cells of an index.

Similarity is ``clamp((1 + cosine) / 2, 0, 1)``. A batch of vectors is scored against a block of query
vectors by one matrix product in an Arrow batch; each batch only passes on its own best rows per query,
so the shuffle before the final ranking carries at most k rows a query and batch. Query sets of any
size are worked off in blocks of a fixed number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T

#: Vectors of one block of queries: bounds what is collected and sent out at once.
QUERY_BLOCK = 2048


def similarity(a: Column, b: Column) -> Column:
    """Similarity of two vector columns as an expression; a zero vector is orthogonal to all, other sizes are an error."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    n = norm(a) * norm(b)
    checked = F.when(F.size(a) == F.size(b), dot).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(1.0) + F.when(n > 0, checked / n).otherwise(0.0)) / 2))


def _scored(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int | None, threshold: float, digits: int) -> DataFrame:
    norms = np.linalg.norm(queries, axis=1, keepdims=True)
    unit = queries / np.where(norms > 0, norms, 1)
    size = unit.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows:
                continue
            lists = b.column(1)
            if pc.any(pc.not_equal(pc.list_value_length(lists), size)).as_py():
                raise ValueError("vectors differ in size from the queries")
            m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            sim = np.round(np.clip((1 + (m / np.where(n > 0, n, 1)) @ unit.T) / 2, 0, 1), digits)
            keep = sim >= threshold
            if k is not None and len(m) > k:
                order = np.lexsort((np.broadcast_to(b.column(0).to_numpy(zero_copy_only=False)[:, None], sim.shape), -sim), axis=0)
                best = np.zeros_like(keep)
                np.put_along_axis(best, order[:k], True, axis=0)
                keep &= best
            row, query = np.nonzero(keep)
            out = [pa.array(ids[query]), b.column(0).take(pa.array(row)), pa.array(sim[row, query])]
            out += [c.take(pa.array(row)) for c in b.columns[2:]]
            yield pa.RecordBatch.from_arrays(out, ["query_id", "vec_id", "similarity", *b.schema.names[2:]])

    rest = "".join(f", {f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields[2:])
    return vectors.mapInArrow(run, f"query_id long, vec_id long, similarity double{rest}")


def score_all(vectors: DataFrame, queries: DataFrame, k: int | None, threshold: float, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, similarity, other columns of ``vectors``): rows at or above the threshold, k a query and batch at most.

    Both sides are (id, embedding, ...); null embeddings are left out.
    """
    queries = queries.where(F.col(queries.columns[1]).isNotNull())
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(queries.columns[0]), F.lit(blocks)) == block)
        rows = part.select(queries.columns[0], queries.columns[1]).collect()
        if not rows and out is not None:
            continue
        ids = np.array([r[0] for r in rows], np.int64)
        matrix = np.array([r[1] for r in rows], np.float64) if rows else np.zeros((0, 1))
        found = (
            _scored(vectors, ids, matrix, k, threshold, digits)
            if rows
            else vectors.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.col(vectors.columns[0]).alias("vec_id"), F.lit(0.0).alias("similarity"), *vectors.columns[2:])
        )
        out = found if out is None else out.unionByName(found)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.7) -> DataFrame:
    """The k most similar vectors of each query, ties by id, with their rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return score_all(vectors, queries, k, threshold).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def merge_sources(results: dict[str, DataFrame], k: int) -> DataFrame:
    """Results of several searches merged per query: tagged with their source, best k kept, ties by source and id."""
    tagged = [df.drop("rank").withColumn("source_type", F.lit(name)) for name, df in results.items()]
    union = tagged[0]
    for x in tagged[1:]:
        union = union.unionByName(x)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "source_type", "vec_id")
    return union.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def provider_groups(repositories: DataFrame) -> DataFrame:
    """Repositories grouped by embedding space: one query vector serves a group."""
    return repositories.groupBy("provider", "model", "dimensions").agg(F.sort_array(F.collect_set("repo_name")).alias("repositories"))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two vector columns; other sizes are an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double")))


def source_counts(merged: DataFrame) -> DataFrame:
    """(query_id, source_type, n) of merged results: how many each source gave."""
    return merged.groupBy("query_id", "source_type").agg(F.count(F.lit(1)).alias("n"))


def project_results(found: DataFrame) -> DataFrame:
    """Search results as they are shown, with what stands in for missing metadata; the language comes from the extension if none is stored.

    Columns looked for: file_path, repository, content, similarity, chunk_index, file_extension, file_size_bytes, language.
    """
    of = lambda name, kind, other: F.coalesce(F.col(name).cast(kind), F.lit(other)) if name in found.columns else F.lit(other)
    ext = of("file_extension", "string", "")
    own = F.col("language") if "language" in found.columns else F.lit(None).cast("string")
    return found.select(
        *[c for c in ("query_id", "rank", "source_type") if c in found.columns],
        of("file_path", "string", "unknown").alias("file_path"), of("repository", "string", "unknown").alias("repository"), T.snippet(of("content", "string", "")).alias("content_snippet"),
        of("similarity", "double", 0.0).alias("similarity_score"), of("chunk_index", "int", 0).alias("chunk_index"), ext.alias("file_extension"), of("file_size_bytes", "long", 0).alias("file_size_bytes"),
        F.coalesce(own, T.language_of_extension(ext)).alias("language"),
    )


def search_groups(groups: dict[tuple[str, str, int], tuple[DataFrame, list[float]]], k: int, threshold: float) -> tuple[DataFrame | None, list[str]]:
    """(results, warnings): one search per embedding space with that space's query vector, merged; a space that cannot be searched is a warning.

    ``groups`` maps (provider, model, dimensions) to the vectors (id, embedding, ...) of its repositories and the query.
    """
    out: DataFrame | None = None
    warnings: list[str] = []
    for (provider, model, size), (vectors, query) in groups.items():
        try:
            if len(query) != size:
                raise ValueError(f"the query has {len(query)} dimensions, the collections have {size}")
            q = F.array(*[F.lit(float(x)) for x in query])
            first, second = vectors.columns[:2]
            found = vectors.where(F.col(second).isNotNull()).withColumn("similarity", F.round(similarity(F.col(second), q), 6)).drop(second)
            found = found.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), first).limit(k)
        except Exception as e:  # noqa: BLE001 - one space's failure is not the others'
            warnings.append(f"{provider}:{model}:{size}: {e}")
            continue
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    if out is not None and len(groups) > 1:
        out = out.orderBy(F.desc("similarity"), out.columns[0]).limit(k)
    return out, warnings


# An index of coarse cells: candidates first, the exact way stays ``top_k``.


class Cells:
    """Unit centres of cells, fitted on a bounded sample of vectors."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres

    @staticmethod
    def fit(vectors: DataFrame, n_cells: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> Cells:
        """Spherical k-means on about ``sample`` vectors (id, embedding), drawn by a hash of the id."""
        first, second = vectors.columns[:2]
        there = vectors.where(F.col(second).isNotNull() & F.col(first).isNotNull())
        n = there.count()
        part = there if n <= sample else there.where(F.xxhash64(first) < F.lit((1 << 64) * sample // n - (1 << 63)).cast("long")).limit(4 * sample)
        m = np.array(part.select(second).toArrow().column(0).to_pylist(), np.float64)
        if not len(m):
            return Cells(np.zeros((1, 1)))
        m = _unit(m)
        rng = np.random.default_rng(seed)
        c = m[rng.choice(len(m), min(n_cells, len(m)), replace=False)]
        for _ in range(rounds):
            of = (m @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, of, m)
            some = np.bincount(of, minlength=len(c)) > 0
            c = np.where(some[:, None], _unit(sums), c)
        return Cells(c)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _celled(vectors: DataFrame, cells: Cells, nearest: int) -> DataFrame:
    """(id, embedding, cell): each vector with its nearest cells."""
    first, second = vectors.columns[:2]
    centres, size = cells.centres, cells.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows:
                continue
            if pc.any(pc.not_equal(pc.list_value_length(b.column(1)), size)).as_py():
                raise ValueError("vectors differ in size from the index")
            m = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))
            near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :nearest]
            at = np.repeat(np.arange(len(m)), near.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], [first, second, "cell"])

    kind = vectors.schema[first].dataType.simpleString()
    return vectors.select(first, F.col(second).cast("array<float>").alias(second)).mapInArrow(run, f"{first} {kind}, {second} array<float>, cell int")


#: Vectors of a cell and queries that probe it that one task scores at a time; larger cells are cut into such pieces.
CELL_ROWS, CELL_QUERIES = 20_000, 50_000


def top_k_indexed(vectors: DataFrame, queries: DataFrame, cells: Cells, k: int = 10, threshold: float = 0.7, probes: int = 16) -> DataFrame:
    """The same rows as ``top_k`` but for neighbours outside each query's ``probes`` nearest cells (the tests measure the recall).

    Every vector lies in its nearest cell. Vectors are scanned and shuffled once for all queries, which go to the
    pieces of the cells they probe; a cell that holds very many vectors is cut into pieces of about ``CELL_ROWS``,
    its queries into such of ``CELL_QUERIES``, and each piece meets each.
    """
    first, second = vectors.columns[:2]
    n_cells = len(cells.centres)

    def pieces_of(rows: DataFrame, most: int) -> Column:
        sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
        return F.create_map(*[F.lit(x) for c in range(n_cells) for x in (c, max(1, -(-sizes.get(c, 1) // most)))])[F.col("cell")]

    a = _celled(vectors.select(first, second), cells, 1)
    b = _celled(queries.select(F.col(queries.columns[0]).alias("query_id"), F.col(queries.columns[1]).alias("_q")), cells, min(probes, n_cells))
    parts, blocks = pieces_of(a, CELL_ROWS), pieces_of(b, CELL_QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    a = a.withColumn("piece", F.pmod(F.xxhash64(first), parts)).withColumn("block", every(blocks))
    b = b.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks)).withColumn("piece", every(parts))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        unit = lambda t, c: _unit(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1))
        m, ids, query_ids = unit(left, second), left.column(first).to_numpy(), right.column("query_id").to_numpy()
        out = []
        for at in range(0, right.num_rows, QUERY_BLOCK):
            part = right.slice(at, QUERY_BLOCK)
            sim = np.round(np.clip((1 + unit(part, "_q") @ m.T) / 2, 0, 1), 6)
            order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
            row = np.repeat(np.arange(len(sim)), order.shape[1])
            col = order.ravel()
            keep = sim[row, col] >= threshold
            out.append(pa.table({"query_id": pa.array(query_ids[at : at + len(sim)][row[keep]], pa.int64()), "vec_id": pa.array(ids[col[keep]], pa.int64()), "similarity": pa.array(sim[row[keep], col[keep]])}))
        return pa.concat_tables(out) if out else empty

    by = ("cell", "piece", "block")
    found = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(score, "query_id long, vec_id long, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
