"""Property-graph queries over node and edge DataFrames.

Nodes are (id, label, ...), edges (src, dst, type). Traversals expand a frontier level by level for all
start nodes at once: a level is one equi-join with the edges followed by a fold to one row per start and
node, so hubs cost their degree once and cycles end at nodes already seen. Depth is the least number of
hops. The edges and each level go through the checkpoint folder, so none is computed twice,
and the search ends with the first empty level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import maintenance as M
from quern.session import checkpointed

#: Edge types that make a dependency, in the order that settles ties.
DEPENDENCY_TYPES = ("IMPORTS", "CALLS", "REFERENCES")
#: Hops searched at most, as in the tools' interface.
MAX_HOPS = 5


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")


def _of_types(edges: DataFrame, types: Sequence[str]) -> DataFrame:
    return edges.where(F.col("type").isin(*types)).select("src", "dst", "type")


def _order(types: Sequence[str]) -> Column:
    c = F.lit(len(types))
    for i, t in reversed(list(enumerate(types))):
        c = F.when(F.col("type") == t, i).otherwise(c)
    return c


def direct(starts: DataFrame, edges: DataFrame, types: Sequence[str] = DEPENDENCY_TYPES) -> DataFrame:
    """(start, node, type): direct dependencies, one row a node with the first of its edge types; loops stay."""
    hit = starts.select(F.col("id").alias("start")).join(_of_types(edges, types), F.col("start") == F.col("src"))
    return hit.groupBy("start", F.col("dst").alias("node")).agg(F.min_by("type", _order(types)).alias("type"))


def _least(df: DataFrame, by: str, what: str, n: int) -> DataFrame:
    """The n least rows of each group; all but n a group drop out before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(what))).where(F.col("_r") <= n).drop("_r")


def reach(starts: DataFrame, edges: DataFrame, types: Sequence[str] | None = DEPENDENCY_TYPES, depth: int = MAX_HOPS, limit: int | None = None) -> DataFrame:
    """(start, node, depth): nodes within ``depth`` hops of each start, with the least depth; the start itself is left out.

    ``types`` None means all. With ``limit`` only the first nodes of each start by (depth, node) are found,
    exactly: a start goes no further once it has them, and no node hands on more neighbours than could count,
    so neither a hub nor a dense neighbourhood is expanded whole.
    """
    depth = min(depth, MAX_HOPS)
    links = (edges if types is None else _of_types(edges, types)).select("src", "dst")
    if limit is not None:  # of a node's neighbours, those seen before (limit a level, and the start) and the next ones
        links = _least(links.distinct(), "src", "dst", limit * (depth + 1) + 1)
    links = checkpointed(links) if depth > 1 else links
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    seen = frontier
    out = None
    for level in range(1, depth + 1):
        step = frontier.join(links, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        if limit is not None:
            step = _least(step, "start", "node", limit)
        if level < depth or level == 1:
            step = checkpointed(step)
            if out is not None and step.isEmpty():
                break
        found = step.withColumn("depth", F.lit(level))
        out = found if out is None else out.unionByName(found)
        if level < depth:
            seen = seen.unionByName(step)
            frontier = step
            if limit is not None:
                full = out.groupBy("start").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= limit)
                frontier = step.join(full, "start", "left_anti")
    if limit is not None:
        w = Window.partitionBy("start").orderBy("depth", "node")
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    return out


def transitive(starts: DataFrame, edges: DataFrame, types: Sequence[str] = DEPENDENCY_TYPES, depth: int = MAX_HOPS) -> DataFrame:
    """(start, node, type, depth): dependencies of two hops and more that are not direct; type REFERENCES."""
    return reach(starts, edges, types, depth).where(F.col("depth") > 1).select("start", "node", F.lit("REFERENCES").alias("type"), "depth")


def dependencies(starts: DataFrame, edges: DataFrame, types: Sequence[str] = DEPENDENCY_TYPES, depth: int = 1) -> DataFrame:
    """Direct dependencies, with the transitive ones if ``depth`` is above one."""
    found = direct(starts, edges, types).withColumn("depth", F.lit(1))
    return found if depth <= 1 else found.unionByName(transitive(starts, edges, types, depth))


def dependents(starts: DataFrame, edges: DataFrame, types: Sequence[str] = DEPENDENCY_TYPES, depth: int = 1) -> DataFrame:
    return dependencies(starts, reverse(edges), types, depth)


def both_directions(starts: DataFrame, edges: DataFrame, types: Sequence[str] = DEPENDENCY_TYPES) -> DataFrame:
    """Direct dependencies and dependents in one, each node once."""
    links = _of_types(edges, types)
    return direct(starts, links.unionByName(reverse(links)), types)


def impact(starts: DataFrame, edges: DataFrame, types: Sequence[str] = DEPENDENCY_TYPES, depth: int = MAX_HOPS) -> DataFrame:
    """(start, n_direct, n_transitive, score): how much depends on each given start; score = min(1, n / 100).

    The counts are exact, so every (start, dependent) pair is made once: meant for a set of starts that was
    chosen. For the scores of all nodes see ``impact_scores``.
    """
    found = reach(starts, reverse(edges), types, depth)
    counts = found.groupBy("start").agg(F.count_if(F.col("depth") == 1).alias("n_direct"), F.count_if(F.col("depth") > 1).alias("n_transitive"))
    n = F.coalesce("n_direct", F.lit(0)) + F.coalesce("n_transitive", F.lit(0))
    return (
        starts.select(F.col("id").alias("start")).distinct().join(counts, "start", "left")
        .select("start", F.coalesce("n_direct", F.lit(0)).alias("n_direct"), F.coalesce("n_transitive", F.lit(0)).alias("n_transitive"), F.least(F.lit(1.0), n / FULL_IMPACT).alias("score"))
    )


#: So many dependents give the score 1.
FULL_IMPACT = 100


def impact_scores(starts: DataFrame, edges: DataFrame, types: Sequence[str] = DEPENDENCY_TYPES, depth: int = MAX_HOPS) -> DataFrame:
    """(start, n_direct, score) for any number of starts: the score needs ``FULL_IMPACT`` dependents at most, so none is followed further."""
    links = reverse(_of_types(edges, types))
    found = reach(starts, links, None, depth, FULL_IMPACT).groupBy("start").agg(F.count(F.lit(1)).alias("_n"))
    degree = links.where(F.col("src") != F.col("dst")).groupBy(F.col("src").alias("start")).agg(F.countDistinct("dst").alias("n_direct"))
    s = starts.select(F.col("id").alias("start")).distinct()
    return s.join(found, "start", "left").join(degree, "start", "left").select("start", F.coalesce("n_direct", F.lit(0)).alias("n_direct"), (F.coalesce("_n", F.lit(0)) / FULL_IMPACT).alias("score"))


def traverse(starts: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 100) -> DataFrame:
    """(start, node, depth): the undirected neighbourhood, at most ``limit`` nodes a start by (depth, id); the limit bounds every level."""
    links = edges.select("src", "dst", "type")
    return reach(starts, links.unionByName(reverse(links)), None, depth, min(limit, 1000))


def shortest_paths(starts: DataFrame, targets: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(start, target, hops, path, types): a directed shortest path, the least by its nodes, with each hop's edge type.

    Per start and node only the least path of a level goes on.
    """
    links = checkpointed(edges.groupBy("src", "dst").agg(F.min("type").alias("type")))
    wanted = targets.select(F.col("id").alias("target")).distinct()
    none = F.array().cast("array<string>")
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"), none.alias("types")).distinct()
    seen = frontier.select("start", "node")
    reached = frontier
    for level in range(1, min(max_hops, 20) + 1):
        step = (
            frontier.withColumnRenamed("node", "src")
            .join(links, "src")
            .withColumnRenamed("dst", "node")
            .join(seen, ["start", "node"], "left_anti")
            .groupBy("start", "node")
            .agg(F.min(F.struct(F.concat("path", F.array("node")).alias("path"), F.concat("types", F.array("type")).alias("types"))).alias("best"))
            .select("start", "node", "best.path", "best.types")
        )
        step = checkpointed(step)
        if step.isEmpty():
            break
        reached = reached.unionByName(step)
        seen = seen.unionByName(step.select("start", "node"))
        frontier = step
    return reached.join(wanted, F.col("node") == F.col("target")).select("start", "target", F.size("types").alias("hops"), "path", "types")


def architecture(files: DataFrame, level: str, scope: str | None = None) -> DataFrame:
    """Files (repository, path) rolled up: ``packages``, ``modules`` or the list of ``files``; for entities see ``entities``."""
    if level not in ("packages", "modules", "files"):
        raise ValueError(f"no level {level} of files")
    df = files.where(F.col("path").startswith(scope)) if scope else files
    parts = F.split("path", "/")
    if level == "packages":
        return df.groupBy("repository", parts[0].alias("package")).agg(F.count(F.lit(1)).alias("n_files"))
    if level == "modules":
        return df.where(F.size(parts) >= 2).groupBy("repository", parts[0].alias("package"), parts[1].alias("module")).agg(F.count(F.lit(1)).alias("n_files"))
    return df.select("repository", "path", F.regexp_extract("path", r"[^/]\.([^./]*)$", 1).alias("extension")).distinct()


def entities(owners: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_entities): what each owner (id) defines, counted; owners without any stay."""
    n = _of_types(edges, ("DEFINES",)).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return owners.select("id").distinct().join(n, "id", "left").select("id", F.coalesce("_n", F.lit(0)).alias("n_entities"))


def architecture_rollup(files: DataFrame) -> DataFrame:
    """All levels at once: totals per repository, package and module; null stands for all."""
    parts = F.split("path", "/")
    df = files.select("repository", parts[0].alias("package"), F.when(F.size(parts) >= 2, parts[1]).otherwise("").alias("module"))
    return df.rollup("repository", "package", "module").agg(F.count(F.lit(1)).alias("n_files"), F.grouping_id().cast("long").alias("level"))


def tree_nodes(files: DataFrame) -> DataFrame:
    """(repository, path, parent, depth, kind, n_files): every folder and file once, made from path prefixes."""
    parts = F.split("path", "/")
    spread = files.select("repository", parts.alias("p")).distinct().select("repository", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    node = F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/")
    parent = F.when(F.col("depth") > 1, F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), "/"))
    leaf = F.col("depth") == F.size("p")
    kind = F.when(F.col("depth") == 1, F.when(leaf, "file").otherwise("package")).when(leaf, "file").when(F.col("depth") == 2, "module").otherwise("folder")
    return spread.groupBy("repository", node.alias("path"), parent.alias("parent"), "depth", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_files"))


def module_dependencies(edges: DataFrame, module_of: DataFrame) -> DataFrame:
    """(module, depends_on, n, types): edges between different modules; ``module_of`` is (id, module)."""
    a, b = module_of.select(F.col("id").alias("src"), F.col("module")), module_of.select(F.col("id").alias("dst"), F.col("module").alias("depends_on"))
    return (
        edges.join(a, "src").join(b, "dst").where(F.col("module") != F.col("depends_on"))
        .groupBy("module", "depends_on")
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
    )


CONTEXTS = ("imports", "callers", "callees", "siblings", "documentation")


def expand_context(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(seed, node, context, relevance): what surrounds each seed, each node once, in the order of contexts, then id."""
    s = seeds.select(F.col("id").alias("seed"))
    up = _of_types(edges, ("CONTAINS", "DEFINES"))

    def out_of(types: Sequence[str], context: str) -> DataFrame:
        return s.join(_of_types(edges, types), F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node"), F.lit(context).alias("context"))

    limit = min(limit, 100)
    parents = s.join(up, F.col("seed") == F.col("dst")).select("seed", F.col("src").alias("parent")).distinct()
    # beside the seed itself and nodes of earlier contexts no more than the limit can count of one parent's children
    children = _least(up.join(parents.select(F.col("parent").alias("src")).distinct(), "src", "left_semi").select("src", "dst").distinct(), "src", "dst", limit + 1)
    siblings = parents.join(children, F.col("parent") == F.col("src")).where(F.col("dst") != F.col("seed")).select("seed", F.col("dst").alias("node"), F.lit("siblings").alias("context"))
    callers = s.join(_of_types(edges, ("CALLS",)), F.col("seed") == F.col("dst")).select("seed", F.col("src").alias("node"), F.lit("callers").alias("context"))
    docs = out_of(("REFERENCES",), "documentation").join(nodes.where(F.col("extension").isin("md", "txt", "rst")).select(F.col("id").alias("node")), "node", "left_semi")
    union = out_of(("IMPORTS",), "imports").unionByName(callers).unionByName(out_of(("CALLS",), "callees")).unionByName(siblings).unionByName(docs.select("seed", "node", "context"))
    rank = F.array_position(F.lit(list(CONTEXTS)), F.col("context"))
    once = union.groupBy("seed", "node").agg(F.min(F.struct(rank.alias("r"), "context")).alias("c")).select("seed", "node", "c.r", "c.context")
    w = Window.partitionBy("seed").orderBy("r", "node")
    return once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("seed", "node", "context", F.lit(0.8).alias("relevance"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by label, edges by type."""
    a = nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    b = edges.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    return a.unionByName(b)


def compare(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, name, n_left, n_right, same): counts of two copies of a graph side by side."""
    a, b = counts(*left).withColumnRenamed("n", "n_left"), counts(*right).withColumnRenamed("n", "n_right")
    j = a.join(b, ["kind", "name"], "full")
    return j.select("kind", "name", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"), F.col("n_left").eqNullSafe(F.col("n_right")).alias("same"))


# Writes: a graph is a pair of DataFrames, each write gives new ones.


def upsert_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with changed ones put in place of those with their id; of several changes the last by ``_seq`` wins, without one the greatest row."""
    once = M.fold(changes, ["id"], "_seq" if "_seq" in changes.columns else None).drop("_seq")
    return nodes.join(once.select("id"), "id", "left_anti").unionByName(once, allowMissingColumns=True)


def merge_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with new ones, each (src, dst, type) once."""
    return edges.unionByName(changes, allowMissingColumns=True).dropDuplicates(["src", "dst", "type"])


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without some nodes and all edges that touch them."""
    ids = gone.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept.select(*edges.columns)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those listed by (src, dst, type)."""
    return edges.join(gone.select("src", "dst", "type").distinct(), ["src", "dst", "type"], "left_anti").select(*edges.columns)


def delete_file(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the files (repository, path) and all that lies in them."""
    return delete_nodes(nodes, edges, nodes.join(files.select("repository", "path").distinct(), ["repository", "path"], "left_semi").select("id"))


def replace_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, fresh: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The graph after some files (repository, path) were parsed again: what was in them goes, ``fresh`` nodes and edges come in."""
    n, e = delete_file(nodes, edges, files)
    return upsert_nodes(n, fresh[0]), merge_edges(e, fresh[1])


def removed(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, name, n): how many nodes and edges of each label and type a delete took away."""
    c = compare(before, after)
    return c.where(~F.col("same")).select("kind", "name", (F.col("n_left") - F.col("n_right")).alias("n"))


def symbol_index(nodes: DataFrame) -> DataFrame:
    """(repository, name, id, label): each name's first node, functions before classes before modules, then by id."""
    rank = F.when(F.col("label") == "Function", 0).when(F.col("label") == "Class", 1).when(F.col("label") == "Module", 2)
    best = F.min(F.struct(rank.alias("r"), "id", "label")).alias("_b")
    return nodes.where(rank.isNotNull() & F.col("name").isNotNull()).groupBy("repository", "name").agg(best).select("repository", "name", "_b.id", "_b.label")


def imported(nodes: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """A graph of another store: nodes and edges with ids behind its name, so that two stores never meet, and the old id as ``_source_id``."""
    at = lambda c: F.concat(F.lit(f"{source}:"), F.col(c))
    return nodes.withColumn("_source_id", F.col("id")).withColumn("id", at("id")), edges.withColumns({"src": at("src"), "dst": at("dst")})


def delete_repository(nodes: DataFrame, edges: DataFrame, repository: str) -> tuple[DataFrame, DataFrame]:
    """The graph without a repository; modules go only when no other repository refers to them."""
    mine = nodes.where(F.col("repository") == repository).select("id")
    n, e = delete_nodes(nodes, edges, mine)
    touched = edges.join(mine.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    used = e.select(F.col("dst").alias("id")).distinct()
    orphaned = n.where(F.col("label") == "Module").join(touched, "id", "left_semi").join(used, "id", "left_anti").select("id")
    return n.join(orphaned, "id", "left_anti"), e
