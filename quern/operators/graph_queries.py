"""Graph queries, with their SQL.

The star schema is the property graph: regions contain nations, nations contain customers, customers
define orders, orders import parts, parts reference suppliers, suppliers call nations, nations call
regions. Architecture queries run over the files of the repositories. Start sets are all nodes of a kind
whose key is divisible by 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import posix
from quern.operators import graph as G
from quern.tables import spread, table


def _id(label: str, c) -> F.Column:
    return F.concat(F.lit(label + ":"), F.col(c).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, label: str, key: str, repo) -> DataFrame:
        return table(spark, d, name).select(_id(label, key).alias("id"), F.lit(label).alias("label"), repo.alias("repository"))

    none = F.lit(None).cast("string")
    out = of("region", "Region", "r_regionkey", none)
    for x in (
        of("nation", "Nation", "n_nationkey", none),
        of("customer", "Customer", "c_custkey", F.col("c_mktsegment")),
        of("supplier", "Supplier", "s_suppkey", none),
        of("orders", "Order", "o_orderkey", F.col("o_orderpriority")),
        of("part", "Part", "p_partkey", F.col("p_brand")),
    ):
        out = out.unionByName(x)
    return out


def edges(spark: SparkSession, d: str, *types: str, unique: bool = True) -> DataFrame:
    """All edges, or those of some types (other tables are then not read); not each once for operators that fold what they find anyway."""
    n = table(spark, d, "nation")

    def link(df: DataFrame, a: tuple[str, str], b: tuple[str, str], kind: str) -> DataFrame:
        return df.select(_id(*a).alias("src"), _id(*b).alias("dst"), F.lit(kind).alias("type"))

    def lines(a: str, b: str) -> DataFrame:  # numbers are folded, not the names made of them
        rows = spread(table(spark, d, "lineitem", a, b))
        return rows.distinct() if unique else rows

    made = {
        "CONTAINS": lambda: link(n, ("Region", "n_regionkey"), ("Nation", "n_nationkey"), "CONTAINS").unionByName(
            link(table(spark, d, "customer"), ("Nation", "c_nationkey"), ("Customer", "c_custkey"), "CONTAINS")
        ),
        "DEFINES": lambda: link(table(spark, d, "orders"), ("Customer", "o_custkey"), ("Order", "o_orderkey"), "DEFINES"),
        "IMPORTS": lambda: link(lines("l_orderkey", "l_partkey"), ("Order", "l_orderkey"), ("Part", "l_partkey"), "IMPORTS"),
        "REFERENCES": lambda: link(lines("l_partkey", "l_suppkey"), ("Part", "l_partkey"), ("Supplier", "l_suppkey"), "REFERENCES"),
        "CALLS": lambda: link(table(spark, d, "supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "CALLS").unionByName(
            link(n, ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "CALLS")
        ),
    }
    out = None
    for kind in types or made:
        out = made[kind]() if out is None else out.unionByName(made[kind]())
    return out


def _starts(spark: SparkSession, d: str, name: str, label: str, key: str, every: int = 20) -> DataFrame:
    return table(spark, d, name, key).where(F.col(key) % every == 0).select(_id(label, key).alias("id"))


def deps_direct(spark: SparkSession, d: str) -> DataFrame:
    return G.direct(_starts(spark, d, "orders", "Order", "o_orderkey"), edges(spark, d, *G.DEPENDENCY_TYPES, unique=False))


def deps_transitive(spark: SparkSession, d: str) -> DataFrame:
    return G.transitive(_starts(spark, d, "orders", "Order", "o_orderkey"), edges(spark, d, *G.DEPENDENCY_TYPES, unique=False))


def deps_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The relationship types asked for are honoured: parts' REFERENCES only."""
    return G.dependencies(_starts(spark, d, "part", "Part", "p_partkey"), edges(spark, d, "REFERENCES", "CALLS", unique=False), ("REFERENCES",), 3)


def dependents(spark: SparkSession, d: str) -> DataFrame:
    return G.dependents(_starts(spark, d, "part", "Part", "p_partkey"), edges(spark, d, *G.DEPENDENCY_TYPES, unique=False))


def deps_both(spark: SparkSession, d: str) -> DataFrame:
    return G.both_directions(_starts(spark, d, "part", "Part", "p_partkey"), edges(spark, d, *G.DEPENDENCY_TYPES, unique=False))


def impact_score(spark: SparkSession, d: str) -> DataFrame:
    return G.impact(_starts(spark, d, "supplier", "Supplier", "s_suppkey"), edges(spark, d, "IMPORTS", "REFERENCES", unique=False))


def traverse_undirected(spark: SparkSession, d: str) -> DataFrame:
    return G.traverse(_starts(spark, d, "part", "Part", "p_partkey"), edges(spark, d, "IMPORTS", "REFERENCES", unique=False), 2, 50)


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "region", "r_regionkey").select(_id("Region", "r_regionkey").alias("id"))
    found = G.shortest_paths(_starts(spark, d, "orders", "Order", "o_orderkey"), regions, edges(spark, d, *G.DEPENDENCY_TYPES, unique=False))
    return found.select("start", "target", "hops", F.array_join("path", ">").alias("path"), F.array_join("types", ">").alias("types"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_inputs", "repository", "path").select("repository", posix(F.col("path")).alias("path")).distinct()


def arch_packages(spark: SparkSession, d: str) -> DataFrame:
    return G.architecture(_files(spark, d), "packages")


def arch_modules(spark: SparkSession, d: str) -> DataFrame:
    return G.architecture(_files(spark, d), "modules", "src/")


def arch_files(spark: SparkSession, d: str) -> DataFrame:
    return G.architecture(_files(spark, d), "files")


def arch_entities(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the orders they define, kept without any."""
    c = table(spark, d, "customer", "c_custkey").select(_id("Customer", "c_custkey").alias("id"))
    return G.entities(c, edges(spark, d, "DEFINES"))


def arch_rollup(spark: SparkSession, d: str) -> DataFrame:
    return G.architecture_rollup(_files(spark, d).where("repository is not null"))


def arch_tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.tree_nodes(_files(spark, d).where("repository is not null"))


def module_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Brands that depend on suppliers' nations."""
    part = table(spark, d, "part", "p_partkey", "p_brand").select(_id("Part", "p_partkey").alias("id"), F.col("p_brand").alias("module"))
    supp = table(spark, d, "supplier", "s_suppkey", "s_nationkey").select(_id("Supplier", "s_suppkey").alias("id"), _id("Nation", "s_nationkey").alias("module"))
    return G.module_dependencies(edges(spark, d, "REFERENCES"), part.unionByName(supp))


def context_expand(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers stand for documents in turn: a third of either kind has a document's extension."""
    seeds = _starts(spark, d, "supplier", "Supplier", "s_suppkey").unionByName(_starts(spark, d, "orders", "Order", "o_orderkey")).unionByName(_starts(spark, d, "part", "Part", "p_partkey"))
    key = F.substring_index("id", ":", -1).cast("long")
    kinds = nodes(spark, d).withColumn("extension", F.when(key % 3 == 0, "md").when(key % 3 == 1, "rst").otherwise("ts"))
    return G.expand_context(seeds, kinds, edges(spark, d, unique=False))


def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.counts(nodes(spark, d), edges(spark, d))


def graph_compare(spark: SparkSession, d: str) -> DataFrame:
    """The graph against its copy without customers 1 to 100 and what touches them."""
    n, e = nodes(spark, d), edges(spark, d)
    gone = table(spark, d, "customer", "c_custkey").where("c_custkey <= 100").select(_id("Customer", "c_custkey").alias("id"))
    return G.compare((n, e), G.delete_nodes(n, e, gone))


QUERIES = {
    "deps_direct": deps_direct,
    "deps_transitive": deps_transitive,
    "deps_by_type": deps_by_type,
    "dependents": dependents,
    "deps_both": deps_both,
    "impact_score": impact_score,
    "traverse_undirected": traverse_undirected,
    "shortest_path": shortest_path,
    "arch_packages": arch_packages,
    "arch_modules": arch_modules,
    "arch_files": arch_files,
    "arch_entities": arch_entities,
    "arch_rollup": arch_rollup,
    "arch_tree_nodes": arch_tree_nodes,
    "module_dependencies": module_dependencies,
    "context_expand": context_expand,
    "graph_counts": graph_counts,
    "graph_compare": graph_compare,
}

_EDGES = """edges AS (
  SELECT 'Region:' || n_regionkey AS src, 'Nation:' || n_nationkey AS dst, 'CONTAINS' AS type FROM nation
  UNION ALL SELECT 'Nation:' || c_nationkey, 'Customer:' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'Customer:' || o_custkey, 'Order:' || o_orderkey, 'DEFINES' FROM orders
  UNION ALL SELECT DISTINCT 'Order:' || l_orderkey, 'Part:' || l_partkey, 'IMPORTS' FROM lineitem
  UNION ALL SELECT DISTINCT 'Part:' || l_partkey, 'Supplier:' || l_suppkey, 'REFERENCES' FROM lineitem
  UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'CALLS' FROM supplier
  UNION ALL SELECT 'Nation:' || n_nationkey, 'Region:' || n_regionkey, 'CALLS' FROM nation)"""
_DEP = "('IMPORTS', 'CALLS', 'REFERENCES')"
_ORDERS = "(SELECT 'Order:' || o_orderkey AS id FROM orders WHERE o_orderkey % 20 = 0)"
_PARTS = "(SELECT 'Part:' || p_partkey AS id FROM part WHERE p_partkey % 20 = 0)"
_SUPPLIERS = "(SELECT 'Supplier:' || s_suppkey AS id FROM supplier WHERE s_suppkey % 20 = 0)"


def _reach(starts: str, src: str, dst: str, types: str, depth: int) -> str:
    """Level by level as plain joins, so that walks are folded at each level."""
    out = [_EDGES, f"l AS (SELECT DISTINCT {src} AS a, {dst} AS b FROM edges WHERE type IN {types})", f"r0 AS (SELECT id AS start, id AS node, 0 AS depth FROM {starts})"]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT start, node FROM r{k}" for k in range(i))
        out.append(f"r{i} AS (SELECT DISTINCT start, b AS node, {i} AS depth FROM r{i - 1} JOIN l ON node = a WHERE (start, b) NOT IN ({seen}))")
    out.append("reach AS (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(1, depth + 1)) + ")")
    return "WITH " + ",\n".join(out)


_FIRST = f"list_position(['IMPORTS', 'CALLS', 'REFERENCES'], type)"
_FILES = r"files AS (SELECT DISTINCT repository, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path FROM file_inputs)"
_NODES = """nodes AS (SELECT 'Region:' || r_regionkey AS id, 'Region' AS label FROM region UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation' FROM nation
  UNION ALL SELECT 'Customer:' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier' FROM supplier
  UNION ALL SELECT 'Order:' || o_orderkey, 'Order' FROM orders UNION ALL SELECT 'Part:' || p_partkey, 'Part' FROM part)"""

SQL = {
    "deps_direct": f"""WITH {_EDGES} SELECT s.id AS start, e.dst AS node, arg_min(e.type, {_FIRST}) AS type FROM {_ORDERS} s JOIN edges e ON e.src = s.id WHERE e.type IN {_DEP} GROUP BY 1, 2""",
    "deps_transitive": _reach(_ORDERS, "src", "dst", _DEP, 5) + " SELECT start, node, 'REFERENCES' AS type, CAST(depth AS INTEGER) AS depth FROM reach WHERE depth > 1",
    "deps_by_type": _reach(_PARTS, "src", "dst", "('REFERENCES')", 3) + " SELECT start, node, 'REFERENCES' AS type, CAST(depth AS INTEGER) AS depth FROM reach",
    "dependents": f"""WITH {_EDGES} SELECT s.id AS start, e.src AS node, arg_min(e.type, {_FIRST}) AS type, CAST(1 AS INTEGER) AS depth FROM {_PARTS} s JOIN edges e ON e.dst = s.id WHERE e.type IN {_DEP} GROUP BY 1, 2""",
    "deps_both": f"""WITH {_EDGES}, both_ways AS (SELECT src AS a, dst AS b, type FROM edges WHERE type IN {_DEP} UNION ALL SELECT dst, src, type FROM edges WHERE type IN {_DEP})
SELECT s.id AS start, b AS node, arg_min(type, {_FIRST}) AS type FROM {_PARTS} s JOIN both_ways ON a = s.id GROUP BY 1, 2""",
    "impact_score": _reach(_SUPPLIERS, "dst", "src", "('IMPORTS', 'REFERENCES')", 5)
    + f""" SELECT s.id AS start, count(*) FILTER (WHERE depth = 1) AS n_direct, count(*) FILTER (WHERE depth > 1) AS n_transitive,
  least(1.0::DOUBLE, count(r.node)::DOUBLE / 100) AS score FROM {_SUPPLIERS} s LEFT JOIN reach r ON r.start = s.id GROUP BY s.id""",
    "traverse_undirected": f"""WITH {_EDGES}, l AS (SELECT DISTINCT * FROM (SELECT src AS a, dst AS b FROM edges WHERE type IN ('IMPORTS', 'REFERENCES') UNION ALL SELECT dst, src FROM edges WHERE type IN ('IMPORTS', 'REFERENCES'))),
r1 AS (SELECT DISTINCT s.id AS start, b AS node, 1 AS depth FROM {_PARTS} s JOIN l ON a = s.id WHERE b <> s.id),
r2 AS (SELECT DISTINCT start, b AS node, 2 AS depth FROM r1 JOIN l ON a = node WHERE b <> start AND (start, b) NOT IN (SELECT start, node FROM r1))
SELECT start, node, CAST(depth AS INTEGER) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, node) AS r FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2)) WHERE r <= 50""",
    "shortest_path": f"""WITH RECURSIVE {_EDGES}, l AS (SELECT src, dst, min(type) AS type FROM edges WHERE type IN {_DEP} GROUP BY 1, 2),
w AS (SELECT id AS start, id AS node, id AS path, '' AS types, 0 AS hops FROM {_ORDERS}
  UNION ALL SELECT start, dst, path || '>' || dst, types || (CASE WHEN hops > 0 THEN '>' ELSE '' END) || type, hops + 1 FROM w JOIN l ON src = node WHERE hops < 5)
SELECT start, node AS target, CAST(hops AS INTEGER) AS hops, path, types FROM (
  SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY hops, string_split(path, '>')) AS r FROM w WHERE node LIKE 'Region:%') WHERE r = 1""",
    "arch_packages": f"WITH {_FILES} SELECT repository, string_split(path, '/')[1] AS package, count(*) AS n_files FROM files GROUP BY 1, 2",
    "arch_modules": f"""WITH {_FILES} SELECT repository, string_split(path, '/')[1] AS package, string_split(path, '/')[2] AS module, count(*) AS n_files FROM files
WHERE path LIKE 'src/%' AND len(string_split(path, '/')) >= 2 GROUP BY 1, 2, 3""",
    "arch_files": rf"WITH {_FILES} SELECT repository, path, regexp_extract(path, '[^/]\.([^./]*)$', 1) AS extension FROM files",
    "arch_entities": "SELECT 'Customer:' || c_custkey AS id, count(o_orderkey) AS n_entities FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "arch_rollup": f"""WITH {_FILES} SELECT repository, package, module, count(*) AS n_files, CAST(grouping(repository, package, module) AS BIGINT) AS level FROM (
  SELECT repository, string_split(path, '/')[1] AS package, CASE WHEN len(string_split(path, '/')) >= 2 THEN string_split(path, '/')[2] ELSE '' END AS module FROM files WHERE repository IS NOT NULL)
GROUP BY ROLLUP (repository, package, module)""",
    "arch_tree_nodes": f"""WITH {_FILES}, s AS (SELECT repository, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS depth FROM files WHERE repository IS NOT NULL)
SELECT repository, array_to_string(p[1:depth], '/') AS path, CASE WHEN depth > 1 THEN array_to_string(p[1:depth - 1], '/') END AS parent, CAST(depth AS INTEGER) AS depth,
  CASE WHEN depth = 1 THEN (CASE WHEN depth = len(p) THEN 'file' ELSE 'package' END) WHEN depth = len(p) THEN 'file' WHEN depth = 2 THEN 'module' ELSE 'folder' END AS kind, count(*) AS n_files
FROM s GROUP BY 1, 2, 3, 4, 5""",
    "module_dependencies": """SELECT p_brand AS module, 'Nation:' || s_nationkey AS depends_on, count(*) AS n, 'REFERENCES' AS types
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""",
    "context_expand": f"""WITH {_EDGES}, seeds AS (SELECT id AS seed FROM {_SUPPLIERS} UNION ALL SELECT id FROM {_ORDERS} UNION ALL SELECT id FROM {_PARTS}),
u AS (SELECT seed, dst AS node, 1 AS r, 'imports' AS context FROM seeds JOIN edges ON src = seed WHERE type = 'IMPORTS'
  UNION ALL SELECT seed, src, 2, 'callers' FROM seeds JOIN edges ON dst = seed WHERE type = 'CALLS'
  UNION ALL SELECT seed, dst, 3, 'callees' FROM seeds JOIN edges ON src = seed WHERE type = 'CALLS'
  UNION ALL SELECT seed, b.dst, 4, 'siblings' FROM seeds JOIN edges a ON a.dst = seed AND a.type IN ('CONTAINS', 'DEFINES') JOIN edges b ON b.src = a.src AND b.type IN ('CONTAINS', 'DEFINES') WHERE b.dst <> seed
  UNION ALL SELECT seed, dst, 5, 'documentation' FROM seeds JOIN edges ON src = seed WHERE type = 'REFERENCES' AND CAST(string_split(dst, ':')[2] AS BIGINT) % 3 < 2),
once AS (SELECT seed, node, min(r) AS r, arg_min(context, r) AS context FROM u GROUP BY 1, 2)
SELECT seed, node, context, 0.8::DOUBLE AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY r, node) AS n FROM once) WHERE n <= 20""",
    "graph_counts": f"WITH {_EDGES}, {_NODES} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type",
    "graph_compare": f"""WITH {_EDGES}, {_NODES}, gone AS (SELECT 'Customer:' || c_custkey AS id FROM customer WHERE c_custkey <= 100)
SELECT kind, name, n_left, n_right, n_left = n_right AS same FROM (
  SELECT 'node' AS kind, label AS name, count(*) AS n_left, count(*) FILTER (WHERE id NOT IN (SELECT id FROM gone)) AS n_right FROM nodes GROUP BY label
  UNION ALL SELECT 'edge', type, count(*), count(*) FILTER (WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) FROM edges GROUP BY type)""",
}
