import random

import pytest
from pyspark.sql import functions as F

from quern.operators import codegraph as C
from quern.operators import graph as G


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("a", "b", "IMPORTS"), ("b", "c", "CALLS"), ("c", "a", "IMPORTS"), ("c", "d", "REFERENCES"), ("a", "a", "CALLS"), ("x", "a", "CONTAINS"), ("x", "b", "CONTAINS")]
    return spark.createDataFrame(rows, "src string, dst string, type string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_cycles_and_depth(spark, edges):
    got = {(r.node, r.depth) for r in G.reach(ids(spark, "a"), edges).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}
    assert {(r.node, r.type) for r in G.direct(ids(spark, "a"), edges).collect()} == {("b", "IMPORTS"), ("a", "CALLS")}
    assert {r.node for r in G.dependencies(ids(spark, "a"), edges, ("IMPORTS",), 3).collect()} == {"b"}
    assert {(r.start, r.n_direct, r.n_transitive) for r in G.impact(ids(spark, "d", "zz"), edges).collect()} == {("d", 1, 2), ("zz", 0, 0)}


def test_paths(spark, edges):
    r = G.shortest_paths(ids(spark, "a"), ids(spark, "d", "a"), edges).collect()
    assert {(x.target, tuple(x.path), tuple(x.types)) for x in r} == {("d", ("a", "b", "c", "d"), ("IMPORTS", "CALLS", "REFERENCES")), ("a", ("a",), ())}
    assert G.shortest_paths(ids(spark, "d"), ids(spark, "a"), edges).count() == 0


def test_limits_inside_the_levels_are_exact(spark):
    rng = random.Random(3)
    rows = {(f"n{rng.randint(0, 60):02}", f"n{rng.randint(0, 60):02}", "IMPORTS") for _ in range(150)} | {("n00", f"n{i:02}", "IMPORTS") for i in range(1, 55)}
    df = spark.createDataFrame(sorted(rows), "src string, dst string, type string")
    starts = ids(spark, *[f"n{i:02}" for i in range(0, 60, 5)])
    every = {}
    for r in sorted(G.reach(starts, df, None, 3).collect(), key=lambda r: (r.start, r.depth, r.node)):
        every.setdefault(r.start, []).append((r.node, r.depth))
    for limit in (1, 4, 11):
        got = {}
        for r in sorted(G.reach(starts, df, None, 3, limit).collect(), key=lambda r: (r.start, r.depth, r.node)):
            got.setdefault(r.start, []).append((r.node, r.depth))
        assert got == {k: v[:limit] for k, v in every.items()}
    exact = {r.start: (r.n_direct, r.score) for r in G.impact(starts, df, ("IMPORTS",)).collect()}
    assert exact == {r.start: (r.n_direct, r.score) for r in G.impact_scores(starts, df, ("IMPORTS",)).collect()}


def test_context_and_writes(spark, edges):
    nodes = spark.createDataFrame([(n, "File", "r", "md") for n in "abcdx"] + [("m", "Module", None, None)], "id string, label string, repository string, extension string")
    ctx = {(r.node, r.context) for r in G.expand_context(ids(spark, "a"), nodes, edges).collect()}
    assert ctx == {("b", "imports"), ("a", "callers")}
    n, e = G.delete_nodes(nodes, edges, ids(spark, "a"))
    assert n.count() == 5 and e.where("src = 'a' or dst = 'a'").count() == 0
    assert G.merge_edges(edges, edges).count() == edges.count()
    up = G.upsert_nodes(nodes, spark.createDataFrame([("a", "Class", "r", 1), ("a", "Enum", "r", 2)], "id string, label string, repository string, _seq int"))
    assert [r.label for r in up.where("id = 'a'").collect()] == ["Enum"]
    twice = G.upsert_nodes(nodes, spark.createDataFrame([("a", "Class", "r"), ("a", "Enum", "r")], "id string, label string, repository string"))
    assert [r.label for r in twice.where("id = 'a'").collect()] == ["Enum"]
    docs = nodes.withColumn("extension", F.when(F.col("id") == "d", "md").otherwise("ts"))
    ctx = {(r.node, r.context) for r in G.expand_context(ids(spark, "c"), docs, edges.union(spark.createDataFrame([("c", "x", "REFERENCES")], edges.schema))).collect()}
    assert ("d", "documentation") in ctx and "x" not in {n for n, _ in ctx}
    with pytest.raises(ValueError):
        G.architecture(nodes, "entities")
    both = spark.createDataFrame([("a", "m", "IMPORTS"), ("q", "m", "IMPORTS")], "src string, dst string, type string")
    kept, _ = G.delete_repository(nodes, both, "r")
    assert [r.id for r in kept.collect()] == ["m"]
    kept, _ = G.delete_repository(nodes, both.where("src = 'a'"), "r")
    assert kept.count() == 0


TS = """import d, { a as b, type T } from "./util.js";
import * as ns from "pkg";
import "side";
export { q } from "./q";
export default class Foo extends Bar {
  async run(x: string): Promise<void> {
    await b(x);
    // notACall(1)
    this.items.push("fake(2)");
  }
}
export const make = (n: number) => helper(n);
interface Shape { size: number }
export type Alias = string | number;
function helper(n: number) { return n; }
"""


def test_typescript():
    c = C.parse(TS, "typescript")
    assert {(e.kind, e.name, e.exported) for e in c.entities} == {("class", "Foo", True), ("method", "run", False), ("function", "make", True), ("interface", "Shape", False), ("type_alias", "Alias", True), ("function", "helper", False)}
    assert {(s, n, a) for s, n, a, *_ in c.imports} == {("./util.js", "default", "d"), ("./util.js", "a", "b"), ("./util.js", "T", ""), ("pkg", "*", "ns"), ("side", "", "")}
    assert [(n, f, w) for n, _, f, w, _ in c.calls] == [("b", "run", True), ("push", "run", False), ("helper", "make", False)]
    assert ("q", "./q", 4) in c.exports


def test_other_languages():
    py = C.parse("import os.path as p\nfrom .x import y as z\nclass A:\n    async def f(self):\n        await g()\n", "python")
    assert [(e.kind, e.name) for e in py.entities] == [("class", "A"), ("method", "f")] and [i[:3] for i in py.imports] == [("os.path", "path", "p"), (".x", "y", "z")]
    assert py.calls[0][:4] == ("g", "g", "f", True)
    go = C.parse('package p\nimport (\n\t"fmt"\n)\ntype T struct{}\nfunc (t T) Do(a int) { fmt.Println(a) }\nfunc low() {}\n', "go")
    assert {(e.kind, e.name, e.exported) for e in go.entities} == {("class", "T", True), ("method", "Do", True), ("function", "low", False)}
    java = C.parse("package a;\nimport java.util.List;\npublic class A {\n  private int n = 1;\n  public List<String> get(int i) { return make(i); }\n}\n", "java")
    assert {(e.kind, e.name) for e in java.entities} == {("class", "A"), ("property", "n"), ("method", "get")}
    assert C.parse("def (", "python").error and C.parse("x" * (C.MAX_SIZE + 1), "go").error and C.parse(None, "go").error and C.parse("", "cobol").error


def test_recall_on_the_repositories(small):
    """At least 0.9 of the declarations that a plain line search finds in the files are found by the parser."""
    import re

    import pandas as pd

    files = pd.read_parquet(f"{small}/file_inputs.parquet").dropna(subset=["content"])
    found = wanted = 0
    for path, text in zip(files.path, files.content, strict=True):
        if path.lower().endswith((".ts", ".mts", ".js", ".mjs")):
            names = {m for m in re.findall(r"^(?:export )?(?:async )?(?:function\*?|class|interface) (\w+)", text, re.M)}
            got = {e.name for e in C.parse(text, "typescript").entities}
            wanted += len(names)
            found += len(names & got)
    assert wanted and found / wanted >= 0.9


JAVA = """package a.b;
import static x.Y.*;
/** Doc of C. */
@Ann(v = {1, 2})
public final class C<T extends Comparable<? super T>> extends D<T> implements E, F {
  enum K { A(1) { void m() {} }, B; int z; }
  private final Map<String, List<Integer>> m = new HashMap<>();
  public C(int x) { super(x); this.m.put("a", f(1)); }
  public <U> List<U> g(final List<? extends U> l, int... r) throws Ex { for (var i : l) { log.info("x"); } return null; }
  interface Q { void run(String s); }
}
"""


def test_metadata():
    by = {e.name: e for e in C.parse(JAVA, "java").entities}
    c, g = by["C"], by["g"]
    assert (c.extends, c.implements, c.generics, c.doc) == (["D<T>"], ["E", "F"], ["T extends Comparable<? super T>"], "Doc of C.")
    assert (g.owner, g.parameters, g.returns, g.flags) == ("C", [("l", "List<? extends U>"), ("r", "int...")], "List<U>", ["public"])
    assert by["run"].owner == "Q" and by["K"].kind == "enum"
    ts = "abstract class A<T> extends B.C<T> implements D, E<T> {\n  static async run(a: string, cb: (x: number) => void): Promise<void> { }\n}\n/** Adds. */\nexport async function* add(a: number, b = 2): X { }\nconst h = async (x: string) => k(`${deep(1)}`)\n"
    by = {e.name: e for e in C.parse(ts, "typescript").entities}
    assert (by["A"].extends, by["A"].implements, by["A"].flags) == (["B.C<T>"], ["D", "E<T>"], ["abstract"])
    assert (by["run"].parameters, by["run"].returns, by["run"].flags) == ([("a", "string"), ("cb", "(x: number) => void")], "Promise<void>", ["static", "async"])
    assert by["add"].flags == ["async", "generator"] and by["add"].doc == "Adds." and by["h"].parameters == [("x", "string")]
    assert ("deep", "deep", "h", False, 6) in C.parse(ts, "typescript").calls
    go = {e.name: e for e in C.parse("package p\n// S is one.\ntype S[T any] struct {\n\t*E\n\tA int\n}\nfunc (s *S[T]) Do(a, b int, c ...string) error { return nil }\n", "go").entities}
    assert go["S"].extends == ["E"] and go["S"].doc == "S is one." and go["Do"].owner == "S" and go["Do"].parameters == [("a", "int"), ("b", "int"), ("c", "...string")] and go["Do"].returns == "error"
    py = {e.name: e for e in C.parse('class A(B):\n    "Doc."\n    @staticmethod\n    def f(a: int, *b, c=1) -> str:\n        yield 1\n', "python").entities}
    assert py["A"].extends == ["B"] and py["A"].doc == "Doc." and py["f"].parameters == [("a", "int"), ("*b", ""), ("c", "")] and py["f"].flags == ["static", "generator"]


def test_imports_are_read_from_tokens():
    text = "// require('no')\nconst t = `import x from 'no'`;\nconst q = require('yes'), s = 'import y from \"no\"';\nimport('dyn');\n"
    assert [i[:2] for i in C.parse(text, "javascript").imports] == [("yes", "*"), ("dyn", "*")]
    broken = C.parse("export function f() { g(; }\n/* open", "javascript")
    assert broken.error and [e.name for e in broken.entities] == ["f"]


def test_a_file_of_the_greatest_size_is_read_in_linear_time():
    import time

    for text, lang in (("".join(f"export function f{i}(a, b) {{ return g(a) + h({i}); }}\n" for i in range(18_000)), "javascript"), ("fn f() { g(1); }\n" * 60_000, "rust")):
        began = time.perf_counter()
        assert len(C.parse(text[: C.MAX_SIZE], lang).entities) >= 17_000
        assert time.perf_counter() - began < 4


def test_build_graph(spark):
    files = spark.createDataFrame(
        [("r", "src/a.ts", 'import { b } from "./b.js";\nimport x from "ext";\nexport function a() { b(); }\n'), ("r", "src/b.ts", "export function b() {}\n"), ("r", ".\\src\\b.ts", None), (None, "z.py", "x = 1"), ("r", "c.py", None)],
        "repository string, path string, content string",
    )
    _, edges = C.build_graph(files)
    got = {tuple(r) for r in edges.select("src", "dst", "type").collect()}
    assert ("File:r:src/a.ts", "File:r:src/b.ts", "IMPORTS") in got and ("File:r:src/a.ts", "Module:npm:ext", "IMPORTS") in got
    assert ("Function:r:src/a.ts:a:3", "Function:r:src/b.ts:b:1", "CALLS") in got and len([1 for _, d, _ in got if d == "File:r:src/b.ts"]) == 2
    more = spark.createDataFrame([("r", "k.ts", "import { I } from './i.js';\nexport class K extends L<number> implements I { }\nclass L<T> { }\n"), ("r", "i.ts", "export interface I { }\n")], "repository string, path string, content string")
    nodes, edges = C.ingest_files(*C.build_graph(files), more)
    got = {tuple(r) for r in edges.select("src", "dst", "type").collect()}
    assert {("Class:r:k.ts:K:2", "Class:r:k.ts:L:3", "EXTENDS"), ("Class:r:k.ts:K:2", "Class:r:i.ts:I:1", "IMPLEMENTS"), ("File:r:src/a.ts", "File:r:src/b.ts", "IMPORTS")} <= got
    assert G.counts(*C.build_graph(files.limit(0))).count() == 0
