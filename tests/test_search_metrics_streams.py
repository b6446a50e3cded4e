from datetime import datetime as D
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.api import Engine, hashing_embedder
from quern.operators import maintenance as M
from quern.operators import metrics as Met
from quern.operators import vectors as V
from quern.plans import predicates as P
from quern.sources.snapshots import SnapshotTable
from quern.streaming import events as E


def test_exact_search_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)] + [(999, None, 0)], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in V.top_k(df, df.where("vec_id % 20 = 0"), 5, 0.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    f = m.astype(np.float32).astype(float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    for q in range(0, 200, 20):
        sim = np.round((1 + u @ u[q]) / 2, 6)
        assert [v for _, v in sorted(got[q])] == sorted(range(200), key=lambda i: (-sim[i], i))[:5]


def test_search_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    one = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert V.top_k(empty, empty).count() == 0 and V.top_k(one, empty).count() == 0 and V.top_k(empty, one).count() == 0
    assert {(r.query_id, r.vec_id, r.similarity) for r in V.score_all(one, one, None, 0.0).collect()} >= {(1, 2, 0.5), (2, 2, 1.0)}


def test_predicates(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, True), (None, 3, False)], "lang string, n int, is_table boolean")
    keep = lambda c: [r.n for r in df.where(c).collect()]
    assert keep(P.compile_predicate({"lang": {"$ne": "a"}})) == [2, 3]
    assert keep(P.compile_predicate({"$or": [{"lang": "a"}, {"n": {"$gte": 3}}]})) == [1, 3]
    assert keep(P.compile_predicate({})) == [1, 2, 3]
    assert keep(P.table_mode("exclude")) == [1, 3] and keep(P.table_mode("only")) == [2]
    with pytest.raises(ValueError):
        P.compile_predicate({"n": {"$in": [1]}})
    globs = spark.createDataFrame([("src/a/b.ts", ["src/**"], ["**/*.min.js"]), ("x.min.js", None, ["**/*.min.js"]), ("lib/x.md", ["*.md"], []), ("x.md", ["*.md"], None)], "p string, i array<string>, e array<string>")
    assert [r[0] for r in globs.select(P.watched(F.col("p"), F.col("i"), F.col("e"))).collect()] == [True, False, False, True]


def test_metrics(spark):
    h = spark.createDataFrame([], "duration_ms double, files long, chunks long, status string")
    assert tuple(Met.update_metrics(h).first()) == (0, 0.0, 0, 0, 0.0, 0.0)
    lat = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", None)], "k string, v double")
    r = Met.latency_stats(lat, "k", "v").collect()
    assert len(r) == 1 and (r[0].median, r[0].p95, r[0].p99) == (50.5, 95.0, 99.0)
    rule = spark.createDataFrame([(5, 0, 0, 0, 0), (1, 2, 0, 0, 1), (1, 2, 0, 3, 0), (1, 0, 0, 0, 2), (1, 3, 1, 2, 1)], "e int, am int, d int, c int, x int")
    got = [r[0] for r in rule.select(Met.status_rule(*[F.col(c) for c in rule.columns])).collect()]
    assert got == ["incomplete", "incomplete", "success", "failed", "partial"]


def test_maintenance(spark):
    t = D(2025, 1, 1)
    cols = "k int, hash string, size int, mtime timestamp_ntz"
    prior = spark.createDataFrame([(1, "a", 1, t), (2, "a", 1, t), (3, "a", 1, t), (4, "a", 1, t), (5, None, 1, t)], cols)
    now = spark.createDataFrame([(1, "z", 1, t), (2, "a", 2, t), (3, "b", 2, t), (6, None, 1, t), (5, None, 2, t)], cols)
    diff = lambda p: {r.k: r.change for r in M.snapshot_diff(prior, now, ["k"], p).collect()}
    assert diff(False) == {1: "unchanged", 2: "touched", 3: "modified", 4: "deleted", 5: "modified", 6: "added"}
    assert diff(True)[1] == "modified"
    lines = spark.createDataFrame([("A\tx",), ("D\ty",), ("R100\told\tnew",), ("T\tz",), ("junk",)], "value string")
    assert {tuple(r) for r in M.parse_name_status(lines).collect()} == {("added", "x", None), ("removed", "y", None), ("renamed", "new", "old"), ("modified", "z", None)}
    chunks = spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("r", "c", 1), ("q", "a", 1)], "repository string, file_path string, n int")
    ch = spark.createDataFrame([("r", "a", None, "modified"), ("r", "d", "b", "renamed"), ("r", "e", None, "added")], "repository string, path string, old_path string, change string")
    fresh = spark.createDataFrame([("r", "a", 2), ("r", "d", 2), ("r", "e", 2)], "repository string, file_path string, n int")
    want = [("q", "a", 1), ("r", "a", 2), ("r", "c", 1), ("r", "d", 2), ("r", "e", 2)]
    once = M.apply_changes(chunks, ch, fresh)
    assert sorted(tuple(r) for r in once.collect()) == want
    assert sorted(tuple(r) for r in M.apply_changes(once, ch, fresh).collect()) == want  # a replay stores nothing twice
    ok, bad = M.split_oversized(spark.createDataFrame([(1, 10), (2, 9000)], "id int, tokens int"))
    assert ok.count() == 1 and "9000" in bad.first().error


def test_engine(spark):
    embed = hashing_embedder(16)
    chunks = spark.createDataFrame(
        [(f"c{i}", t, embed(t), "r1" if i else "r2", "go", "pdf", None) for i, t in enumerate(["alpha beta", "alpha beta gamma", "delta"])],
        "id string, content string, embedding array<double>, repository string, language string, document_type string, is_table boolean",
    )
    repos = spark.createDataFrame([("r1", "ready"), ("r2", "indexing")], "repo_name string, status string")
    e = Engine(spark, chunks, repos, embed=embed)
    assert [r.id for r in e.semantic_search("alpha beta", 5, 0.8).collect()] == ["c1"]
    with pytest.raises(RuntimeError):
        e.semantic_search("alpha", repository="r2")
    with pytest.raises(LookupError):
        e.semantic_search("alpha", repository="r9")
    with pytest.raises(ValueError):
        e.semantic_search("alpha", limit=0)
    assert e.search_documents("alpha beta", 5, 0.8, ["pdf"]).count() == 2


def _stream(spark, tmp_path, rows, schema):
    src = str(tmp_path / "in")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_stream_debounce(spark, tmp_path):
    t = D(2025, 1, 1)
    s = lambda x: t + timedelta(seconds=x)
    stream = _stream(spark, tmp_path, [[("a", s(0), 1), ("a", s(1), 2), ("b", s(0), 3)], [("a", s(100), 4)], [("z", s(300), 5)]], "path string, ts timestamp, n int")
    q = E.debounce(stream, ["path"]).writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.path, r["n"], r.n_events) for r in spark.sql("SELECT * FROM debounced").collect()}
    assert {("a", 2, 2), ("b", 3, 1)} <= got


def test_stream_renames(spark, tmp_path):
    t = D(2025, 1, 1)
    s = lambda x: t + timedelta(milliseconds=x)
    schema = "folder string, path string, kind string, size long, ts timestamp"
    rows = [[("f", "x/a.md", "unlink", 5, s(0)), ("f", "y/a.md", "add", 5, s(200)), ("f", "x/b.md", "unlink", 1, s(0)), ("f", "n.md", "add", 1, s(0))], [("f", "q.md", "add", 1, s(60_000))], [("f", "r.md", "add", 1, s(120_000))]]
    stream = _stream(spark, tmp_path, rows, schema)
    q = E.correlate_renames(stream).writeStream.format("memory").queryName("renames").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.change, r.path, r.old_path) for r in spark.sql("SELECT * FROM renames").collect()}
    assert ("renamed", "y/a.md", "x/a.md") in got and ("added", "n.md", None) in got and ("deleted", "x/b.md", None) in got


def test_stream_apply(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), ["repository", "file_path"], buckets=4)
    table.write(spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("q", "a", 1)], "repository string, file_path string, n int"))
    stream = _stream(spark, tmp_path, [[("r", "a", None, "deleted"), ("r", "c", "b", "renamed")]], "repository string, path string, old_path string, change string")
    q = E.apply_stream(stream, table, lambda df: df.select("repository", F.col("path").alias("file_path"), F.lit(2).alias("n")), str(tmp_path / "ck"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in table.read().collect()} == {("q", "a", 1), ("r", "c", 2)}


def test_max_wait(spark):
    import random

    rng = random.Random(2)
    t, rows, at = D(2025, 1, 1), [], 0
    for i in range(400):
        at += rng.choice((500, 900, 1500, 2000, 7000))
        rows.append(("ab"[i % 2], i, t + timedelta(milliseconds=at)))
    want = set()
    for k in "ab":
        held = None
        for _, i, ts in [r for r in rows if r[0] == k]:
            ms = int(ts.timestamp() * 1000)
            if held and ms - held[1] < 2000 and ms - held[0] < 5000:
                held = (held[0], ms, i, held[3] + 1)
                continue
            if held:
                want.add((k, min(held[1] + 2000, held[0] + 5000), held[2], held[3]))
            held = (ms, ms, i, 1)
        want.add((k, min(held[1] + 2000, held[0] + 5000), held[2], held[3]))
    df = spark.createDataFrame(rows, "k string, i int, ts timestamp")
    assert {tuple(r) for r in M.debounce_max_wait(df, ["k"], "i", 2000, 5000).collect()} == want
    assert M.debounce_max_wait(df.limit(0), ["k"], "i").count() == 0


def test_rolling_count_at_the_ends(spark):
    t = D(2025, 1, 1)
    rows = [("a", i, t + timedelta(seconds=s)) for i, s in enumerate((0, 0, 59, 60, 61, 119, 120, 500))] + [(None, 100, t)]
    got = {r.i: r.n_last for r in Met.rolling_count(spark.createDataFrame(rows, "k string, i int, ts timestamp"), ["k"], 60_000_000).collect()}
    secs = {i: s.timestamp() for k, i, s in rows if k}
    assert got == {i: sum(s - 60 <= x <= s for x in secs.values()) for i, s in secs.items()} | {100: 1}
