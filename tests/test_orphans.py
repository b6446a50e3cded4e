from datetime import datetime as D

from quern.operators.orphans import Entity, Reference, direct_orphans, orphan_cascade, orphan_report, uuid_key

U = "0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9"
REFS = (Reference("chunks", "doc", "docs", "id"), Reference("docs", "folder", "folders", "id"))


def tables(spark, chunks, docs, folders):
    return {
        "chunks": Entity(spark.createDataFrame(chunks, "id string, doc string, t timestamp_ntz, _key string, ref_table string"), "id", "t"),
        "docs": Entity(spark.createDataFrame(docs, "id string, folder string, t timestamp_ntz, deleted timestamp_ntz"), "id", "t", "deleted"),
        "folders": Entity(spark.createDataFrame(folders, "id string, t timestamp_ntz, deleted timestamp_ntz"), "id", "t", "deleted"),
    }


def test_uuid_forms(spark):
    forms = [U, U.upper(), "{" + U + "}", U.replace("-", ""), "0a1b-2c3d-4e5f-6071-8293-a4b5-c6d7-e8f9"]
    df = spark.createDataFrame([(f,) for f in forms], "u string")
    assert df.select(uuid_key(df.u)).distinct().count() == 1
    odd = spark.createDataFrame([(U + " ",), ("{" + U,), (U[:-1],), ("",)], "u string")
    assert odd.select(uuid_key(odd.u)).distinct().count() == 4


def test_direct_and_inherited(spark):
    t = tables(
        spark,
        [
            ("c1", U.upper(), D(2025, 3, 1), "x", "y"), ("c1", U.upper(), D(2025, 3, 1), "x", "y"), ("c2", "gone", D(2025, 4, 1), None, None),
            ("c3", None, D(2025, 4, 1), None, None), ("c4", "d2", D(2025, 1, 1), None, None), ("c5", "", None, None, None), ("c6", "d3", D(2025, 9, 1), None, None),
        ],
        [(U, "f-gone", D(2025, 1, 1), None), ("d2", "f1", D(2025, 2, 1), None), ("d3", "f1", D(2025, 2, 1), D(2025, 3, 1))],
        [("f1", D(2024, 1, 1), None)],
    )
    direct = {tuple(r) for r in direct_orphans(t, REFS).collect()}
    assert direct == {
        ("chunks", "doc", "c2", "2025-04"), ("chunks", "doc", "c4", "2025-01"), ("chunks", "doc", "c5", None), ("chunks", "doc", "c6", "2025-09"), ("docs", "folder", U, "2025-01"),
    }
    cascade = orphan_cascade(t, REFS)
    inherited = {(r.row_id, r.depth) for r in cascade.where("kind = 'inherited'").collect()}
    assert inherited == {("c1", 1)}
    assert sum(r.n_orphans for r in orphan_report(cascade).collect()) == 6


def test_empty_tables(spark):
    t = tables(spark, [], [], [])
    assert orphan_cascade(t, REFS).count() == 0
    t = tables(spark, [("c", "d", D(2025, 1, 1), None, None)], [], [])
    assert [r.row_id for r in direct_orphans(t, REFS).collect()] == ["c"]


def test_cycle_ends(spark):
    rows = [("a", "b"), ("b", "a"), ("c", "a"), ("d", "nowhere"), ("e", "d"), ("f", "e")]
    df = spark.createDataFrame([(i, p, D(2025, 1, 1)) for i, p in rows], "id string, parent string, t timestamp_ntz")
    out = orphan_cascade({"n": Entity(df, "id", "t")}, (Reference("n", "parent", "n", "id", False),))
    assert {(r.row_id, r.kind, r.depth) for r in out.collect()} == {("d", "direct", 0), ("e", "inherited", 1), ("f", "inherited", 2)}


def test_a_deep_cycle_is_followed_to_its_end(spark):
    n = 40  # longer than the pieces are kept apart
    t = D(2025, 1, 1)
    rows = [(f"r{i}", f"r{i - 1}" if i else "gone", t) for i in range(n)]
    e = {"nodes": Entity(spark.createDataFrame(rows, "id string, parent string, t timestamp_ntz").coalesce(1), "id", "t")}
    got = {r.row_id: (r.kind, r.depth) for r in orphan_cascade(e, (Reference("nodes", "parent", "nodes", "id"),)).collect()}
    assert got == {f"r{i}": ("inherited" if i else "direct", i) for i in range(n)}


def test_checkpoint_folder():
    import pytest

    from quern.session import checkpoint_folder

    assert checkpoint_folder("hdfs://x/ck", "yarn") == "hdfs://x/ck" and "quern" in checkpoint_folder(None, "local[4]")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(RuntimeError):
            checkpoint_folder(None, master)
