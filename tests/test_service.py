import os

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.operators import vectors as V
from quern.service import KnowledgeBase, UpdateRefused


@pytest.fixture
def kb(spark, tmp_path):
    src = tmp_path / "proj"
    for path, text in {"src/a.py": "def alpha():\n    return 1\n", "src/b.ts": "export const b = 1;\n", "notes.md": "# Notes on alpha\n", "skip/c.py": "x = 1\n", "data.bin": "no", ".gitignore": "skip/\n", "empty.txt": "", "src/__init__.py": "y = 1\n"}.items():
        os.makedirs((src / path).parent, exist_ok=True)
        (src / path).write_text(text)
    (src / "bad.py").write_bytes(b"\xff\xfe\x00x")
    return KnowledgeBase(spark, str(tmp_path / "kb"), buckets=2), src


def test_index_update_repair(kb, capsys):
    base, src = kb
    run = lambda *a: cli.main(["--root", "x", *a], base)
    assert run("index", str(src)) == 0 and run("update", "nothing") == 1
    paths = lambda: {r.file_path for r in base.chunks.read().select("file_path").collect()}
    assert paths() == {"src/a.py", "src/b.ts", "notes.md", "src/__init__.py", "bad.py"}
    assert base.check_completeness("proj") == "complete" and base.update("proj")["status"] == "no_changes"
    (src / "src/a.py").write_text("def beta():\n    return 2222\n")
    (src / "src/d.go").write_text("package d\n")
    os.remove(src / "notes.md")
    job = base.trigger_incremental_update("proj")
    assert base.get_update_status(job)["status"] == "completed" and paths() == {"src/a.py", "src/b.ts", "src/d.go", "src/__init__.py", "bad.py"}
    assert [r.content for r in base.chunks.read().where("file_path = 'src/a.py'").collect()] == ["def beta():\n    return 2222\n"]
    assert {(r.files_added, r.files_modified, r.files_deleted) for r in base.history("proj").collect()} >= {(1, 1, 1)}
    base.chunks.delete(base.chunks.read().where("file_path = 'src/b.ts'").select(*base.chunks.keys))
    assert base.repair("proj") == {"embedded": 1, "deleted": 0} and paths() == {"src/a.py", "src/b.ts", "src/d.go", "src/__init__.py", "bad.py"}
    with pytest.raises(UpdateRefused):
        (src / "e.md").write_text("new\n")
        base.update("proj", most_changes=0)
    top = base.search("def beta(): return 2222", 1, 0.0, language="python").collect()
    assert [r.file_path for r in top] == ["src/a.py"]
    assert run("status") == 0 and run("history", "proj") == 0 and run("export", "repositories", str(src.parent / "out")) == 0
    run("remove", "proj")
    assert paths() == set() and base.list_watched_folders().count() == 0
    assert '"repository": "proj"' in capsys.readouterr().out
    with pytest.raises(ValueError):
        base.register_local_folder("/x", "a:b")


def test_engine_extras(kb):
    base, src = kb
    base.register_local_folder(str(src), "p")
    base.index("p")
    e = base.engine()
    found, warnings = e.search_all("alpha", None, 5, 0.0)
    assert found.count() and warnings
    docs = lambda: e.chunks.where("file_path = 'notes.md'").withColumn("similarity", F.lit(0.99)).drop("embedding", "content")
    found, warnings = e.search_all("alpha", docs, 5, 0.0)
    assert not warnings and found.first().source_type == "document"
    a = e.cached(("p", 1), lambda: e.chunks)
    assert e.cached(("p", 1), lambda: 1 / 0) is a
    e.forget("p")
    assert not e._kept and e.within(60, lambda: e.chunks.count()) >= 3


def test_groups_and_index(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, [float(x) for x in centres[0 if i % 3 == 0 else i % 12] + rng.normal(size=16)]) for i in range(900)]  # a third lies about one centre
    df = spark.createDataFrame([*rows, (900, None)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 20 = 0")
    cells = V.Cells.fit(df, 24)
    usual = V.CELL_ROWS, V.CELL_QUERIES
    V.CELL_ROWS, V.CELL_QUERIES = 100, 20
    exact = {(r.query_id, r.vec_id) for r in V.top_k(df, q, 10, 0.5).collect()}
    got = {(r.query_id, r.vec_id) for r in V.top_k_indexed(df, q, cells, 10, 0.5, 8).collect()}
    every = {(r.query_id, r.vec_id) for r in V.top_k_indexed(df, q, cells, 10, 0.5, 24).collect()}
    V.CELL_ROWS, V.CELL_QUERIES = usual
    assert every == exact and len(exact & got) >= 0.9 * len(exact)
    found, warnings = V.search_groups({("a", "m", 16): (df, rows[0][1]), ("b", "m", 8): (df, rows[0][1])}, 5, 0.0)
    assert found.first().vec_id == 0 and found.count() == 5 and len(warnings) == 1
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception):
        V.top_k(odd, odd.where("vec_id = 1"), 2, 0.0).collect()
    assert V.top_k_indexed(df.limit(0), q.limit(0), V.Cells.fit(df.limit(0)), 3).count() == 0
