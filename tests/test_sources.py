import io
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources import files as S
from quern.sources.snapshots import ConcurrentWrite, SnapshotTable, export_table


@pytest.fixture()
def tree(tmp_path):
    for name, data in {
        "src/a.ts": b"let a = 1;", "src/.hidden/b.ts": b"x", "node_modules/c.ts": b"x", "src/d.min.js": b"x", "docs/e.md": b"# t", "docs/drafts/f.md": b"x", "package-lock.json": b"{}", "big.py": b"x" * (S.MAX_BYTES + 1),
        "img/p.png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 7, 9) + b"\0" * 8, "keep.log": b"x",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    doc = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr(
            "word/document.xml",
            f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p>'
            f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
        )
    (tmp_path / "docs/g.docx").write_bytes(doc.getvalue())
    (tmp_path / "docs/broken.docx").write_bytes(b"no zip")
    return str(tmp_path)


def test_scan_and_ignores(spark, tree):
    found = S.scan(spark, tree, [".ts", ".js", ".md", ".py", ".json", ".log"])
    assert {r[0] for r in found.select("relative_path").collect()} == {"src/a.ts", "docs/e.md", "docs/drafts/f.md", "keep.log"}
    kept = S.apply_ignores(found, [("", "*.log\ndrafts/\n"), ("docs", "!drafts/\n")])
    assert {r[0] for r in kept.select("relative_path").collect()} == {"src/a.ts", "docs/e.md", "docs/drafts/f.md"}


def test_binary_formats(spark, tree):
    found = S.scan(spark, tree, [".png", ".docx"])
    assert [(r.format, r.width, r.height) for r in S.images(found).collect()] == [("png", 7, 9)]
    docs = {r.relative_path: r for r in S.docx_texts(found).collect()}
    assert docs["docs/g.docx"].text == "Head\nBody" and docs["docs/g.docx"].headings == ["Head"] and docs["docs/g.docx"].n_tables == 1
    assert docs["docs/broken.docx"].text is None and docs["docs/broken.docx"].error
    kinds = {r[0]: r[1] for r in found.select("relative_path", S.magic_type(F.col("content"))).collect()}
    assert kinds["img/p.png"] == "image" and kinds["docs/g.docx"] == "docx" and kinds["docs/broken.docx"] is None


def test_audit_log(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","event_type":"login","success":true}\nnot json\n')
    assert [r.event_type for r in S.audit_log(spark, str(tmp_path)).collect()] == ["login"]


def test_snapshot_table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["id"])
    assert t.version() is None
    t.upsert(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, v string, n int"), "n")
    assert {tuple(r) for r in t.read().collect()} == {(1, "b", 2), (2, "c", 1)}
    t.upsert(spark.createDataFrame([(2, "d", 5), (3, "e", 5)], "id int, v string, n int"))
    t.delete(spark.createDataFrame([(1,)], "id int"))
    assert {tuple(r) for r in t.read().collect()} == {(2, "d", 5), (3, "e", 5)} and t.version() == 3
    assert [r.id for r in t.get({"v": "e"}).collect()] == [3]
    with pytest.raises(ValueError):
        t.get({})
    assert sorted(os.listdir(tmp_path / "t/commits"))[-1] == "3" and not os.path.exists(tmp_path / "t/commits/1")
    t.drop()
    assert t.version() is None


def test_snapshot_table_survives_crashes_and_writers(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["id"], buckets=3)
    rows = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    t.write(rows((1, "a"), (2, "b"), (3, "c")))
    (tmp_path / "t/commits/2").write_text("")  # a writer that ended while it committed
    assert t.version() == 1 and t.read().count() == 3
    assert t.upsert(rows((1, "z"))) == 3 and {tuple(r) for r in t.read().collect()} == {(1, "z"), (2, "b"), (3, "c")}
    stale = t._current()
    t.upsert(rows((4, "d")))
    with pytest.raises(ConcurrentWrite):
        t._write(rows((9, "x")), stale, {0})
    assert t.read().count() == 4
    t.delete(rows((1, ""), (2, ""), (3, ""), (4, "")).select("id"))
    assert t.read().count() == 0 and t.read().columns == ["id", "v"]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1)], "x string, y int")
    export_table(df, str(tmp_path / "m"), "markdown")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert "| x | y |" in lines and "| a\\|b | 1 |" in lines
    for kind in ("csv", "json"):
        export_table(df, str(tmp_path / kind), kind)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("src/a/x.ts", "../b/./y"), ("x.ts", "../../y"), ("src/a.ts", "./b")], "base string, target string")
    assert [r[0] for r in df.select(T.resolve_relative(F.col("base"), F.col("target"))).collect()] == ["src/b/y", None, "src/b"]
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(T.function_signature(F.lit("f"), F.lit(True), F.array(F.struct(F.lit("a").alias("name"), F.lit(None).cast("string").alias("type"))), F.lit(None).cast("string"))) == "async f(a: any): void"
    assert get(T.wikilinks(F.lit("[[A|b]] [[C]]"))) == ["A", "C"]
    assert get(T.divergence_percent(F.lit(1), F.lit(3))) == 33.3 and get(T.divergence_percent(F.lit(1), F.lit(0))) == 0.0
    assert get(T.rename_confidence(F.lit(3), F.lit(3))) == 0.9 and get(T.rename_confidence(F.lit(None), F.lit(3))) == 0.7
    assert get(T.unescape_cell(T.escape_cell(F.lit("a|b\\c")))) == "a|b\\c" and get(T.csv_cell(F.lit('a"b'))) == '"a""b"'
    assert get(T.section_id(F.lit("p"), F.lit(1), F.lit(2), F.lit("t"))).startswith("Section:")
    assert get(T.elapsed(F.lit(3_700_000))) == "1h 1m" and get(T.backoff_ms(F.lit(3))) == 8000


def test_tables_by_geometry():
    items = [(1, 1, 1, "a"), (5, 1.1, 1, "b"), (1, 2, 1, "c"), (5.4, 2, 1, "d"), (1, 9, 1, "text")]
    assert S.detect_tables(items) == [[["a", "b"], ["c", "d"]]]
