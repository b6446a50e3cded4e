"""Nulls, empties, repeated rows, clashing extra columns and empty tables through Spark."""

import pytest
from pyspark.sql import functions as F

from quern.llm import encoding, handwritten, language, leakage, scans, secrets, splitting, syntax

LONG = ("The quick brown fox reads the manual. " * 90).strip()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a1", LONG, "en"), (1, "a1", LONG, "en"), (2, "a2", None, None), (3, "a3", "", "de"), (4, "a4", " \n ", ""), (5, None, "x" * 9000, "xx"), (6, "a6", "short", None)]
    df = spark.createDataFrame(rows, "doc_id long, id string, text string, lang string")
    return df.withColumns({"ids": F.lit("clash"), "_key": F.lit(1), "n_words": F.lit(2), "_label": F.lit("x"), "chunk_index": F.lit(9)})


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, "r", "a.py", "x = (1"), (1, "r", "a.py", "x = (1"), (2, None, "b.js", None), (3, "r", None, "x"), (4, "r", "c.go", ""), (5, "r", ".\\d.JSON", "{}"), (6, "r", "README.md", "hi")]
    df = spark.createDataFrame(rows, "file_id long, repository string, path string, content string")
    return df.withColumns({"language": F.lit("clash"), "line_no": F.lit(1), "reason": F.lit("z"), "code_hash": F.lit("q"), "_lang": F.lit("p")})


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, 1, 1, "Head\nsome text\n1"), (2, 1, 2, None), (3, 1, 3, ""), (4, None, None, "x"), (1, 1, 1, "Head\nsome text\n1")]
    return spark.createDataFrame(rows, "page_id long, doc_id long, page_number int, content string").withColumns({"defect": F.lit("c"), "side": F.lit(5), "_flags": F.lit(1)})


def test_splitting(spark, docs):
    got = splitting.pieces(docs)
    assert {r.doc_id for r in got.collect()} == {1, 5}
    chunks = spark.createDataFrame(
        [("A1", 0, 0, 100), ("a1", None, None, None), (None, 0, 0, 1), ("zz", 0, 0, 1), ("a1", 10**9, 5, 4)], "document_id string, chunk_index int, start_offset int, end_offset int"
    ).withColumn("doc_id", F.lit(7))
    assert {r.doc_id for r in splitting.badly_cut(docs, chunks).collect()} == {1, 5}
    assert splitting.badly_cut(docs.limit(0), chunks).count() == 0 and splitting.pieces(docs.limit(0)).count() == 0
    assert {r.doc_id for r in splitting.badly_cut(docs, chunks.limit(0)).collect()} == {1, 5}


def test_good_cutting_with_repeated_rows(spark):
    doc = spark.createDataFrame([(1, "A1", LONG)], "doc_id long, id string, text string")
    cut = [("{a1}" if i else "a1", i, a, z) for i, (a, z, _) in enumerate(splitting.split(LONG))]
    chunks = spark.createDataFrame([(d if d != "{a1}" else "a1", i, a, z) for d, i, a, z in cut] * 3, "document_id string, chunk_index int, start_offset int, end_offset int")
    doc = doc.withColumn("id", F.lit("a1"))
    assert splitting.badly_cut(doc, chunks).count() == 0
    assert splitting.badly_cut(doc, chunks.where("chunk_index > 0")).count() == 1


def test_encoding(docs):
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(docs).collect()}
    assert got[2] == [] and got[3] == [] and got[4] and len(got) == 6
    assert encoding.encode_corpus(docs.limit(0)).count() == 0


def test_leakage(spark, docs):
    items = spark.createDataFrame([(1, LONG, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x")], "item_id long, text string, sentence string")
    got = leakage.leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1)}
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0
    twice = items.unionByName(items.withColumn("item_id", F.col("item_id") + 10))
    assert leakage.leaks(docs, twice).count() == 0
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items, block_words=100).collect()} == {(1, 1)}


def test_language(docs):
    model = language.train(docs)
    got = {r.doc_id: r.lang for r in language.document_languages(docs, model).collect()}
    assert got[2] is None and got[3] is None and got[4] is None and got[1] == "en"
    assert {r.doc_id for r in language.wrong_labels(docs, model).collect()} <= {5, 6}
    assert language.segments(docs, model).where("doc_id = 1").count() == 2
    none = language.train(docs.limit(0))
    assert language.wrong_labels(docs, none).count() == 0 and language.segments(docs.limit(0), model).count() == 0


def test_labels(spark):
    rows = [("en-US", "en"), ("DEU", "de"), (" French ", "fr"), ("pt_BR", "pt"), ("und", None), ("", None), (None, None), ("klingon", "?"), ("xx", "?")]
    df = spark.createDataFrame([(r[0],) for r in rows], "l string")
    assert [r[0] for r in df.select(language.label_language(F.col("l"))).collect()] == [r[1] for r in rows]


def test_syntax(spark, files):
    assert [r.file_id for r in syntax.broken_files(files).collect()] == [1, 1]
    rates = {(r.repository, r.language): (r.n_files, r.n_broken) for r in syntax.broken_rates(files).collect()}
    assert rates == {("r", "python"): (2, 2), ("r", "go"): (1, 0), ("r", "json"): (1, 0)}
    errors = spark.createDataFrame([("r", "extraction_error", "./a.py", None), ("r", "file_error", None, "File:r:c.go"), (None, "file_error", None, None)], "repository string, error_type string, file_path string, node_id string")
    assert {r.state: r.n_files for r in syntax.log_agreement(files, errors).collect()} == {"logged and broken": 1, "logged, not broken": 1}
    assert syntax.broken_files(files.limit(0)).count() == 0


def test_handwritten(files):
    assert handwritten.not_handwritten(files).count() == 0 and handwritten.not_handwritten(files.limit(0)).count() == 0


def test_secrets(files):
    model = secrets.train(files)
    assert secrets.secrets(files, model).count() == 0
    got = {r.file_id: r.content for r in secrets.redacted(files, model).collect()}
    assert got[2] is None and got[1] == "x = (1"
    none = secrets.train(files.limit(0))
    assert secrets.redacted(files.limit(0), none).count() == 0


def test_scans(pages):
    e = scans.train(pages)
    assert all(r.page_id in (1, 2, 3, 4) for r in scans.defects(pages, e).collect())
    assert scans.paragraphs(pages, e).count() >= 1
    none = scans.train(pages.limit(0))
    assert scans.defects(pages.limit(0), none).count() == 0 and scans.paragraphs(pages.limit(0), none).count() == 0
