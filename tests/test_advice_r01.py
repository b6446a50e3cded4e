"""Findings of the first advice: each test fails on the code before it."""

import random
from datetime import datetime, timedelta

from quern.operators import codegraph
from quern.operators import maintenance as M
from quern.operators import structure_queries


def test_renames_take_the_latest_open_unlink(spark):
    rng = random.Random(4)
    start = datetime(2026, 1, 1)
    events = [(i, rng.choice("ab"), start + timedelta(seconds=rng.randint(0, 4000)), 1, rng.choice(("unlink", "add"))) for i in range(300)]
    events += [(1000 + i, "q", start + timedelta(seconds=i), 1, kind) for i, kind in enumerate(("unlink", "unlink", "add", "add", "add"))]
    want, held = set(), {}
    for at, kind, i, key in sorted((at, int(kind == "add"), i, key) for i, key, at, _, kind in events):
        if kind == 0:
            held.setdefault(key, []).append((at, i))
        elif fits := [h for h in held.get(key, ()) if at - h[0] <= timedelta(seconds=120)]:
            held[key].remove(fits[-1])
            want.add((fits[-1][1], i))
    df = spark.createDataFrame(events, "id long, key string, ts timestamp_ntz, size long, kind string")
    got = M.correlate_renames(df.where("kind = 'unlink'"), df.where("kind = 'add'"), ["key"], 120_000)
    assert {(r.unlink_id, r.add_id) for r in got.collect()} == want and {(1001, 1002), (1000, 1003)} <= want


def test_pieces_meet_documents_by_uuid_and_markdown_by_extension(spark, tmp_path):
    key = "0a1b2c3d-0000-4000-8000-00000000000{}"
    docs = [(1, key.format(1), "# One\n\ntext\n", "markdown", "s", "a.md"), (2, key.format(2), "# Two\n\ntext\n", None, "s", "b.MD"), (3, key.format(3), "# Three\n\ntext\n", "pdf", "s", "c.pdf"), (4, key.format(4), None, None, "s", None)]
    spark.createDataFrame(docs, "doc_id long, id string, text string, document_type string, source string, file_path string").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = [(f"c{i}", k, 8) for i, k in enumerate((key.format(1), "{" + key.format(1).upper() + "}", key.format(2).replace("-", ""), key.format(3), key.format(4)))]
    spark.createDataFrame(chunks, "id string, document_id string, start_offset int").write.parquet(f"{tmp_path}/document_chunks.parquet")
    assert {(r.doc_id, r.chunk_id) for r in structure_queries.chunk_headings(spark, str(tmp_path)).collect()} == {(1, "c0"), (1, "c1"), (2, "c2")}


def test_long_expressions_and_signatures_stay_whole():
    chain = "a." + ".".join(f"member{i}" for i in range(60))
    assert [c[1] for c in codegraph.parse(f"{chain}()\n", "python").calls] == [chain]
    head = f"function f({', '.join(f'parameter{i}' for i in range(60))})"
    assert [e.signature for e in codegraph.parse(head + " {\n}\n", "javascript").entities] == [head]
