from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators import chunking as C
from quern.operators import markdown as M

TEXT = st.text(alphabet="ab .\n\r😀", max_size=400)


@settings(max_examples=80, deadline=None)
@given(TEXT, st.integers(2, 20), st.integers(0, 6))
def test_line_chunks_cover_and_overlap(text, size, overlap):
    chunks = C.by_lines(text, size, overlap)
    norm = C.normalize(text)
    if not text.strip():
        assert chunks == []
        return
    for c in chunks:
        assert norm[c.start : c.end] == c.content
        assert c.start_line <= c.end_line
    covered = set()
    for c in chunks:
        covered |= set(range(c.start, c.end))
    assert all(i in covered or norm[i].isspace() for i in range(len(norm)))
    starts = [c.start for c in chunks]
    assert starts == sorted(starts)


@settings(max_examples=80, deadline=None)
@given(TEXT, st.integers(2, 20))
def test_paragraph_chunks_hold_every_word(text, size):
    words = C.normalize(text).split()
    joined = " ".join(c.content for c in C.by_paragraphs(text, size, 0)).split()
    assert joined == words


def test_long_line_stays_whole():
    assert len(C.by_lines("x" * 9000)) == 1
    assert C.by_lines(None) == C.by_lines("") == C.by_lines(" \n ") == []


def test_pages_number_through(spark):
    df = spark.createDataFrame([(1, 1, "a\n" * 900), (1, 2, "b"), (2, 1, None), (1, 3, "")], "doc_id long, page_number int, content string")
    got = sorted((r.page_number, r.chunk_index) for r in C.by_pages(df, 100, 0).collect())
    assert [i for _, i in got] == list(range(len(got))) and got[-1][0] == 2


def test_breadcrumb():
    s = [("A", 1, 0), ("B", 2, 10), ("C", 3, 20), ("D", 2, 30)]
    assert C.breadcrumb(s, 25, "t") == "A > B > C"
    assert C.breadcrumb(s, 35, "t") == "A > D"
    assert C.breadcrumb([], 5, "t") == "t"


MD = """---
title: The guide
---
# Top

See [other](../b/other.md#x) and [[Wiki Page|alias]], `SomeName` and <https://x.example/a>.

```
# not a heading
```

## Part one

| a | b |
|---|---|
| 1 | x \\| y |
| 2 |

# End
"""


def test_markdown():
    p = M.parse(MD)
    assert p.meta == {"title": "The guide"}
    assert [(s[0], s[1], s[4]) for s in p.sections] == [("Top", 1, -1), ("Part one", 2, 0), ("End", 1, -1)]
    assert [x[0] for x in p.links] == ["../b/other.md#x", "https://x.example/a", "[[Wiki Page"]
    assert p.tables[0]["rows"] == [["1", "x | y"], ["2", ""]]
    assert M.parse(None).sections == [] and M.parse("").links == []


def test_table_chunks_round_trip():
    t = {"caption": "Prices", "header": ["k", "v|w"], "rows": [[str(i), "x" * 30] for i in range(40)], "columns": 2}
    parts = M.table_chunks(t, 60)
    assert len(parts) > 1 and all(x.startswith("**Table: Prices**") for x in parts)
    back = M.reassemble(parts)
    assert back["rows"] == t["rows"] and back["header"] == t["header"] and back["caption"] == "Prices"
    assert M.expand_cells([{"content": "a", "colSpan": 2}, {"content": "b"}], 4) == ["a", "", "b", ""]


def test_link_tiers(spark):
    found = spark.createDataFrame(
        [(1, "Wiki Page", "", 0, 0, True, "r", "a/x.md"), (1, "../b/other.md#x", "", 0, 0, False, "r", "a/x.md"), (1, "https://q.example", "", 0, 0, False, "r", "a/x.md"), (1, "run", "", 0, 0, True, "r", "a/x.md"), (1, "nothing", "", 0, 0, True, "r", "a/x.md")],
        "doc_id long, target string, label string, offset int, section int, wiki boolean, repository string, file_path string",
    )
    docs = spark.createDataFrame([("r", "b/other.md", "Other", "D1"), ("r", "c/y.md", "wiki page", "D2")], "repository string, file_path string, title string, node string")
    heads = spark.createDataFrame([("r", "Wiki Page", "S1")], "repository string, title string, node string")
    symbols = spark.createDataFrame([("r", "run", "F1")], "repository string, name string, node string")
    got = {r.target: r.node for r in M.resolve_links(found, docs, heads, symbols).collect()}
    assert got["Wiki Page"] == "D2" and got["../b/other.md#x"] == "D1" and got["run"] == "F1" and got["https://q.example"].startswith("ExternalLink:") and "nothing" not in got


def test_nearest_heading(spark):
    pos = spark.createDataFrame([(1, 5, "p"), (1, 15, "q"), (2, 1, "r")], "doc_id long, offset int, tag string")
    heads = spark.createDataFrame([(1, 10, "H")], "doc_id long, start_offset int, title string")
    assert {r.tag: r.heading for r in M.nearest_heading(pos, heads).collect()} == {"p": None, "q": "H", "r": None}


def test_breadcrumbs_as_the_fold(spark):
    import random

    from quern.operators import chunking, markdown

    rng = random.Random(4)
    heads, at = [], []
    for doc in range(12):
        offsets = sorted(rng.sample(range(5, 200), rng.randint(0, 9)))
        heads += [(doc, o, rng.randint(1, 4), f"h{o}") for o in offsets]
        at += [(doc, rng.randint(0, 210), f"c{doc}-{i}") for i in range(6)]
    h = spark.createDataFrame(heads, "doc_id int, start_offset int, level int, title string")
    got = {r.chunk_id: r.breadcrumb for r in markdown.breadcrumbs(spark.createDataFrame(at, "doc_id int, offset int, chunk_id string"), h).collect()}
    assert got == {c: chunking.breadcrumb([(t, lv, o) for d, o, lv, t in heads if d == doc], pos, None) for doc, pos, c in at}


def test_document_graph(spark):
    from quern.operators import docgraph as D

    text = "---\ntitle: Start\n---\n# One\n\nSee [two](two.md), [site](https://x.org) and [[Start]].\n\n## Below\n\nUses `makeIndex` and buildGraph.\n"
    docs = spark.createDataFrame([(1, "r", "a/one.md", text), (2, "r", "a/two.md", "# Two\n"), (3, "q", "a/one.md", "calls makeIndex"), (4, None, "z.md", "# Z"), (5, "r", None, "# N"), (9, "r", "a/two.md", "# Again\n")], "doc_id long, repository string, file_path string, text string")
    symbols = spark.createDataFrame([("r", "makeIndex", "Function:r:m"), ("r", "buildGraph", "Class:r:b")], "repository string, name string, id string")
    nodes, edges = D.build_document_graph(docs, symbols)
    e = {(r.src, r.dst, r.type) for r in edges.collect()}
    one = "Document:r:a/one.md"
    assert {(one, "Document:r:a/two.md", "LINKS_TO"), (one, one, "LINKS_TO"), (one, "Function:r:m", "MENTIONS"), (one, "Class:r:b", "MENTIONS")} <= e
    assert not [x for x in e if x[0].startswith("Document:q") and x[2] == "MENTIONS"]
    kinds = [t for _, _, t in e]
    assert kinds.count("HAS_SECTION") == 2 and kinds.count("CONTAINS_SECTION") == 1 and {r.label for r in nodes.collect()} == {"Document", "Section", "ExternalLink"}
    stray = edges.union(spark.createDataFrame([(one, "Function:q:x", "MENTIONS", "low"), (one, "Module:m", "MENTIONS", "low")], edges.schema))
    more = nodes.select("id", "repository").union(spark.createDataFrame([("Function:r:m", "r"), ("Class:r:b", "r"), ("Function:q:x", "q"), ("Module:m", None)], "id string, repository string"))
    assert {r.dst for r in D.foreign_mentions(stray, more).collect()} == {"Function:q:x", "Module:m"}
    empty, none = D.build_document_graph(docs.limit(0), symbols)
    assert empty.count() == 0 and none.count() == 0
