"""Models of the text operators are fitted on all rows, not on a sample."""

import random
from collections import Counter

import pytest

from quern.llm import scans, secrets


@pytest.mark.parametrize("kept", [secrets.KEPT, 0])
def test_secrets_are_learned_from_all_files(spark, monkeypatch, kept):
    monkeypatch.setattr(secrets, "KEPT", kept)  # with 0 the sums are made where the lessons lie
    rng = random.Random(4)
    token = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    rows = [(f"src/{w}.js", f'const {w} = "reading {w}";\nconst label = "{w}-name";\n') for w in (f"plain{i % 50}" for i in range(5000))]
    rows += [(f"conf/{i}.env", f"DB_PASSWORD={token(14)}#1\nVENDOR_TOKEN={token(9)}7\nHOST=db.example\n") for i in range(40)]
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "file_id long, path string, content string").repartition(3)
    want, got = secrets.fit(rows), secrets.train(files)
    assert got.markov.table == want.markov.table and set(got.weights) == set(want.weights)
    assert all(abs(got.weights[x] - w) < 1e-3 for x, w in want.weights.items()) and abs(got.shift - want.shift) < 1e-3
    lines = {(5000 + i, k) for i in range(40) for k in (1, 2)}
    assert {(r.file_id, r.line_no) for r in secrets.secrets(files).select("file_id", "line_no").collect()} == lines
    assert {(r.file_id, r.line_no) for r in secrets.secrets(files, want).select("file_id", "line_no").collect()} == lines


def test_words_are_counted_on_all_pages_and_all_rare_words_teach(spark):
    rng = random.Random(2)
    body = "reading the manual before every release keeps a stable process\n"
    texts = [body] * 7000 + [body.replace("manual", f"manu{c}l") for c in "äöüå" for _ in range(3)] + ["well-known re-\nlease `co-de` opera-\n\ntions\n"] * 9
    pages = spark.createDataFrame([(i, i, 1, t) for i, t in enumerate(texts)], "page_id long, doc_id long, page_number int, content string")
    e = scans.train(pages)
    assert e.total == sum(len(scans.page_words(t)) for t in texts) and e.counts["reading"] == 7012 and e.trusted["well-known"] == 9
    counts = {"manual": 10**6} | {f"{''.join(rng.choice('bcdfghjk') for _ in range(9))}{k}x": 1 for k in range(20_000)} | {f"ma{c}ual": 1 for c in "äöüå"}
    assert sum(scans.shown(counts.items(), 10**6, counts, scans.holes_of(counts))[0].values()) == 4
    for t in (*texts[-14:], "a-\nb-\nc", "x` `-\n`y`\nz", "foo- `x`\nbar", " \n-\n", "e‐f g-h\n"):
        assert scans.word_counts([t]) == Counter(scans.page_words(t))
    assert scans.train(pages.limit(0)).trusted == {}
