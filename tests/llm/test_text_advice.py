"""Findings of the first advice that concern the text operators."""

import random

from quern.llm import handwritten, scans, secrets


def test_rare_words_are_settled_by_the_counts_of_all_pages(spark):
    bulk = "reading the manual before every release keeps a stable process " * 40
    texts = [bulk] * 20 + ["the operations stop\n"] * 16 + ["the 0perations stop\n", *["bo1t bolt\n"] * 5]
    pages = spark.createDataFrame([(i, i, 1, t) for i, t in enumerate(texts)] + [(None, 99, 1, "the 0perations stop\n")], "page_id long, doc_id long, page_number int, content string")
    editor = scans.train(pages.where("page_id < 20"))  # a sample that does not hold the rare words
    assert "operations" not in editor.trusted and "reading" in editor.trusted
    found = {(r.page_id, r.line_no, r.defect) for r in scans.defects(pages, editor).collect()}
    assert {(36, 1, "misread"), (None, 1, "misread")} <= found
    assert not {p for p, _, d in found if d == "misread"} & set(range(37, 42))  # bolt is not far more frequent than bo1t


def test_long_and_spaced_values_are_candidates():
    rng = random.Random(8)
    token = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    rows = [(f"src/a{i}.js", f'const apiKey{i} = "{token(32)}";\nconst label = "chunk-name";\nconst password = "changeme";\n// run with --password {token(12)}!\n') for i in range(150)]
    rows += [(f"conf/{i}.env", f"DB_PASSWORD={token(14)}#1\nDATABASE_URL=postgres://app:{token(14)}@db.example/x\nPORT=80{i}\n") for i in range(150)]
    model = secrets.fit(rows)
    jwt = f"eyJ{token(30)}.{token(300)}.{token(342)}"
    text = f'const authToken = "{jwt}";\nconst dsn = "host=db user=x password={token(14)} port=1";\nconst passphrase = "{token(7)} {token(9)} {token(8)}";\nconst note = "host=db user=x";\n// {token(90)}\n'
    assert [(c.line, len(c.value)) for c in secrets.candidates(text, "x.js")] == [(1, len(jwt)), (2, 14), (3, 26), (5, 90)]
    found = secrets.found_in(text, "x.js", model)
    assert {1, 2} <= {c.line for c, _ in found}
    masked = secrets.mask(text, [s for c, _ in found for s in c.spans])
    assert len(masked) == len(text) and jwt not in masked and "host=db user=x password=XXXXXXXXXXXXXX port=1" in masked


def test_blobs_with_many_names_are_data():
    def why(text, lang):
        limits = handwritten.THRESHOLDS[lang]
        return handwritten.reason(text, lang, handwritten.layout(text, lang, limits), limits)

    code = "import base64\nimport zlib\n\n\ndef load():\n    return zlib.decompress(base64.b64decode(DATA))\n\n\n"
    assert why(code + 'DATA = "' + "Ab3d" * 400 + '"\n', "python") == "data"
    assert why(code + 'DATA = (\n' + ('    "' + "Ab3d" * 19 + '"\n') * 20 + ")\n", "python") == "data"
    assert why(code + 'DATA = "' + "Ab3d" * 10 + '"\n', "python") is None
    rows = "".join(f"  {k}: [{', '.join(str(i * 37 % 9973) for i in range(n, n + 40))}],\n" for n, k in enumerate("alpha beta gamma delta epsilon zeta eta theta iota".split()))
    assert why(f"export const table = {{\n{rows}}};\n", "typescript") == "data"


def test_headers_glued_passwords_and_literals_over_lines_are_candidates():
    values = lambda t, p="x.sh": {(c.line, c.value) for c in secrets.candidates(t, p)}
    assert (1, "3X2hfK2DMzVyzxtCAzU9") in values("curl -H 'X-Api-Key: 3X2hfK2DMzVyzxtCAzU9' https://h.invalid/v1\n")
    assert (1, "D8QlQpgUf4bK3") in values("mysqldump -u ingest -pD8QlQpgUf4bK3 kb > dump.sql\n") and not any(v == "x" for _, v in values("mkdir -p x/y\n"))
    assert (2, "abcZk39fQ1x") in values('x = 1;\nconst key = "abc" +\n  "Zk39fQ1x";\n', "a.js") and (1, "abcZk39fQ1x") in values('key = ("abc"\n       "Zk39fQ1x")\n', "a.py")
    assert (1, "Zk39fQ1xPw") in values('deploy --password Zk39fQ1xPw\n') and (1, "pa55word77") in values("curl -u bob:pa55word77 http://h\n")
    long = "a = 1; " * 30_000 + 'token = "Zk39fQ1xPw88";'
    assert (1, "Zk39fQ1xPw88") in values(long, "a.js")
