from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import access as A
from quern.operators.chunking import ocr_summary


def test_rules(spark):
    users = spark.createDataFrame(
        [("u1", "Ann@X.org", ["Dev"], None), ("u2", "bob@y.org", None, ["Admin"]), ("u3", "eve@z.org", [], []), ("u4", None, None, None)], "user_id string, email string, groups array<string>, roles array<string>"
    )
    rules = spark.createDataFrame(
        [("r1", 2, "*@x.org", ["read"]), ("r2", 1, "group:dev", ["write"]), ("r3", 5, "role:admin", ["admin"]), ("r4", 9, "BOB@y.org", ["read"])], "rule_id string, priority int, pattern string, scopes array<string>"
    )
    got = {r.user_id: (r.rule_id, r.scopes) for r in A.match_rules(users, rules, ["none"]).collect()}
    assert got == {"u1": ("r2", ["write"]), "u2": ("r3", ["admin"]), "u3": (None, ["none"]), "u4": (None, ["none"])}
    asked = spark.createDataFrame([(["admin"], ["a", "b"]), (["a"], ["a", "b"]), (["a"], [])], "granted array<string>, required array<string>")
    assert A.permitted(asked).count() == 2
    tokens = spark.createDataFrame([("t1", ["p", "off"]), ("t2", None), ("t3", [])], "token_id string, instances array<string>")
    inst = spark.createDataFrame([("p", True), ("off", False), ("main", True)], "instance string, enabled boolean")
    assert {tuple(r) for r in A.reachable_instances(tokens, inst, "main").collect()} == {("t1", "p"), ("t2", "main"), ("t3", "main")}


def test_pdf_dates(spark):
    rows = ["D:20240131120000+02'00'", "D:20240131", "20240131120000Z", "D:2024", "D:20241399", "junk", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, d string")
    got = [str(r[0]) for r in df.orderBy("i").select(F.date_format(T.pdf_date(F.col("d")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-01-31 10:00", "2024-01-31 00:00", "2024-01-31 12:00", "2024-01-01 00:00", "None", "None", "None"]


def test_ocr_summary(spark):
    pages = spark.createDataFrame([(1, 90.0, False), (1, 80.0, None), (1, 1.0, True), (2, 5.0, True)], "doc_id int, confidence double, skipped boolean")
    assert {tuple(r) for r in ocr_summary(pages).collect()} == {(1, 85.0, 3, 1), (2, None, 1, 1)}
