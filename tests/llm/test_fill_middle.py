import hashlib
import random
import re

import duckdb
import pytest
from loomdex.llm.fill_middle import MARKS, Runs, arranged, fill_in_middle, op12_fill_middle, restored
from loomdex.llm.queries import ORACLES
from pyspark.sql import functions as F

TEXTS = [None, "", "a", "é", "ab cd", " \n\t", "x<P>y", "<S", "a<", "naïve Straße 12 🙂🙂 end", "\x00a\x00", "ab" * 40000 + "1 2 3", "-" * 70000, "<<<>>>S>P>", "end<"]


def brute(doc, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(tokens)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def test_query_equals_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = op12_fill_middle(spark, sf_dir)
    want = connection.sql(ORACLES["op12_fill_middle"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_odd_texts_equal_brute_force_and_come_back(spark):
    rows = [(d, t, "f") for d, t in enumerate(TEXTS * 12)] + [(None, t, "f") for t in TEXTS] + [(7, "same id", "f")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    made = fill_in_middle(docs).withColumn("back", restored(F.col("form"), F.col("output")))
    got = [tuple(r) for r in made.collect()]
    assert sorted(got, key=str) == sorted((brute(d, t) for d, t, _ in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_other_ids_and_marks(spark):
    docs = spark.createDataFrame([("a", "one two three"), ("b", "<P> stays")], "name string, body string")
    made = fill_in_middle(docs, "name", "body", ("<pre>", "<suf>", "<mid>"), rearranged=100, suffix_first=100)
    assert {r["form"] for r in made.collect()} == {"spm"}
    assert {r["t"] for r in made.select(restored(F.col("form"), F.col("output"), ("<pre>", "<suf>", "<mid>")).alias("t")).collect()} == {"one two three", "<P> stays"}
    for marks in (("<a>", "<a>", "<b>"), ("a", "b", "c"), ("<a<>", "<b>", "<c>")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, "name", "body", marks)


def test_every_cut_is_found_in_its_run():
    draw = random.Random(3)
    for _ in range(200):
        text = "".join(draw.choice("abZ 1é🙂\n<") for _ in range(draw.randrange(40)))
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        runs = Runs(text)
        assert runs.n == len(tokens) and [runs.place(c) for c in range(runs.n + 1)] == [len("".join(tokens[:c])) for c in range(runs.n + 1)]
    assert arranged("ab", [0, 1, 0, 0], MARKS, 90, 20) == (1, "spm", 0, 2, "<S><P><M>ab")
