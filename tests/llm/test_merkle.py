import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from loomdex.llm import merkle
from loomdex.llm.queries import ORACLES
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, group string"
ODD = [(3, None, None, 1, None, "x", "y"), (3, None, None, 1, None, "x", "y"), (None, "s", "", 4, "a b", "x", "y"), (5, "s", "é", None, "ü" * 3, "x", "y"), (8, "", "é", 0, "", "x", "y"), (9, "s", "one", 2, "word " * 60000, "x", "y"), (14, "s", "é", 7, "z", "x", "y")]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out.append(level[i ^ 1] if i ^ 1 < len(level) else None)
        i //= 2
    return out


def fold(node, i, path):
    for other in path:
        node = digest((other + node if i % 2 else node + other) if other else node)
        i //= 2
    return node


def brute(docs):
    """Rows as manifest() gives them, in the query's columns, where the ids that crc32 picks are tampered with."""
    encode = lambda r: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)
    groups = defaultdict(list)
    for r in docs:
        leaf = digest(encode(r[:5]))
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        groups[r[2]].append((r[0], leaf, digest(encode((*r[:3], r[3] + 1, r[4]))) if hit else leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (doc, leaf, given) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            own, upper = siblings(trees[g], i), siblings(top, at)
            root = fold(fold(given, i, own), at, upper)
            out.append((doc, leaf, trees[g][-1][0], top[-1][0], digest("".join(x or "" for x in own + upper)), root, root == top[-1][0]))
    return sorted(out, key=str)


def found(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.manifest(docs, changed={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256), "folded_root", "verified")


def plain(frame):
    return sorted([tuple(r) for r in frame.collect()], key=str)


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = plain(merkle.op11_merkle_manifest(spark, sf_dir))
    assert got == sorted(connection.sql(ORACLES["op11_merkle_manifest"]).fetchall(), key=str)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS)
    assert got == brute([tuple(r) for r in docs.collect()])
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


@pytest.mark.parametrize("span", [1, 2, 8])
def test_odd_rows_and_passes_of_any_span(spark, monkeypatch, span):
    monkeypatch.setattr(merkle, "SPAN", span)
    rows = [*ODD, *[(100 + i, "s", "many", i, f"t{i}", "x", "y") for i in range(13)]]
    assert plain(found(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 5])
def test_small_tables(spark, size):
    rows = [(i, "s", "x", i, "t", "l", "g") for i in range(size)]
    assert plain(found(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_a_changed_field_of_any_kind_is_noticed(spark):
    docs = spark.createDataFrame([(i, "s", f"l{i % 3}", i, f"t{i}", "x", "y") for i in range(11)], SCHEMA)
    for field in ("doc_id", "source", "n_chars", "text"):
        rows = merkle.manifest(docs, changed={field: F.when(F.col("doc_id") == 4, F.lit(77).cast(docs.schema[field].dataType)).otherwise(F.col(field))})
        assert {r["doc_id"]: r["verified"] for r in rows.collect()} == {i: i != 4 for i in range(11)}


def test_proofs_look_nodes_up_by_coordinates_without_moving_texts(spark, sf_dir):
    plan = merkle.op11_merkle_manifest(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "text" not in plan
