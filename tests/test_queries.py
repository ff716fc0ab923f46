"""Every registered query of the reference's operators against its SQL, at the smallest size."""

import math
import os

import duckdb
import pytest
from loomdex import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that SQL does not express; each is held against plain Python in test_brute.py, test_code.py or test_graph.py.
PLAIN = set("grf1_expansion localize pck1_context_plan oth9_explained_plan rnk14_graph_discovery oth4_secret_positions red1_reduce_files ses3_unified_diffs met3_bootstrap_interval met6_stratified_sample fts5_stems pck15_exact_tokens".split())


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6g}"
    return None if value is None else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=str)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, sf_dir, name):
    frame = plans.queries()[name](spark, sf_dir)
    got = frame.collect()
    sql = plans.oracles().get(name)
    if sql is None:
        assert name in PLAIN, f"{name} has neither SQL nor a test against plain Python"
        assert got or name == "oth4_secret_positions"
        return
    want = duck.sql(sql)
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows(frame.columns, got) == rows(want.columns, want.fetchall())
