"""Graph queries over typed edges of nations, regions and customers, and over the parts of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, history
from .fixtures import EDGES_SQL, FILES_SQL, NODES_SQL, edges, files, nodes, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_DEGREE = "deg AS (SELECT node, count(*) AS degree FROM (SELECT f AS node FROM edges UNION ALL SELECT t FROM edges) GROUP BY 1)"


@query("grf7_normalised_degree", f"WITH {EDGES_SQL}, {_DEGREE} SELECT node, round(degree * 1.0 / (SELECT max(degree) FROM deg), 6) AS centrality FROM deg")
def grf7(spark, d):
    return graph.normalised_degree(edges(spark, d)).withColumn("centrality", F.round("centrality", 6))


@query(
    "grf6_central_files",
    f"WITH {EDGES_SQL}, {NODES_SQL}, {_DEGREE} SELECT file_path, max(degree) AS degree FROM nodes JOIN deg USING (node) "
    f"WHERE file_path LIKE 'n%' GROUP BY 1 ORDER BY degree DESC, file_path LIMIT 12",
)
def grf6(spark, d):
    return graph.central_files(edges(spark, d), nodes(spark, d), "N", 12)


def _trade(spark, d):
    """Nation of the customer to the nation of the supplier, each pair once."""
    li, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(s, F.col("l_suppkey") == s["s_suppkey"])
    return joined.where("(c_nationkey * 7 + s_nationkey) % 5 = 1 AND c_nationkey <> 3").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("from"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("to")).distinct()


def _pagerank_sql() -> str:
    out = "WITH links AS (SELECT DISTINCT 'n' || c_nationkey AS f, 'n' || s_nationkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE (c_nationkey * 7 + s_nationkey) % 5 = 1 AND c_nationkey <> 3), "
    out += "outs AS (SELECT f, count(*) AS o FROM links GROUP BY 1), ns AS (SELECT f AS node FROM links UNION SELECT t FROM links), num AS (SELECT count(*) AS n FROM ns), r0 AS MATERIALIZED (SELECT node, o, 1.0::DOUBLE / n AS rank FROM ns LEFT JOIN outs ON node = f, num)"
    for i in range(1, 21):
        p = f"r{i - 1}"
        out += f", r{i} AS MATERIALIZED (SELECT a.node, a.o, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM {p} WHERE o IS NULL) / n) AS rank FROM {p} a LEFT JOIN (SELECT t AS node, sum(rank / o) AS got FROM links JOIN {p} ON f = node GROUP BY 1) g USING (node), num)"
    return out + " SELECT node, round(rank / (SELECT max(rank) FROM r20), 6) AS rank FROM r20"


@query("grf8_pagerank", _pagerank_sql())
def grf8(spark, d):
    return graph.pagerank(_trade(spark, d)).withColumn("rank", F.round("rank", 6))


@query("grf1_expansion")
def grf1(spark, d):
    """Best-first expansion from two nations; checked against a heap in the tests (the withdrawal of labels has no plain SQL)."""
    seeds = spark.createDataFrame([("n3", 1.0), ("r1", 0.8)], "node string, score double")
    return graph.expand(edges(spark, d), seeds, depth=2, threshold=0.01).select("node", F.round("score", 9).alias("score"), "hop", "via")


@query(
    "grf2_edge_weights",
    f"WITH {EDGES_SQL} SELECT type, CASE type WHEN 'implements' THEN 0.9 WHEN 'di_injects' THEN 0.75 WHEN 'tests' THEN 0.65 ELSE 0.1 END::DOUBLE AS weight, count(*) AS edges "
    f"FROM (SELECT CASE WHEN f LIKE 'c%5' THEN 'hosted_service' ELSE type END AS type FROM edges) GROUP BY 1",
)
def grf2(spark, d):
    kind = F.when(F.col("from").like("c%5"), "hosted_service").otherwise(F.col("type"))
    return edges(spark, d).groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("edges")).select("type", graph.edge_weight(F.col("type")).alias("weight"), "edges")


@query(
    "grf3_neighbourhood",
    f"WITH {EDGES_SQL}, {NODES_SQL}, own AS (SELECT node FROM nodes WHERE file_path = 'r1'), "
    f"x AS (SELECT t AS node, '-> ' || type AS reason, 0 AS ord FROM edges WHERE f IN (SELECT node FROM own) "
    f"UNION ALL SELECT f, '<- ' || type, 1 FROM edges WHERE t IN (SELECT node FROM own)), y AS (SELECT file_path, reason, ord FROM x "
    f"JOIN nodes USING (node) UNION ALL SELECT file_path, 'same folder', 2 FROM nodes "
    f"WHERE regexp_replace(file_path, '/?[^/]*$', '') = '') SELECT file_path, arg_min(reason, (ord, reason)) AS reason, min(ord)::INTEGER AS \"order\" "
    f"FROM y WHERE file_path <> 'r1' GROUP BY 1",
)
def grf3(spark, d):
    return graph.neighbourhood(edges(spark, d), nodes(spark, d), "r1")


@query("grf4_callers", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT DISTINCT node, file_path FROM edges JOIN nodes ON node = f WHERE t = 'n5'")
def grf4(spark, d):
    return graph.callers(edges(spark, d), nodes(spark, d), "n5")


@query("grf4b_covering_tests", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT DISTINCT node, file_path FROM edges JOIN nodes ON node = f WHERE t = 'n5' AND type = 'tests'")
def grf4b(spark, d):
    return graph.callers(edges(spark, d), nodes(spark, d), "n5", "tests")


@query("grf5_resolve", f'WITH {EDGES_SQL} SELECT DISTINCT t AS "to" FROM edges WHERE type = \'implements\' AND f = \'n7\'')
def grf5(spark, d):
    return graph.resolve(edges(spark, d), "implements", "n7")


@query(
    "grf15_cochanges",
    "WITH x AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), k AS (SELECT l_orderkey FROM x GROUP BY 1 "
    "HAVING count(*) <= 40), s AS (SELECT x.* FROM x JOIN k USING (l_orderkey)), c AS (SELECT l_partkey, count(*) AS c FROM s "
    "GROUP BY 1), p AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM s a "
    "JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 "
    "HAVING count(*) >= 2) SELECT a, b, n AS \"count\", round(log2(n * (SELECT count(*) FROM k) / (ca.c * cb.c)), "
    "6) AS pmi, round(n / (ca.c + cb.c - n), 6) AS jaccard FROM p JOIN c ca ON ca.l_partkey = a JOIN c cb ON cb.l_partkey = b",
)
def grf15(spark, d):
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"), F.col("l_shipdate").alias("date"))
    return graph.cochanges(changes).select("a", "b", "count", F.round("pmi", 6).alias("pmi"), F.round("jaccard", 6).alias("jaccard"))


def in_batches(spark, d, batches=4):
    """The history of all orders, added in batches of whole ones."""
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"), F.col("l_shipdate").alias("date"))
    held = history.started(changes)
    for i in range(batches):
        held = history.added(held, changes.where(F.col("commit") % batches == i))
    return held


@query("grf15_cochanges_by_batches", SQL["grf15_cochanges"])
def grf15_batches(spark, d):
    return history.cochanges(spark, in_batches(spark, d)).select("a", "b", "count", F.round("pmi", 6).alias("pmi"), F.round("jaccard", 6).alias("jaccard"))


@query(
    "grf12_proximity_edges",
    "WITH s AS (SELECT p_partkey::VARCHAR AS file_path, p_brand || '/' || p_type AS st FROM part), "
    "g AS (SELECT lower(string_split(st, '/')[-1]) || p.file_path[1:2] AS stem, file_path FROM s p), n AS (SELECT stem FROM g "
    "GROUP BY 1 "
    "HAVING count(*) BETWEEN 2 AND 4) SELECT a.file_path || '/' || a.stem || '.cs' AS a, b.file_path || '/' || b.stem || '.cs' AS b "
    "FROM g a JOIN g b USING (stem) JOIN n USING (stem) "
    "WHERE a.file_path || '/' || a.stem || '.cs' < b.file_path || '/' || b.stem || '.cs'",
)
def grf12(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    return graph.proximity_edges(p.select(F.concat(key, F.lit("/"), F.lower("p_type"), F.substring(key, 1, 2), F.lit(".cs")).alias("file_path")))


@query(
    "grf13_owning_project",
    f"WITH {FILES_SQL} SELECT file_path, string_split(file_path, '/')[1] AS project_dir FROM files "
    f"WHERE language = 'fr' AND string_split(file_path, '/')[1] <> 'src2'",
)
def grf13(spark, d):
    projects = table(spark, d, "documents").where("source <> 'src2'").select(F.col("source").alias("project_dir")).distinct()
    return graph.owning_project(files(spark, d).where("language = 'fr'"), projects)


@query(
    "grf9_reference_edges",
    "SELECT DISTINCT u.l_orderkey AS a, s.p AS b FROM lineitem u JOIN (SELECT l_orderkey AS p, l_partkey FROM lineitem "
    "WHERE l_linenumber = 1) s ON u.l_partkey = s.l_partkey WHERE u.l_orderkey <> s.p AND u.l_linenumber = 2",
)
def grf9(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_partkey").alias("type"), "l_linenumber")
    return graph.reference_edges(li.where("l_linenumber = 2"), li.where("l_linenumber = 1"))


@query("grf11_seed_cascade", f"WITH {FILES_SQL} SELECT file_path, 3 AS level FROM files WHERE file_path LIKE 'src7/%'")
def grf11(spark, d):
    return graph.seed_cascade(files(spark, d), files(spark, d).select("file_path", F.col("language").alias("type")), "SRC7/")


@query(
    "oth1_grouped_links",
    f"WITH {EDGES_SQL}, {NODES_SQL} SELECT a.file_path AS from_file, b.file_path AS to_file, count(*) AS links, min(type) AS type "
    f"FROM edges JOIN nodes a ON a.node = f JOIN nodes b ON b.node = t WHERE a.file_path <> b.file_path GROUP BY 1, 2",
)
def oth1(spark, d):
    from ..operators.store import file_dependencies

    return graph.grouped_links(file_dependencies(edges(spark, d), nodes(spark, d)))


@query(
    "oth2_directory_rollup",
    f"WITH {FILES_SQL} SELECT string_split(a.file_path, '/')[1] AS from_dir, string_split(b.file_path, '/')[1] AS to_dir, count(*) AS links "
    f"FROM files a JOIN files b ON b.file_id = a.file_id + 1 "
    f"WHERE string_split(a.file_path, '/')[1] <> string_split(b.file_path, '/')[1] GROUP BY 1, 2",
)
def oth2(spark, d):
    f = files(spark, d)
    links = f.select((F.col("file_id") + 1).alias("file_id"), F.col("file_path").alias("from_file")).join(f.select("file_id", F.col("file_path").alias("to_file")), "file_id")
    return graph.directory_rollup(links)


@query(
    "oth2_directory_totals",
    f"WITH {FILES_SQL} SELECT min(dir) AS directory, count(*) AS files, sum(size_bytes)::BIGINT AS tokens, round(sum(file_id % 7 / 8.0), 4)::DOUBLE AS centrality "
    "FROM (SELECT *, CASE WHEN file_id % 2 = 0 THEN upper(string_split(file_path, '/')[1]) ELSE string_split(file_path, '/')[1] END AS dir FROM files) GROUP BY lower(dir)",
)
def oth2_totals(spark, d):
    """Files, tokens and centrality of each folder; every second path is in capitals."""
    f = files(spark, d).withColumn("file_path", F.when(F.col("file_id") % 2 == 0, F.upper("file_path")).otherwise(F.col("file_path")))
    return graph.directory_totals(f.select("file_path", F.col("size_bytes").alias("tokens"), (F.col("file_id") % 7 / 8.0).alias("centrality")))
