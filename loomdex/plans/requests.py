"""Whole requests, emission and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import emit, localize
from ..operators.reduce import SECRETS
from . import ranking
from .fixtures import edges, files, nodes, table
from .texts import PLAN_SQL, plan_rows

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("localize")
def localization(spark, d):
    """Files (a source and language) for a question, from the texts and the paths."""
    chunks = ranking.docs(spark, d)
    hashes = chunks.groupBy("file_path").agg(F.min("content_hash").alias("content_hash"))
    return localize.localize(chunks, chunks.select("file_path").distinct(), localize.Request(query="thing in src3 of theatre", fields=ranking.WEIGHTS), ranking.stored(spark, d), hashes=hashes)


@query("pck1_context_plan")
def pck1(spark, d):
    seeds = spark.createDataFrame([("n3", 1.0)], "node string, score double")
    costs = nodes(spark, d).groupBy("file_path").agg((F.count(F.lit(1)) * 100).alias("cost"))
    return localize.context_plan(edges(spark, d), nodes(spark, d), seeds, costs, localize.Request(budget=4000)).select("path", F.round("score", 6).alias("score"), "role", "tier", "cost", "kept")


@query("rnk14_graph_discovery")
def rnk14(spark, d):
    ranked = spark.createDataFrame([("r1", 0.9), ("r2", 0.5), ("r3", 0.1)], "file_path string, score double")
    return localize.graph_discovery(edges(spark, d), nodes(spark, d), ranked)


@query("snk6_xml_entries", "SELECT doc_id, '<file path=\"' || source || '\">' || chr(10) || text || chr(10) || '</file>' AS entry FROM documents")
def snk6(spark, d):
    return table(spark, d, "documents").select("doc_id", emit.entry(F.col("source"), F.col("text"), "xml").alias("entry"))


@query(
    "snk7_emit",
    "SELECT source AS part, count(*) AS entries, md5(string_agg('# ' || doc_id || chr(10) || lang, chr(10) ORDER BY doc_id)) AS digest "
    "FROM documents GROUP BY 1",
)
def snk7(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("part"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("body"))
    return emit.emit(rows, "compact").select("part", "entries", F.md5(F.col("text").cast("binary")).alias("digest"))


_ENTRY = "CASE WHEN doc_id % 3 = 0 THEN '[unchanged] a&' || doc_id ELSE '<file path=\"a&amp;' || doc_id || '\">' || chr(10) || lang || chr(10) || '</file>' END"


@query("snk7_emit_xml", f"SELECT source AS part, count(*) AS entries, md5(string_agg({_ENTRY}, chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def snk7_xml(spark, d):
    """Files that the session has already are a line; paths are escaped in attributes."""
    rows = table(spark, d, "documents").select(F.col("source").alias("part"), F.col("doc_id").alias("seq"), F.concat(F.lit("a&"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("body"))
    return emit.emit(rows, "xml", F.col("seq") % 3 == 0).select("part", "entries", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "man1_manifest",
    f"WITH {PLAN_SQL} SELECT CASE WHEN must_keep THEN 'exact-seed' ELSE 'dependency' END AS role, CASE WHEN must_keep THEN 'reduced' ELSE 'skeleton' END AS tier, count(*) AS files, sum(CASE WHEN cost < 900 THEN 1 ELSE 0 END)::BIGINT AS kept, sum(cost)::BIGINT AS tokens "
    f"FROM p GROUP BY 1, 2",
)
def man1(spark, d):
    rows = plan_rows(spark, d).withColumn("role", F.when(F.col("must_keep"), "exact-seed").otherwise("dependency")).withColumn("tier", F.when(F.col("must_keep"), "reduced").otherwise("skeleton")).withColumn("kept", F.col("cost") < 900)
    return emit.manifest(rows)


@query("ses4_regraded_claims", "SELECT doc_id, CASE WHEN lang IN (SELECT lang FROM documents WHERE doc_id = 3) THEN 'stale' ELSE 'proven' END AS grade FROM documents")
def ses4(spark, d):
    t = table(spark, d, "documents")
    claims = t.select("doc_id", F.col("lang").alias("path"), F.lit("proven").alias("grade"))
    return emit.regrade(claims, t.where("doc_id = 3").select(F.col("lang").alias("path"))).select("doc_id", "grade")


@query("oth4_secret_positions")
def oth4(spark, d):
    return emit.secret_positions(table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text"), SECRETS)


@query("oth4_hotspots", "SELECT doc_id AS path, n_chars AS tokens FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def oth4b(spark, d):
    return emit.hotspots(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("tokens")))


@query("oth4_unlinked_files", "SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
def oth4c(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("from_file"), F.col("l_partkey").alias("to_file"))
    return emit.unlinked(table(spark, d, "part").select(F.col("p_partkey").alias("path")), li)


@query(
    "oth5_surface_survival",
    "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents), "
    "s AS (SELECT DISTINCT p_brand AS category, p_name AS name FROM part) SELECT category, round(avg(CASE WHEN name IN (SELECT name "
    "FROM w) THEN 1.0 ELSE 0 END), 6) AS survived FROM s GROUP BY 1",
)
def oth5(spark, d):
    found = emit.surface_survival(table(spark, d, "part").select(F.col("p_brand").alias("category"), F.col("p_name").alias("name")), table(spark, d, "documents"))
    return found.withColumn("survived", F.round("survived", 6))


@query("oth6_remedies", "SELECT event_id, CASE WHEN event_type LIKE '%a%' THEN 'first' WHEN event_type LIKE '%c%' THEN 'second' END AS remedy FROM events")
def oth6(spark, d):
    return emit.remedies(table(spark, d, "events").select("event_id", F.col("event_type").alias("message")), [("first", "a"), ("second", "c")]).select("event_id", "remedy")


@query(
    "oth7_solutions",
    "SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY string_split(path, '/')[2] ORDER BY tier, path) AS n "
    "FROM (SELECT source || '/' || lang || '.sln' AS path, min(doc_id) % 3 AS tier FROM documents GROUP BY 1)) WHERE n = 1",
)
def oth7(spark, d):
    t = table(spark, d, "documents").groupBy(F.concat("source", F.lit("/"), "lang", F.lit(".sln")).alias("path")).agg((F.min("doc_id") % 3).alias("tier"))
    return emit.choose_solutions(t).select("path")


@query(
    "oth8_load_tiers",
    "SELECT o_custkey, CASE WHEN loaded = 0 THEN 'syntax' WHEN loaded < n OR bad > 0 THEN 'graph-grade' ELSE 'oracle-grade' END AS tier "
    "FROM (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END) AS loaded, sum(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS bad "
    "FROM orders GROUP BY 1)",
)
def oth8(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("o_orderstatus") != "O").cast("int")).alias("loaded"), F.sum((F.col("o_totalprice") > 300000).cast("int")).alias("bad"))
    return n.select("o_custkey", emit.load_tier(F.col("n"), F.col("loaded"), F.col("bad")).alias("tier"))
