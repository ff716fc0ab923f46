"""Store queries: upserts, lookups, aggregates, joins and set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests, store, substrings
from .fixtures import EDGES_SQL, FILES_SQL, NODES_SQL, SYMBOLS_SQL, edges, files, nodes, path_trigrams, stored, symbols, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "snk1_upsert",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part "
    "UNION ALL SELECT p_partkey + 1000000000, p_size + 1 FROM part WHERE p_partkey % 3 = 0",
)
def snk1(spark, d):
    old = table(spark, d, "part").select("p_partkey", "p_size")
    new = old.where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_size") + 1).alias("p_size"))
    return store.upsert(old, new.unionByName(new.select((F.col("p_partkey") + 1000000000).alias("p_partkey"), "p_size")), ["p_partkey"])


@query("snk1_last_write", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def snk1b(spark, d):
    return store.last_write(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("seq")), ["o_custkey"], "seq").drop("seq")


@query("snk3_cascade_delete", f"WITH {FILES_SQL} SELECT l.doc_id, l.quality FROM labels l JOIN files f ON f.file_id = l.doc_id WHERE f.language <> 'de'")
def snk3(spark, d):
    f = files(spark, d)
    chunks = table(spark, d, "labels").select("doc_id", "quality").join(f.select(F.col("file_id").alias("doc_id"), "file_path"), "doc_id")
    return store.cascade_delete({"chunks": (chunks, "file_path")}, f.where("language = 'de'"), "file_path")["chunks"].select("doc_id", "quality")


@query(
    "lkp1_list_symbols",
    f"WITH {SYMBOLS_SQL} SELECT symbol_id, name, is_public FROM symbols WHERE file_path IN ('f7', 'f8', 'f20') "
    f"ORDER BY is_public DESC, lower(name), symbol_id LIMIT 50",
)
def lkp1(spark, d):
    known = spark.createDataFrame([("f7",), ("f8",), ("f20",)], "file_path string")
    return store.list_symbols(symbols(spark, d), known, 50).select("symbol_id", "name", "is_public")


@query(
    "lkp2_find_symbols",
    f"WITH {SYMBOLS_SQL} SELECT symbol_id, name FROM symbols WHERE name ILIKE '%a_e%' ORDER BY is_public DESC, length(name), "
    f"lower(name), symbol_id LIMIT 25",
)
def lkp2(spark, d):
    return store.find_symbols(symbols(spark, d), "a_e", 25).select("symbol_id", "name")


@query(
    "lkp2_find_symbols_by_trigrams",
    f"WITH {SYMBOLS_SQL} SELECT symbol_id, name FROM symbols WHERE name ILIKE '%All%dGe%' ORDER BY is_public DESC, length(name), "
    f"lower(name), symbol_id LIMIT 25",
)
def lkp2_indexed(spark, d):
    """Names that hold two fragments, found through the trigram of the first; the second is too short for one."""
    s = symbols(spark, d)
    index = stored(spark, d, "names", lambda: substrings.build(s, "name", ["symbol_id", "name", "is_public"]))
    return store.find_symbols(s, "All%dGe", 25, index).select("symbol_id", "name")


@query(
    "lkp3_signatures_by_name",
    f"WITH {SYMBOLS_SQL}, asked AS (SELECT DISTINCT lower(name) AS asked FROM symbols ), "
    f"hit AS (SELECT asked, symbol_id, row_number() OVER (PARTITION BY asked ORDER BY is_public DESC, length(fqn), "
    f"fqn, symbol_id) AS rank FROM asked "
    f"JOIN symbols ON lower(name) = asked OR lower(fqn) = asked) SELECT asked, symbol_id, CAST(rank AS INTEGER) AS rank FROM hit "
    f"WHERE rank <= 3",
)
def lkp3(spark, d):
    s = symbols(spark, d)
    return store.signatures_by_name(s, s.select(F.col("name").alias("asked")), 3).select("asked", "symbol_id", "rank")


@query(
    "lkp4_members_of_type",
    f"WITH {SYMBOLS_SQL} SELECT symbol_id, containing_type FROM symbols "
    f"WHERE containing_type = 'Shop.Brand#13' OR containing_type = 'Brand#13' OR containing_type LIKE '%.Brand#13'",
)
def lkp4(spark, d):
    return store.members_of(symbols(spark, d), "Shop.Brand#13").select("symbol_id", "containing_type")


@query("lkp7_nodes_by_name", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = (SELECT lower(min(c_name)) FROM customer WHERE c_custkey = 7)")
def lkp7(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_name").alias("display_name"))
    name = c.where("c_custkey = 7").agg(F.min("c_name")).first()[0] or ""
    return store.nodes_named(c, name.upper()).select("c_custkey", "c_name")


@query("lkp8_nodes_by_file", f"WITH {NODES_SQL} SELECT node, file_path FROM nodes WHERE file_path = 'n3'")
def lkp8(spark, d):
    return nodes(spark, d).where("file_path = 'n3'")


@query(
    "lkp9_edges_with_evidence",
    f"WITH {FILES_SQL} SELECT l_orderkey, l_linenumber, f.file_path AS evidence_path FROM lineitem LEFT "
    f"JOIN files f ON l_partkey = f.file_id",
)
def lkp9(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("evidence_file_id"))
    return store.edges_with_evidence(e, files(spark, d)).select("l_orderkey", "l_linenumber", "evidence_path")


@query("lkp10_files_by_fragment", f"WITH {FILES_SQL} SELECT file_id, file_path FROM files WHERE file_path ILIKE '%C1/%' ORDER BY length(file_path), file_path LIMIT 30")
def lkp10(spark, d):
    return store.files_with(files(spark, d), "C1/", 30).select("file_id", "file_path")


@query("lkp10_files_by_trigrams", f"WITH {FILES_SQL} SELECT file_id, file_path FROM files WHERE file_path ILIKE '%C1/_2%' ORDER BY length(file_path), file_path LIMIT 30")
def lkp10_indexed(spark, d):
    return store.files_with(files(spark, d), "C1/_2", 30, path_trigrams(spark, d)).select("file_id", "file_path")


@query(
    "agg2_tokens_per_file",
    f"WITH {FILES_SQL} SELECT f.file_path, coalesce(sum(length(c.text)), 0)::BIGINT AS tokens, count(c.text) AS chunks FROM files f "
    f"LEFT JOIN conversations c ON c.conv_id = f.file_id GROUP BY 1",
)
def agg2(spark, d):
    f = files(spark, d)
    chunks = table(spark, d, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("file_id"), F.length("text").alias("tokens")).join(f.select("file_id", "file_path"), "file_id")
    return store.tokens_per_file(f, chunks)


@query("agg1_tokens_of_file", "SELECT coalesce(sum(length(text)), 0)::BIGINT AS tokens FROM conversations WHERE conv_id = 5")
def agg1(spark, d):
    return table(spark, d, "conversations").where("conv_id = 5").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("tokens"))


@query("agg3_language_counts", "SELECT coalesce(nullif(lang, ''), 'unknown') AS language, count(*) AS files FROM documents GROUP BY 1")
def agg3(spark, d):
    return store.language_counts(files(spark, d))


@query("agg4_table_counts", "SELECT 'files' AS table_name, count(*) AS rows FROM documents UNION ALL SELECT 'symbols', count(*) FROM part")
def agg4(spark, d):
    return store.table_counts({"files": table(spark, d, "documents"), "symbols": table(spark, d, "part")})


@query(
    "agg5_sessions",
    "SELECT session, max(changed) AS changed, count(DISTINCT kind) AS kinds "
    "FROM (SELECT user_id AS session, ts AS changed, 'a' AS kind FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, ts, 'b' "
    "FROM events WHERE event_id % 2 = 1) GROUP BY 1",
)
def agg5(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("session"), F.col("ts").alias("changed"))
    return store.sessions({"a": e.where("event_id % 2 = 0"), "b": e.where("event_id % 2 = 1")})


@query(
    "join1_file_dependencies",
    f"WITH {NODES_SQL}, {EDGES_SQL} SELECT a.file_path AS from_file, b.file_path AS to_file, type FROM edges JOIN nodes a ON a.node = f "
    f"JOIN nodes b ON b.node = t WHERE a.file_path <> b.file_path",
)
def join1(spark, d):
    return store.file_dependencies(edges(spark, d), nodes(spark, d))


@query("join2_hashes_of_paths", f"WITH {FILES_SQL} SELECT file_path, content_hash FROM files WHERE file_id IN (SELECT doc_id FROM labels)")
def join2(spark, d):
    return files(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("file_id")), "file_id", "left_semi").select("file_path", "content_hash")


@query("join3_files_by_language", f"WITH {FILES_SQL} SELECT file_path FROM files WHERE language = 'es'")
def join3(spark, d):
    return files(spark, d).where("language = 'es'").select("file_path").orderBy("file_path")


@query(
    "join4_pairs_touching_seeds",
    "SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_orderkey IN (SELECT doc_id "
    "FROM labels) OR l_partkey IN (SELECT doc_id FROM labels)",
)
def join4(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    return store.touching(pairs, table(spark, d, "labels").select(F.col("doc_id").alias("path")))


@query("join5_prune", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def join5(spark, d):
    return store.prune(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").where("lang <> 'en'"), "doc_id")


@query(
    "set1_manifest_difference",
    "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN o.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS state, o.n_chars AS was, n.n_chars AS now "
    "FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 3) o FULL "
    "JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 0 END AS n_chars FROM documents "
    "WHERE doc_id % 10 <> 4) n ON o.doc_id = n.doc_id WHERE n.doc_id IS NULL OR o.doc_id IS NULL OR o.n_chars IS DISTINCT "
    "FROM n.n_chars",
)
def set1(spark, d):
    f = table(spark, d, "documents").select("doc_id", "n_chars")
    new = f.where("doc_id % 10 <> 4").withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 10 == 5).cast("int"))
    return store.manifest_difference(f.where("doc_id % 10 <> 3"), new, "doc_id", "n_chars")


@query("set1_difference_of_trees", SQL["set1_manifest_difference"])
def set1_trees(spark, d):
    """The same from two hash trees, of which the leaves that differ are read."""
    f = table(spark, d, "documents").select("doc_id", "n_chars")
    new = f.where("doc_id % 10 <> 4").withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 10 == 5).cast("int"))
    trees = [manifests.build(x, "doc_id", "n_chars") for x in (f.where("doc_id % 10 <> 3"), new)]
    return manifests.difference(spark, *trees)


@query(
    "union5_canonical_union",
    "SELECT o_custkey, arg_min(o_orderkey, k) AS o_orderkey, count(DISTINCT o_orderpriority) AS targets "
    "FROM (SELECT *, o_orderpriority || lpad(o_orderkey::VARCHAR, 12, '0') AS k FROM orders) GROUP BY 1",
)
def union5(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    first, available = store.canonical_union(o, "o_custkey", "o_orderpriority", [F.col("o_orderpriority"), F.col("o_orderkey")])
    return first.select("o_custkey", "o_orderkey").join(available.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("targets")), "o_custkey")


@query(
    "int1_integrity",
    "SELECT 'schema_version is set' AS \"check\", true AS ok, 1 AS detail UNION ALL SELECT 'mode is set', false, 0 "
    "UNION ALL SELECT 'symbols have chunks', count(*) = 0, count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
)
def int1(spark, d):
    meta = spark.createDataFrame([("schema_version", "1")], "key string, value string")
    return store.integrity(meta, symbols(spark, d), table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol_id")))


@query("int2_inventory_digest", f"WITH {FILES_SQL} SELECT sha256(string_agg(file_path || chr(0) || content_hash || chr(0), '' ORDER BY file_path)) AS digest FROM files")
def int2(spark, d):
    return store.inventory_digest(files(spark, d))
