"""Driver tables in the shape of the store's tables. This tests the operators, not code understanding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import substrings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], object] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]) -> object:
    """What ``make`` stores of a folder's tables; made by the first query of a session that asks for it."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _STORED:
        _STORED[at] = make()
    return _STORED[at]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("file_path"), F.col("n_chars").alias("size_bytes"), F.md5("text").alias("content_hash"), F.col("lang").alias("language")
    )


def path_trigrams(spark: SparkSession, sf_dir: str) -> substrings.TrigramIndex:
    return stored(spark, sf_dir, "paths", lambda: substrings.build(files(spark, sf_dir), "file_path", ["file_id", "file_path"]))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), "p_name").alias("fqn"), F.col("p_brand").alias("containing_type"), (F.col("p_size") % 2 == 0).alias("is_public"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("file_path")
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the file of their nation, nations in that of their region, regions in their own."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("file_path"))
        .unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file_path")))
        .unionByName(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("world").alias("file_path")))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges: nation to region, customer to nation, and customer to the nation after it."""
    c, n = (table(spark, sf_dir, t) for t in ("customer", "nation"))
    at = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    return (
        n.select(at("n", "n_nationkey").alias("from"), at("r", "n_regionkey").alias("to"), F.lit("implements").alias("type"))
        .unionByName(c.select(at("c", "c_custkey").alias("from"), at("n", "c_nationkey").alias("to"), F.lit("di_injects").alias("type")))
        .unionByName(c.where("c_custkey % 7 = 0").select(at("c", "c_custkey").alias("from"), F.concat(F.lit("n"), ((F.col("c_nationkey") + 1) % 25).cast("string")).alias("to"), F.lit("tests").alias("type")))
    )


#: The same relations in SQL, to be put before the checking statements.
FILES_SQL = "files AS (SELECT doc_id AS file_id, source || '/' || doc_id || '.' || lang AS file_path, n_chars AS size_bytes, md5(text) AS content_hash, lang AS language FROM documents)"
SYMBOLS_SQL = "symbols AS (SELECT p_partkey AS symbol_id, p_name AS name, p_brand || '.' || p_name AS fqn, p_brand AS containing_type, p_size % 2 = 0 AS is_public, 'f' || p_size AS file_path FROM part)"
NODES_SQL = "nodes AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS file_path FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)"
EDGES_SQL = "edges AS (SELECT 'n' || n_nationkey AS f, 'r' || n_regionkey AS t, 'implements' AS type FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'di_injects' FROM customer UNION ALL SELECT 'c' || c_custkey, 'n' || (c_nationkey + 1) % 25, 'tests' FROM customer WHERE c_custkey % 7 = 0)"
