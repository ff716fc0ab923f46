"""Corpus pipeline: documents to deduplicated, decontaminated, mixed and sharded training data.

Each stage works on all rows that its predecessor kept and identifies them by a row number of
its own, so null and repeated ids and further columns are allowed everywhere; empty tables
give empty results. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import language_id as language
from loomdex.llm.common import discard, numbered_rows, shared_path, table, unused
from loomdex.llm.components import components
from loomdex.llm.decontaminate import decontaminated
from loomdex.llm.mixing import balanced_copies
from loomdex.llm.sharding import kd_shards
from loomdex.llm.simhash import near_duplicates
from loomdex.llm.similar import similar_components

#: Name of the row number; where documents have such a column the stages' has more underscores before it.
ROW = "__row"
SHARDS = 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose likeliest language has a posterior under one half.

    Where no document names its language there is nothing to tell languages by, and all with a letter stay.
    """
    pieces = language.vocabulary()
    languages, model = language.train(docs, pieces)
    if not languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.identified(docs, languages, model, pieces)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component: the smallest id, of repeated ids the first row.

    Documents are linked by SimHash fingerprints of four-word shingles at 4 or fewer differing bits, as in op3,
    and by a five-word similarity of 0.8, which fingerprints alone do not reach.
    """
    row = unused(docs.columns, ROW)
    rows = numbered_rows(docs, row)
    prints = near_duplicates(rows, id_col=row, words_per_shingle=4, max_bits=4).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    similar = similar_components(rows, id_col=row, words_per_shingle=5, least=0.8).select(F.col(row).alias("a"), F.col("component_id").alias("b"))
    rooted = components(prints.unionByName(similar), "near-classes").withColumnRenamed("node", "number")
    ids = rows.select(F.col(row).alias("number"), F.col("doc_id").alias("id")).join(rooted, "number", "left").withColumn("class", F.coalesce("root", "number"))
    first = ids.groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "number")).alias("first"))
    return rows.join(first.select(F.col("first.number").alias(row)), row, "left_semi").drop(row)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that each source's words come near its target."""
    row = unused(docs.columns, ROW)
    rows = numbered_rows(docs, row)
    copies = balanced_copies(rows, id_col=row, hash_col="doc_id").where("copies > 0").select(row, F.sequence(F.lit(1), "copies").alias(times := unused(docs.columns, "times")))
    return rows.join(copies, row).withColumn(times, F.explode(times)).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard and the slot within it to every document; columns of these names are replaced."""
    row = unused(docs.columns, ROW)
    rows = numbered_rows(docs.drop("shard", "slot"), row)
    placed = kd_shards(rows, n_shards=SHARDS, id_col=row).select(row, "shard", "slot")
    return rows.join(placed, row).drop(row)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: No stage but the row-wise ones can be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over the others' files, each of which goes when the next one is written; the last one's stay for who reads the result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        made = step(spark, docs, sf_dir)
        path = shared_path(spark, name)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
