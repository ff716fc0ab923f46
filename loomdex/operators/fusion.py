"""Evidence fusion: noisy-or scores, capped priors, signal grades and selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Base weights of the candidate sources.
SOURCE_WEIGHTS = {
    "diff_changed_file": 1.00, "route_exact": 1.00, "symbol_exact": 0.95, "stack_trace": 0.95, "service_exact": 0.95, "request_exact": 0.95, "config_exact": 0.90,
    "fts_symbol": 0.75, "fts_path": 0.70, "fts_body": 0.55, "cochange": 0.45, "graph_neighbor": 0.40,
}
DEFAULT_WEIGHT = 0.50
#: Priors change the first so many candidates only.
PRIOR_DEPTH = 30
INSUFFICIENT, CONFIDENT, CLEAR_GAP, CLUSTER = 0.20, 0.55, 0.15, 3


def source_weight(source: Column) -> Column:
    out = None
    for name, weight in SOURCE_WEIGHTS.items():
        out = F.when(source == name, F.lit(weight)) if out is None else out.when(source == name, F.lit(weight))
    return out.otherwise(F.lit(DEFAULT_WEIGHT))


def noisy_or(candidates: DataFrame) -> DataFrame:
    """One row per node, or per file where there is no node: 1 minus the product of (1 - score).

    ``candidates``: node_id, file_path, score, source, tokens. Keeps the first best source by name,
    the distinct sources and the largest token estimate.
    """
    key = F.coalesce("node_id", F.concat(F.lit("file:"), "file_path"))
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score"))
    return candidates.groupBy(key.alias("key")).agg(
        F.min("file_path").alias("file_path"),
        (1 - F.product(1 - s)).alias("score"),
        F.min(F.struct((-s).alias("s"), "source"))["source"].alias("primary"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.max("tokens").alias("tokens"),
    )


def ranked(scored: DataFrame, depth: int | None = None) -> DataFrame:
    """Adds rank from 1 by score, then path, then key, to the best ``depth`` rows; others keep a null rank.

    The best rows are a top-k, so no task sorts them all.
    """
    order = [F.desc("score"), F.col("file_path"), F.col("key")]
    best = scored.orderBy(*order).limit(depth) if depth else scored
    numbered = best.select("key", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # depth rows
    return scored.join(F.broadcast(numbered) if depth else numbered, "key", "left")


def centrality_prior(scored: DataFrame, centrality: DataFrame, boost: float = 0.10, depth: int = PRIOR_DEPTH) -> DataFrame:
    """Scores of the first candidates raised by a share of their centrality (key, centrality 0 to 1), at most 1."""
    raised = F.least(F.lit(1.0), F.col("score") * (1 + boost * F.coalesce("centrality", F.lit(0.0))))
    return ranked(scored, depth).join(centrality, "key", "left").withColumn("score", F.when(F.col("rank").isNotNull(), raised).otherwise(F.col("score"))).drop("rank", "centrality")


def cochange_prior(scored: DataFrame, pairs: DataFrame, boost: float = 0.15, seeds: int = 8, depth: int = PRIOR_DEPTH) -> DataFrame:
    """Scores of the first candidates raised by the strongest Jaccard link (a, b, jaccard) to a seed that outscores them."""
    numbered = ranked(scored, depth)
    first = numbered.where(F.col("rank").isNotNull())
    seed = first.where(F.col("rank") <= seeds).select(F.col("file_path").alias("seed"), F.col("score").alias("seed_score"))
    both = pairs.select("a", "b", "jaccard").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    links = both.join(F.broadcast(seed), both["a"] == seed["seed"]).select("b", "seed_score", "jaccard")  # depth rows at most
    best = first.join(links, first["file_path"] == links["b"]).where("seed_score > score").groupBy("key").agg(F.max("jaccard").alias("j"))
    raised = F.least(F.lit(1.0), F.col("score") * (1 + boost * F.coalesce("j", F.lit(0.0))))
    return numbered.join(best, "key", "left").withColumn("score", F.when(F.col("rank").isNotNull(), raised).otherwise(F.col("score"))).drop("rank", "j")


def grade(scored: DataFrame) -> DataFrame:
    """One row: the number of candidates, the top score, the size of the leading cluster and the grade."""
    top = scored.agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("candidates"))
    lead = scored.crossJoin(F.broadcast(top)).agg(F.sum((F.col("score") >= F.col("top") - CLEAR_GAP).cast("long")).alias("cluster"))
    state = (
        F.when((F.col("candidates") == 0) | (F.col("top") < INSUFFICIENT), "insufficient")
        .when(F.col("top") < CONFIDENT, "partial")
        .when(F.col("candidates") == 1, "confident")
        .when((F.col("cluster") <= CLUSTER) & (F.col("cluster") < F.col("candidates")), "confident")
        .otherwise("partial")
    )
    return top.crossJoin(lead).select("candidates", "top", F.coalesce("cluster", F.lit(0)).alias("cluster"), state.alias("grade"))


def select_candidates(scored: DataFrame, strict: bool = False, most: int = 10) -> DataFrame:
    """The leading cluster if confident; else the best ``most``, or none if strict and the signal is insufficient."""
    g = grade(scored)
    order = [F.desc("score"), F.col("file_path"), F.col("key")]
    sure = scored.crossJoin(F.broadcast(g)).where("grade = 'confident' AND score >= top - 0.15")
    unsure = scored.crossJoin(F.broadcast(g)).where("grade = 'partial'" if strict else "grade <> 'confident'").orderBy(*order).limit(most)
    return sure.select(*scored.columns).unionByName(unsure.select(*scored.columns))


def content_dedup(rows: DataFrame, hashes: DataFrame, order: list[Column], key: str = "key") -> DataFrame:
    """The best row of each content hash (key, content_hash); rows without a hash all stay."""
    joined = rows.join(hashes, key, "left").withColumn("__h", F.coalesce("content_hash", F.concat(F.lit("\0"), F.col(key).cast("string"))))
    return joined.withColumn("__n", F.row_number().over(Window.partitionBy("__h").orderBy(*order))).where("__n = 1").drop("__n", "__h", "content_hash")


def changed_candidates(selected: DataFrame, changed: DataFrame) -> DataFrame:
    return selected.select("file_path").unionByName(changed.select("file_path")).distinct().withColumn("score", F.lit(1.0))


#: Words of a question that name nothing. Fixed values.
STOP_WORDS = frozenset("the and for with from that this when where what which how does add fix use into not are was".split())


def nearest_symbols(symbols: DataFrame, query: str, most: int = 8) -> DataFrame:
    """Symbols (name) whose names hold most of the question's words, without stop words; more words first, then shorter names."""
    words = sorted({w for w in re.findall(r"[a-z0-9]{3,}", query.lower()) if w not in STOP_WORDS})
    hits = sum((F.contains(F.lower("name"), F.lit(w)).cast("int") for w in words), F.lit(0))
    return symbols.select("name").distinct().withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), F.length("name"), "name").limit(most)


def entry_points(files: DataFrame, most: int = 5) -> DataFrame:
    """Files that programs begin in, by their names, those nearest the root first."""
    name = F.lower(F.regexp_extract("file_path", r"([^/]+)$", 1))
    begins = name.rlike(r"^(program|startup|main|app|index|__main__|server)\.[a-z]+$")
    return files.where(begins).select("file_path", (F.size(F.split("file_path", "/")) - 1).alias("depth")).orderBy("depth", "file_path").limit(most)


def navigation_areas(files: DataFrame, depth: int = 2, most: int = 6) -> DataFrame:
    """Areas (the first directories of the paths) with the most files."""
    parts = F.split("file_path", "/")
    area = F.array_join(F.slice(parts, 1, F.greatest(F.lit(1), F.least(F.lit(depth), F.size(parts) - 1))), "/")
    return files.groupBy(area.alias("area")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "area").limit(most)
