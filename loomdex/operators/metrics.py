"""Retrieval metrics, percentiles, bootstrap intervals and seeded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def set_metrics(retrieved: DataFrame, truth: DataFrame, query: str = "query", item: str = "item") -> DataFrame:
    """recall, precision and f1 per query; recall of an empty truth is 1, precision of nothing retrieved is 0."""
    r = retrieved.select(query, item).distinct().withColumn("r", F.lit(1))
    t = truth.select(query, item).distinct().withColumn("t", F.lit(1))
    n = r.join(t, [query, item], "full").groupBy(query).agg(F.sum(F.coalesce("r", F.lit(0)) * F.coalesce("t", F.lit(0))).alias("hit"), F.coalesce(F.sum("r"), F.lit(0)).alias("got"), F.coalesce(F.sum("t"), F.lit(0)).alias("want"))
    recall = F.when(F.col("want") == 0, F.lit(1.0)).otherwise(F.col("hit") / F.col("want"))
    precision = F.when(F.col("got") == 0, F.lit(0.0)).otherwise(F.col("hit") / F.col("got"))
    return n.select(query, recall.alias("recall"), precision.alias("precision")).withColumn("f1", F.when(F.col("recall") + F.col("precision") == 0, F.lit(0.0)).otherwise(2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))))


def ranked_metrics(ranking: DataFrame, truth: DataFrame, k: int = 10, query: str = "query", item: str = "item") -> DataFrame:
    """Reciprocal rank, recall@k and binary nDCG@k per query of ``truth``; ``ranking`` has rank from 1."""
    t = truth.select(query, item).distinct()
    want = t.groupBy(query).agg(F.count(F.lit(1)).alias("want"))
    hits = ranking.join(t, [query, item], "left_semi")
    gain = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(F.lit(0.0))
    got = hits.groupBy(query).agg(F.max(1 / F.col("rank")).alias("rr"), F.sum((F.col("rank") <= k).cast("int")).alias("top"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k).cast("long"), F.col("want"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return want.join(got, query, "left").select(query, zero("rr").alias("reciprocal_rank"), zero(F.col("top") / F.col("want")).alias("recall_at_k"), zero(F.col("dcg") / ideal).alias("ndcg_at_k"))


def summary(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    return values.groupBy(*by).agg(F.avg(column).alias("mean"), F.expr(f"percentile({column}, 0.5)").alias("median"), F.expr(f"percentile({column}, 0.95)").alias("p95"), F.count(F.lit(1)).alias("n"))


#: Chances of a weight of 0, at most 1, and so on in a Poisson draw of mean 1.
POISSON = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563])
#: Rows that a task draws weights for at a time.
ROWS_AT_A_TIME = 256


def bootstrap_interval(values: DataFrame, column: str, resamples: int = 2000, seed: int = 1469, level: float = 0.95) -> DataFrame:
    """Interval of the mean by Poisson resampling: every row draws its weight for every resample from a hash of its id.

    ``values`` has an id column; equal input gives equal intervals. A task adds up two sums for each resample, so
    rows are neither copied nor collected.
    """

    def run(batches):
        v, w = np.zeros(resamples), np.zeros(resamples)
        turns = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            ids, values = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(ids), ROWS_AT_A_TIME):
                x = ids[at : at + ROWS_AT_A_TIME, None] + turns
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                drawn = np.searchsorted(POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), "right")
                v += values[at : at + ROWS_AT_A_TIME] @ drawn
                w += drawn.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(v), pa.array(w)], ["resample", "v", "w"])

    rows = values.where(F.col(column).isNotNull()).select(F.xxhash64("id", F.lit(seed)).alias("h"), F.col(column).cast("double").alias("v"))
    sums = rows.mapInArrow(run, "resample long, v double, w double").groupBy("resample").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    means = sums.select((F.col("v") / F.nullif("w", F.lit(0.0))).alias("mean"))
    tail = (1 - level) / 2
    return means.agg(F.expr(f"percentile(mean, {tail})").alias("low"), F.expr(f"percentile(mean, {1 - tail})").alias("high"))


def stratified_sample(rows: DataFrame, by: str, key: str, most: int, seed: int = 1) -> DataFrame:
    """At most ``most`` rows of each stratum, those with the lowest seeded hashes."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def paired_deltas(runs: DataFrame, task: str, arm: str, value: str, first: str, second: str) -> DataFrame:
    """Mean per task and arm, and the difference of two arms per task."""
    mean = runs.groupBy(task).pivot(arm, [first, second]).agg(F.avg(value))
    return mean.select(task, F.col(first), F.col(second), (F.col(second) - F.col(first)).alias("delta"))
