"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters, runs of digits and runs of other signs; besides the words' own
n-grams, n-grams of their shapes (capitals, lower case, mixed, digits, the sign itself, or a repeat)
are hashed into the same space. Shards of the labelled rows are trained on their own and
their weights averaged, so training needs no task that holds all of them.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, kind_of, stage

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BITS = 18
ORDERS = 2
SHAPE_ORDERS = 3
#: Words remembered by a Python worker.
CACHE_WORDS = 500_000
#: Shape of a word that repeats the one before it.
REPEAT = np.uint64(xxhash.xxh64_intdigest("=", 1))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[str, int] = {}
_SHAPES: dict[str, int] = {}


def shape(token: str) -> str:
    if token[0].isdigit():
        return "0"
    if not token[0].isalpha():
        return token[:4]
    return "a" if token.islower() else "A" if token.isupper() and len(token) > 1 else "Aa" if token[1:].islower() or len(token) == 1 else "aA"


def token_ids(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the words and of their shapes."""
    tokens = TOKEN.findall(text or "")
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear(), _SHAPES.clear()
    for t in set(tokens):
        if t not in _WORDS:
            _WORDS[t], _SHAPES[t] = xxhash.xxh64_intdigest(t.lower()), xxhash.xxh64_intdigest(shape(t), 1)
    words = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    shapes = np.fromiter(map(_SHAPES.__getitem__, tokens), np.uint64, len(tokens))
    shapes[1:][words[1:] == words[:-1]] = REPEAT
    return words, shapes


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots, each once, and values: log counts of the hashed n-grams, words and shapes each scaled to length one.

    Slot 0 is the bias; what is hashed to the same slot is summed up.
    """
    slots, values = [np.zeros(1, np.int64)], [np.ones(1)]
    for kind, (ids, orders) in enumerate(zip(token_ids(text), (ORDERS, SHAPE_ORDERS), strict=True)):
        grams, code = [], np.full(len(ids), 11 + kind, np.uint64)
        for order in range(orders):
            if len(ids) <= order:
                break
            code = (code[: len(ids) - order] * _MIX) ^ ids[order:]
            grams.append(((code * _MIX) >> np.uint64(32)) % np.uint64((1 << BITS) - 1) + np.uint64(1))
        if grams:
            slot, count = np.unique(np.concatenate(grams), return_counts=True)
            value = 1 + np.log(count)
            slots.append(slot.astype(np.int64)), values.append(value / math.sqrt((value * value).sum()))
    slots, back = np.unique(np.concatenate(slots), return_inverse=True)
    return slots, np.bincount(back, np.concatenate(values))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, slots=slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ values))))) - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 16_000, shard_rows: int = 4_000, epochs: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights by slot from at most ``max_labels`` labelled ids (the lowest hashes): the bound of the fit.

    Labels are read as zero or not; null labels and ids are left out and an id with several labels
    takes the smallest. Without labelled rows all weights are zero and every score is one half.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min((F.col(label_col) != 0).cast("int")).alias("label"))
    chosen = usable.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(max_labels)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # max_labels rows of two numbers

    def featurise(batches):
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))],
                ["id", "label", "slots", "values"],
            )

    kind = dict(rows.dtypes)["id"]
    featured = stage(rows.select("id", "text", "label").mapInArrow(featurise, f"id {kind}, label int, slots array<int>, values array<float>"), "quality-features")
    shards = max(1, math.ceil(featured.count() / shard_rows))

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort([xxhash.xxh64_intdigest(str(i)) for i in table.column("id").to_pylist()], kind="stable")
        slots, values, label = table.column("slots").to_pylist(), table.column("values").to_pylist(), table.column("label").to_pylist()
        rows = [(np.array(slots[i]), np.array(values[i]), label[i]) for i in order]
        model = Ftrl()
        for _ in range(epochs):
            for row in rows:
                model.update(*row)
        w = model.weights()
        hit = np.flatnonzero(w)
        return pa.table({"slot": pa.array(hit.astype(np.int32)), "weight": pa.array(w[hit])})

    dealt = featured.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(shards)))
    fitted = dealt.groupBy("shard").applyInArrow(fit, "slot int, weight double").groupBy("slot").agg(F.sum("weight").alias("weight")).toArrow()  # at most 2**BITS rows
    weights = np.zeros(1 << BITS)
    weights[fitted["slot"].to_numpy()] = fitted["weight"].to_numpy() / max(1, dealt.select("shard").distinct().count())
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for each row over its whole text; null and empty texts score by the bias alone.

    Ids have any type. Repeated rows and null ids are scored like others; an empty table gives no
    rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers

    def run(batches):
        w = shared.value
        for batch in batches:
            sums = np.array([w[s] @ v for s, v in (features(t.as_py()) for t in batch.column(1))] or [0.0])[: batch.num_rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    found = rows.mapInArrow(run, f"id {kind_of(rows, 'id')}, score double")
    return found.withColumnRenamed("id", id_col)


def op4_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    learnt = ~held_out(F.col("doc_id"), 4)
    weights = train(docs.where(learnt), labels.where(learnt))
    found = score(docs, weights)
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
