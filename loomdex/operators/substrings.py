"""A stored substring index: rows by the trigrams of a text, for finders by a fragment with wildcards.

A posting is a trigram (in lower case) and the row's key with the columns that a finder returns. Short texts, such as
names and paths, stand in their postings, so a search reads the postings of one trigram, the rarest of
the fragment, and verifies them where they are; of long texts the keys alone do, and the texts of the
rows that have every asked trigram are fetched and verified. Postings lie in buckets of a hash of the trigram,
and a second table counts the rows of each. A fragment without three characters in a row has no
trigram, so that all rows are verified, as a scan would.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

#: Tasks that share a bucket, so that no common trigram is one task's.
SLICES = 4
#: Trigrams of a fragment, rarest first, that rows of long texts must have before their texts are fetched.
ASKED = 4
#: Bytes of text whose trigrams a task makes at a time.
BYTES_AT_A_TIME = 4 << 20


def grams(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The distinct trigrams of each text: the texts' numbers, and a trigram for each."""
    joined = "".join(t or "" for t in texts.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t.as_py() or "") for t in texts], np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[2:] == text[:-2]
    codes, text = (points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:])[inside], text[:-2][inside]
    names, number = np.unique(codes, return_inverse=True)
    each = np.unique(text * max(1, len(names)) + number)
    mask = np.uint64((1 << 21) - 1)
    triples = np.c_[names >> np.uint64(42), names >> np.uint64(21) & mask, names & mask].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    named = pa.array([triples[i : i + 3] for i in range(0, len(triples), 3)], pa.string())
    return each // max(1, len(names)), named.take(pa.array(each % max(1, len(names))))


def with_grams(rows: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """(gram, rows): the ``carry`` columns of rows with a trigram in their text in lower case, some texts' together."""

    def run(batches):
        for batch in batches:
            lower = batch.column(0)
            size = np.cumsum(pc.binary_length(lower).fill_null(0).to_numpy(zero_copy_only=False))
            ends = [*(np.flatnonzero(np.diff(size // BYTES_AT_A_TIME)) + 1), batch.num_rows]
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                at, gram = grams(lower[a:b])
                coded = gram.dictionary_encode()
                code = coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                held = pa.StructArray.from_arrays([c[a:b].take(pa.array(at[order])) for c in batch.columns[1:]], carry)
                upto = np.r_[0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(pa.array(upto), held)], ["gram", "rows"])

    kinds = ", ".join(f"`{c}`: {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.select(F.lower(F.col(text).cast("string")).alias("__lower"), *carry).mapInArrow(run, f"gram string, rows array<struct<{kinds}>>")


def pattern(fragment: str) -> str:
    """The LIKE pattern of a fragment: % and _ in it are wildcards, a backslash is itself."""
    return "%" + fragment.replace("\\", "\\\\") + "%"


def asked_grams(fragment: str) -> list[str]:
    runs = re.split("[%_]", fragment.lower())
    return sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})


@dataclass(frozen=True)
class TrigramIndex:
    """``carried`` columns come with each row; ``text`` is among them if ``inline``."""

    path: str
    text: str
    carried: str
    inline: bool
    buckets: int

    def postings(self, spark: SparkSession) -> DataFrame:
        """(gram, bucket, rows): a list of rows for some texts of each trigram."""
        return spark.read.schema(f"gram string, rows array<struct<{self.carried.replace('` ', '`: ')}>>, bucket int").parquet(f"{self.path}/postings")

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("gram string, n long").parquet(f"{self.path}/counts")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.carried).parquet(f"{self.path}/rows")


def build(rows: DataFrame, text: str, carry: list[str], inline: bool = True) -> TrigramIndex:
    """An index of ``rows`` (distinct in ``carry``); a null text has no trigrams and matches nothing. Lists of rows are shuffled once, by trigram."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "trigrams")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.select(*carry, *[text] * (inline and text not in carry))
    each = with_grams(rows, text, kept.columns)
    dealt = each.withColumn("bucket", bucket_of(F.col("gram"), buckets)).repartition("bucket", F.pmod(F.xxhash64("rows"), F.lit(SLICES)))
    dealt.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    if inline:
        kept.write.parquet(f"{path}/rows")
    index = TrigramIndex(path, text, ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in kept.columns), inline, buckets)
    index.postings(spark).groupBy("gram").agg(F.sum(F.size("rows")).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return index


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def rarest(spark: SparkSession, index: TrigramIndex, fragment: str) -> list[tuple[str, int, int]] | None:
    """(gram, rows, bucket) of the fragment's trigrams, rarest first; None if it has none."""
    asked = asked_grams(fragment)
    if not asked:
        return None
    named = spark.createDataFrame([(g,) for g in asked], "gram string").withColumn("bucket", bucket_of(F.col("gram"), index.buckets))
    have = {r["gram"]: r["n"] for r in index.counts(spark).where(F.col("gram").isin(asked)).collect()}  # the fragment's trigrams
    return sorted(((r["gram"], have.get(r["gram"], 0), r["bucket"]) for r in named.collect()), key=lambda x: (x[1], x[0]))


def find(spark: SparkSession, index: TrigramIndex, fragment: str) -> DataFrame:
    """The rows whose text holds the fragment, ignoring case, of an index with its texts inline; reads the postings of one trigram."""
    first = rarest(spark, index, fragment)
    if first is None:
        found = index.rows(spark)
    else:
        gram, _, bucket = first[0]
        found = index.postings(spark).where((F.col("bucket") == bucket) & (F.col("gram") == gram)).select(F.inline("rows"))
    return found.where(F.col(index.text).ilike(pattern(fragment)))


def candidates(spark: SparkSession, index: TrigramIndex, fragment: str) -> DataFrame | None:
    """The carried columns of the rows that have the rarest trigrams of a fragment, whose texts are then to be verified; None if every row may match."""
    first = rarest(spark, index, fragment)
    if first is None:
        return None
    asked = first[:ASKED]
    inside = reduce(Column.__or__, [(F.col("bucket") == b) & (F.col("gram") == g) for g, _, b in asked])
    keys = [c.strip("`") for c in re.findall(r"`[^`]*`", index.carried)]
    return index.postings(spark).where(inside).select(F.inline("rows")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(asked)).drop("n")
