"""Hash-tree manifests: what two states of a file tree differ in, read from where they differ alone.

A leaf is the files (key, value) whose hashed key begins with the same bits; its digest is the sum of two hashes of
its rows, so digests add up and a prefix's digest is the sum of its leaves'. Each level of the
tree has STEP bits more than the one above. Two manifests are compared level by level, below the prefixes that
differ alone; entries are then read from the differing leaves. They lie in folders by their first bits,
sorted by leaf, so that folders without a difference are not opened.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

#: Bits of a level; rows that a leaf is meant to hold; leaves that are named to the reader one by one.
STEP, LEAF_ROWS, NAMED_LEAVES = 8, 256, 1000


@dataclass(frozen=True)
class Manifest:
    path: str
    key: str
    value: str
    entry: str
    levels: int

    def tree(self, spark: SparkSession) -> DataFrame:
        """(level, prefix, rows, d1, d2)"""
        return spark.read.schema("prefix long, rows long, d1 long, d2 long, level int").parquet(f"{self.path}/tree")

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"leaf long, {self.entry}, folder int").parquet(f"{self.path}/entries")


def prefix_of(key: Column, level: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - STEP * level) if level else F.lit(0).cast("long")


def build(files: DataFrame, key: str, value: str) -> Manifest:
    """The manifest of ``files`` (distinct keys); its tree has as many levels as the number of files asks for."""
    spark, path = files.sparkSession, new_path(files.sparkSession, "manifest")
    levels = max(1, math.ceil(math.log2(max(2, files.count() / LEAF_ROWS)) / STEP))
    rows = files.select(prefix_of(F.col(key), levels).alias("leaf"), key, value)
    folder = F.shiftrightunsigned("leaf", STEP * (levels - 1)).cast("int")
    rows.withColumn("folder", folder).repartitionByRange("leaf").sortWithinPartitions("folder", "leaf").write.partitionBy("folder").parquet(f"{path}/entries")
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in (key, value))
    manifest = Manifest(path, key, value, kinds, levels)
    # sums of 32 bits of a hash each, so that they do not overflow
    part = lambda seed: F.sum(F.xxhash64(key, value, F.col(value).isNull(), F.lit(seed)).bitwiseAND(F.lit((1 << 32) - 1)))
    below = manifest.entries(spark).groupBy(F.col("leaf").alias("prefix")).agg(F.count(F.lit(1)).alias("rows"), part(1).alias("d1"), part(2).alias("d2"))
    for level in range(levels, -1, -1):
        below.withColumn("level", F.lit(level)).write.mode("append").partitionBy("level").parquet(f"{path}/tree")
        held = manifest.tree(spark).where(F.col("level") == level)
        below = held.groupBy(F.shiftrightunsigned("prefix", STEP).alias("prefix")).agg(*[F.sum(c).alias(c) for c in ("rows", "d1", "d2")])
    return manifest


def differing(spark: SparkSession, old: Manifest, new: Manifest) -> tuple[DataFrame | None, int, int]:
    """(prefixes that differ, their level, prefixes compared): at the deepest level that both trees have; None if nothing differs."""
    found, compared, levels = None, 0, min(old.levels, new.levels)
    for level in range(levels + 1):
        sides = []
        for side, m in (("o", old), ("n", new)):
            at = m.tree(spark).where(F.col("level") == level)
            if found is not None:
                at = at.join(found.select(F.col("prefix").alias("above")), F.shiftrightunsigned("prefix", STEP) == F.col("above"), "left_semi")
            sides.append(at.select("prefix", F.struct("rows", "d1", "d2").alias(side)))
        both = sides[0].join(sides[1], "prefix", "full")
        compared += both.count()
        found = both.where(~F.col("o").eqNullSafe(F.col("n"))).select("prefix")
        if not found.take(1):
            return None, level, compared
    return found, levels, compared


def within(spark: SparkSession, manifest: Manifest, prefixes: DataFrame, level: int) -> DataFrame:
    """The entries below some prefixes of a level."""
    down = STEP * (manifest.levels - level)
    above = F.shiftrightunsigned("leaf", down)
    few = [r["prefix"] for r in prefixes.limit(NAMED_LEAVES + 1).collect()]
    folders = prefixes.select(F.shiftrightunsigned("prefix", STEP * (level - 1)).cast("int").alias("f")).distinct() if level else None
    read = manifest.entries(spark)
    if folders is not None:
        read = read.where(F.col("folder").isin([r["f"] for r in folders.collect()]))  # 2^STEP at most
    if len(few) > NAMED_LEAVES:
        return read.join(prefixes.select(F.col("prefix").alias("above")), above == F.col("above"), "left_semi")
    return read.where(F.col("leaf").isin(few) if not down else above.isin(few))


def difference(spark: SparkSession, old: Manifest, new: Manifest) -> DataFrame:
    """What ``store.manifest_difference`` gives for the two states, from the leaves that differ: key, state, was, now."""
    from .store import manifest_difference

    found, level, _ = differing(spark, old, new)
    if found is None:
        rows = [m.entries(spark).limit(0) for m in (old, new)]
    else:
        rows = [within(spark, m, found, level) for m in (old, new)]
    was, now = (r.select(F.col(m.key).alias(old.key), F.col(m.value).alias(old.value)) for r, m in zip(rows, (old, new), strict=True))
    return manifest_difference(was, now, old.key, old.value)


def freshness(spark: SparkSession, indexed: Manifest, current: Manifest, most: int = 300) -> DataFrame:
    """What ``delta.freshness`` gives, from the leaves that differ: key and state."""
    rows = difference(spark, indexed, current).select(indexed.key, F.when(F.col("state") == "missing", "removed").otherwise("changed").alias("state"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))  # one row
    return rows.crossJoin(F.broadcast(n)).select(indexed.key, F.when(F.col("n") > most, "stale").otherwise(F.col("state")).alias("state"))
