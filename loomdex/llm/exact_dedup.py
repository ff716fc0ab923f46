"""Exact dedup over an extendible-hash index that is kept as files in the shared folder.

DataFrame functions only. Every row gets a 64-bit hash key of its normalised text. The
directory starts with one bucket and doubles while a bucket holds more chains than fit; a
bucket is a prefix of the key, so it is one contiguous key range, and runs of buckets have an
owner task. Texts are grouped by their bytes under their bucket and key, already in the input
tasks, so copies never travel; what is left of each text goes to its bucket's owner, which
chains the different texts of a key and writes the bucket's file. Rows find their bucket
through the directory and their text there by key and digest; texts whose digests collide,
should there ever be any, are looked up by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import JAVA_SPACE, kind_of, shared_path, stage, text_of

#: Bits of the key that the directory can use at most: 65,536 slots, the bound of its broadcast.
MAX_DEPTH = 16


def build_directory(loads: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int]]]:
    """Grow a directory for ``loads`` (chains by ``max_depth``-bit prefix).

    Returns the global depth and, per slot, (first slot's prefix as bucket id, local depth).
    Splitting a bucket whose local depth equals the global depth doubles the directory.
    """
    prefix_sum = [0]
    for prefix in range(1 << max_depth):
        prefix_sum.append(prefix_sum[-1] + loads.get(prefix, 0))

    def load(prefix: int, depth: int) -> int:
        low = prefix << (max_depth - depth)
        return prefix_sum[low + (1 << (max_depth - depth))] - prefix_sum[low]

    depth, slots = 1, [(0, 1), (1, 1)]
    while True:
        over = {slot for slot in set(slots) if slot[1] < max_depth and load(*slot) > capacity}
        if not over:
            return depth, [(prefix << (max_depth - local), local) for prefix, local in slots]
        if any(local == depth for _, local in over):
            depth, slots = depth + 1, [slot for slot in slots for _ in (0, 1)]
        slots = [(index >> (depth - local - 1), local + 1) if (prefix, local) in over and local < depth else (prefix, local) for index, (prefix, local) in enumerate(slots)]


def owners_of(slots: list[tuple[int, int]], tasks: int) -> dict[int, int]:
    """Owner by bucket: runs of neighbouring buckets, as many slots of the directory each as whole buckets allow."""
    return {bucket: i * min(tasks, len(slots)) // len(slots) for i, (bucket, _) in reversed(list(enumerate(slots)))}


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_chains: int = 16_384, digest: Column | None = None, key: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical after each run of ASCII white space became one space; null counts
    as empty. The row with the smallest id stays. Rows that repeat the smallest id are one document
    and all say kept; null ids lose to any other, and a group of only null ids keeps them. An empty
    table gives no rows. Other columns are ignored. ``bucket_chains`` is the size of a bucket, which
    at MAX_DEPTH bits may be exceeded; it decides files and tasks, not the result. ``digest`` of the
    column "norm" takes the place of SHA-256 in lookups, and ``key`` that of XXH64.
    """
    spark = docs.sparkSession
    digest = F.sha2("norm", 256) if digest is None else digest
    norm = F.regexp_replace(text_of(text_col), JAVA_SPACE, " ")
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    keyed = rows.withColumn("key", F.xxhash64("norm") if key is None else key)
    entries = stage(keyed.select("id", "key", F.sha2("norm", 256).alias("sha"), digest.alias("digest")), "dedup-entries")

    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    counted = entries.select("key").distinct().groupBy(prefix.alias("prefix")).count().collect()  # at most 2**MAX_DEPTH rows
    depth, slots = build_directory({r["prefix"]: r["count"] for r in counted}, bucket_chains)
    owners = owners_of(slots, int(spark.conf.get("spark.sql.shuffle.partitions")))
    directory = spark.createDataFrame([(i, bucket, owners[bucket]) for i, (bucket, _) in enumerate(slots)], "slot int, bucket int, owner int")
    slot = F.shiftrightunsigned("key", 64 - depth).cast("int")

    def found_in(frame: DataFrame) -> DataFrame:
        """``frame`` with the bucket and owner of its key."""
        return frame.withColumn("slot", slot).join(F.broadcast(directory), "slot").drop("slot")  # at most 2**MAX_DEPTH rows

    # compares bytes, after combining in each input task
    texts = found_in(keyed).groupBy("owner", "bucket", "key", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = texts.select("owner", "bucket", "key", F.sha2("norm", 256).alias("sha"), digest.alias("digest"), "keep_id", "group_size")
    owned = texts.repartitionById(max(owners.values(), default=0) + 1, "owner")
    link = Window.partitionBy("owner", "bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "sha")
    path = shared_path(spark, "dedup-index")
    owned.withColumn("chain", F.row_number().over(link)).drop("owner").write.partitionBy("bucket").parquet(path)
    index = spark.read.schema(f"key long, sha string, digest string, keep_id {kind_of(rows, 'id')}, group_size long, chain int, bucket int").parquet(path)

    result = [F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "chain"]
    collided = index.groupBy("bucket", "key", "digest").count().where("count > 1").drop("count")
    if not collided.count():
        return found_in(entries).drop("sha", "owner").join(index, ["bucket", "key", "digest"]).select(*result)
    alone = index.join(collided, ["bucket", "key", "digest"], "left_anti")
    met = found_in(entries).drop("sha", "owner").join(alone, ["bucket", "key", "digest"]).select(*result)
    # texts of a digest that several share: grouped by their bytes once more, and looked up by these
    among = found_in(keyed.withColumn("digest", digest)).drop("owner").join(collided, ["bucket", "key", "digest"], "left_semi")
    by_bytes = among.groupBy("bucket", "key", F.col("norm").alias("bytes")).agg(F.min("id").alias("least")).withColumn("sha", F.sha2("bytes", 256))
    named = by_bytes.join(index.drop("digest"), ["bucket", "key", "sha"]).select("bucket", "key", "bytes", "sha", "keep_id", "group_size", "chain", "least").where("least <=> keep_id")
    return met.unionByName(among.withColumnRenamed("norm", "bytes").join(named, ["bucket", "key", "bytes"]).select(*result))


def op7_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.h AS text_sha256
FROM t JOIN g USING (h)
"""
