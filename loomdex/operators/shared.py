"""Tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only where none is set, as in tests, one of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        # one machine may use a folder of its own; on a cluster it would not be shared
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` without its lineage: written and read again, so that lost executors cost nothing before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what is run within go when it is done, not when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the place of each row in the order, from 1 and without gaps; tasks hold ranges of the order, none holds all rows."""
    placed = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__place", 33)
    before, starts = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row per task
        starts.append((r["part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __before long")
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__place") - F.shiftleft("__part", 33) + 1).drop("__part", "__before", "__place")


def bucketed(df: DataFrame, keys: list[str], name: str = "buckets") -> DataFrame:
    """``df`` written in buckets of ``keys``: joins and sums on them read it where it is, without a shuffle."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(tasks, *keys).write.bucketBy(tasks, *keys).sortBy(*keys).option("path", new_path(spark, name)).saveAsTable(table)
    held = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and the frame knows them
    return held
