"""What the training-data operators share: shared-folder tables, splits, tokens."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of which rows are numbered in place: the bound of the broadcast of their paths.
MAX_FILES = 100_000
#: Rows that a task handles at least, where ``stage`` is told how many there are and the session has cores enough.
ROWS_PER_TASK = 250_000
#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+`` as a Java regex class.
JAVA_SPACE = r"[\x20\x09-\x0D]+"
JAVA_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where the session has none, as in tests, one of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        # one machine may use a folder of its own; on a cluster it would not be shared
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    ``rows``: how many the last step handles at most, where that is known. It then has no more tasks, and so no more
    files, than these rows need, but as many as the session has cores; else small tables have a file for each of
    the session's shuffle partitions where Spark doesn't coalesce them.
    """
    path = shared_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kind_of(df: DataFrame, column: str) -> str:
    """The column's type as SQL text, for the schemas of Python stages that pass it on."""
    return df.schema[column].dataType.simpleString()


def unused(columns: list[str], name: str) -> str:
    """``name``, or the first one with underscores before it that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` are the rows of files, each once, with columns chosen or renamed at most."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def numbered_rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a row number ``name`` that never changes: ids may be null or repeat.

    Rows of Parquet files are numbered by their file and place in it, so nothing is written; the
    numbers of the files are broadcast, at most MAX_FILES. Rows from elsewhere are written once.
    """
    rows = None
    if is_scan(docs):
        place = docs.metadataColumn("_metadata")
        path, taken = unused([*docs.columns, name], "path"), place["file_path"]
        files = docs.select(taken.alias(path)).distinct().limit(MAX_FILES + 1).toArrow()
        number = unused([*docs.columns, name, path], "file")
        rows = docs.withColumns({path: taken, name: place["row_index"]})
    if rows is None or len(files) > MAX_FILES:
        return stage(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    named = [(p, i) for i, p in enumerate(sorted(files[path].to_pylist()))]
    numbers = docs.sparkSession.createDataFrame(named, f"`{path}` string, `{number}` long")
    return rows.join(F.broadcast(numbers), path).withColumn(name, F.shiftleft(F.col(number), 40) + F.col(name)).select(*[F.col(f"`{c}`") for c in docs.columns], name)
