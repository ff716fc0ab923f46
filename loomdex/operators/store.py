"""The relational store: upserts, cascading deletes, lookups, aggregates and set comparisons."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import substrings


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key. Write the result to a new table version."""
    return old.join(new.select(keys), keys, "left_anti").unionByName(new)


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row by ``order`` of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], doomed: DataFrame, path_col: str) -> dict[str, DataFrame]:
    """Every table without the rows of the doomed files; tables come with the name of their path column."""
    gone = doomed.select(F.col(path_col).alias("__p")).distinct()
    return {name: frame.join(gone, frame[column] == gone["__p"], "left_anti") for name, (frame, column) in tables.items()}


def prune(frame: DataFrame, inventory: DataFrame, column: str) -> DataFrame:
    """Rows whose file is in the inventory."""
    return frame.join(inventory.select(column).distinct(), column, "left_semi")


def top(rows: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    ordered = rows.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def list_symbols(symbols: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    return top(symbols.join(files.select("file_path"), "file_path"), [F.desc("is_public"), F.lower("name"), "symbol_id"], limit)


def find_symbols(symbols: DataFrame, fragment: str, limit: int, index: substrings.TrigramIndex | None = None) -> DataFrame:
    """Names with the fragment, ignoring case; % and _ in it are wildcards. An index over "name" saves the scan of ``symbols``."""
    found = symbols.where(F.col("name").ilike(substrings.pattern(fragment))) if index is None else substrings.find(symbols.sparkSession, index, fragment)
    return top(found, [F.desc("is_public"), F.length("name"), F.lower("name"), "symbol_id"], limit)


def signatures_by_name(symbols: DataFrame, names: DataFrame, per_name: int) -> DataFrame:
    """For each distinct asked name the symbols of that name or qualified name, at most ``per_name`` of each."""
    asked = names.select(F.lower("asked").alias("asked")).distinct()
    named = symbols.select("*", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("fqn")))).alias("asked"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("is_public"), F.length("fqn"), "fqn", "symbol_id"))
    return named.join(asked, "asked").withColumn("rank", rank).where(F.col("rank") <= per_name)


def members_of(symbols: DataFrame, full: str) -> DataFrame:
    simple = full.rpartition(".")[2]
    owner = F.col("containing_type")
    return symbols.where((owner == full) | (owner == simple) | owner.endswith(f".{simple}"))


def nodes_named(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.lower("display_name") == name.lower())


def edges_with_evidence(edges: DataFrame, files: DataFrame) -> DataFrame:
    return edges.join(files.select(F.col("file_id").alias("evidence_file_id"), F.col("file_path").alias("evidence_path")), "evidence_file_id", "left")


def files_with(files: DataFrame, fragment: str, limit: int, index: substrings.TrigramIndex | None = None) -> DataFrame:
    """Paths with the fragment, as ``find_symbols``; shortest first. An index over "file_path" saves the scan."""
    found = files.where(F.col("file_path").ilike(substrings.pattern(fragment))) if index is None else substrings.find(files.sparkSession, index, fragment)
    return top(found, [F.length("file_path"), "file_path"], limit)


def tokens_per_file(files: DataFrame, chunks: DataFrame) -> DataFrame:
    sums = chunks.groupBy("file_path").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("chunks"))
    return files.select("file_path").join(sums, "file_path", "left").select("file_path", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, t in tables.items()])


def sessions(kinds: dict[str, DataFrame]) -> DataFrame:
    """Newest change of each session over several tagged tables of (session, changed)."""
    both = reduce(DataFrame.unionByName, [t.select("session", "changed", F.lit(k).alias("kind")) for k, t in kinds.items()])
    return both.groupBy("session").agg(F.max("changed").alias("changed"), F.count_distinct("kind").alias("kinds")).orderBy(F.desc("changed"), "session")


def file_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row per edge between nodes of different files."""
    at = lambda side: nodes.select(F.col("node").alias(side), F.col("file_path").alias(f"{side}_file"))
    return edges.join(at("from"), "from").join(at("to"), "to").where("from_file <> to_file").select("from_file", "to_file", "type")


def touching(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with an end among the seeds, each once."""
    s = seeds.select(F.col("path").alias("a")).distinct()
    return pairs.join(s, "a", "left_semi").unionByName(pairs.join(s.withColumnRenamed("a", "b"), "b", "left_semi")).distinct()


def manifest_difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are missing, extra or changed between two manifests."""
    joined = old.select(key, F.col(value).alias("was"), F.lit(True).alias("o")).join(new.select(key, F.col(value).alias("now"), F.lit(True).alias("n")), key, "full")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("o").isNull(), "extra").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return joined.withColumn("state", state).where("state IS NOT NULL").select(key, "state", "was", "now")


def canonical_union(rows: DataFrame, entity: str, target: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """First row of each entity over all targets, and the distinct (entity, target) availability."""
    first = F.row_number().over(Window.partitionBy(entity).orderBy(*order))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n"), rows.select(entity, target).distinct()


def integrity(meta: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Checks of an index as (check, ok, detail)."""
    has = lambda key: meta.agg(F.count(F.when(F.col("key") == key, 1)).alias("n")).select(F.lit(f"{key} is set").alias("check"), (F.col("n") > 0).alias("ok"), F.col("n").alias("detail"))
    bare = symbols.join(chunks.select("symbol_id").distinct(), "symbol_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("symbols have chunks").alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").alias("detail"))
    return has("schema_version").unionByName(has("mode")).unionByName(bare)


def inventory_digest(files: DataFrame) -> DataFrame:
    """(digest): SHA-256 over path, NUL, hash, NUL of all files in order of their paths.

    The hash is a chain, so its bytes have to pass one place in order: the files are sorted in ranges and
    streamed through the driver a range at a time, which holds one of them.
    """
    digest = hashlib.sha256()
    ordered = files.select("file_path", "content_hash").repartitionByRange("file_path").sortWithinPartitions("file_path")
    for r in ordered.toLocalIterator(prefetchPartitions=True):
        digest.update(f"{r['file_path']}\0{r['content_hash']}\0".encode())
    return files.sparkSession.createDataFrame([(digest.hexdigest(),)], "digest string")


def list_routes(routes: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    return top(routes.join(files.select("file_path"), "file_path"), [F.lower("pattern"), F.col("verb"), F.col("file_path"), F.col("line_no")], limit)


def node_by_id(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.where(F.col("node") == node).limit(1)


def workspace_map(files: DataFrame, symbols: DataFrame, routes: DataFrame, most: int) -> DataFrame:
    """Lines of a workspace's map (section, line_no, line): counts, then the first symbols and routes in their orders."""
    counts = files.agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("files: "), "n").alias("line"))
    counts = counts.unionByName(symbols.agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("symbols: "), "n").alias("line"))).unionByName(routes.agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("routes: "), "n").alias("line")))
    named = list_symbols(symbols, files, most).select(F.struct((~F.col("is_public")).alias("a"), F.lower("name").alias("b"), F.col("symbol_id").cast("string").alias("c")).alias("o"), F.concat("name", F.lit(" ("), "file_path", F.lit(")")).alias("line"))
    routed = list_routes(routes, files, most).select(F.struct(F.lit(False).alias("a"), F.lower("pattern").alias("b"), F.concat_ws(" ", "verb", "file_path", F.lpad(F.col("line_no").cast("string"), 9, "0")).alias("c")).alias("o"), F.concat("verb", F.lit(" "), "pattern").alias("line"))
    place = lambda frame, section, order: frame.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(order)).alias("line_no"), "line")  # noqa: E731  # three counts, or at most ``most`` rows
    return place(counts, "counts", "line").unionByName(place(named, "symbols", "o")).unionByName(place(routed, "routes", "o"))


def replace_all(old: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """The new rows take the place of all old ones: written to a new path, which readers then take."""
    new.select(old.columns).write.parquet(path)
    return new.sparkSession.read.schema(old.schema).parquet(path)


def open_store(spark, path: str, version: int) -> dict[str, DataFrame]:
    """The tables of a store folder, by name, if its meta table has the version; else a refusal."""
    meta = spark.read.parquet(f"{path}/meta")
    found = [r["value"] for r in meta.where("key = 'schema_version'").select("value").limit(2).collect()]
    if found != [str(version)]:
        raise ValueError(f"the store at {path} has version {found}, not {version}: index it again")
    names = [r["value"] for r in meta.where("key = 'table'").select("value").collect()]  # a row per table
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def save_store(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Write the tables of a store, and last its meta table: a store without it is not complete."""
    for name, frame in tables.items():
        frame.write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([("schema_version", str(version)), *[("table", name) for name in tables]], "key string, value string").coalesce(1).write.parquet(f"{path}/meta")
