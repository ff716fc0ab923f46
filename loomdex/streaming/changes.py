"""Change streams: debounced batches, coalescing per path, and incremental upkeep of an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.store import cascade_delete

#: Created then deleted is nothing, deleted then created is changed, created then changed is created; else the latest.
NOTHING = "Nothing"


def next_state(state: Column, kind: Column) -> Column:
    return (
        F.when(state.isNull() | (state == NOTHING), kind)
        .when((state == "Created") & (kind == "Deleted"), F.lit(NOTHING))
        .when((state == "Deleted") & (kind == "Created"), F.lit("Changed"))
        .when((state == "Created") & (kind == "Changed"), F.lit("Created"))
        .otherwise(kind)
    )


def coalesced(events: list[tuple]) -> list[tuple[str, str, int]]:
    """(path, kind, events) of a batch of events (at, seq, path, kind) in time order; see ``next_state``."""
    state: dict[str, tuple[str, int]] = {}
    pairs = {("Created", "Deleted"): NOTHING, ("Deleted", "Created"): "Changed", ("Created", "Changed"): "Created"}
    for _, _, path, kind in events:
        before, n = state.get(path, (NOTHING, 0))
        state[path] = (pairs.get((before, kind), kind), n + 1)
    return [(path, kind, n) for path, (kind, n) in state.items()]


def coalesce_changes(events: DataFrame, keys: list[str], time: str = "ts", kind: str = "kind", tie: str = "seq") -> DataFrame:
    """The one change that remains of each key's changes in time order; rows whose changes cancel are dropped."""
    ordered = F.array_sort(F.collect_list(F.struct(time, tie, kind)))
    folded = F.aggregate(ordered, F.lit(None).cast("string"), lambda a, e: next_state(a, e[kind]))
    return events.groupBy(*keys).agg(folded.alias("kind"), F.count(F.lit(1)).alias("events")).where(F.col("kind") != NOTHING)


def split_renames(events: DataFrame) -> DataFrame:
    """Renames (kind Renamed with old_path) as a deletion of the old path and a creation of the new one."""
    renamed = F.col("kind") == "Renamed"
    gone, made = F.struct(F.col("old_path").alias("path"), F.lit("Deleted").alias("kind")), F.struct("path", F.lit("Created").alias("kind"))
    parts = F.when(renamed, F.array(gone, made)).otherwise(F.array(F.struct("path", "kind")))
    others = [c for c in events.columns if c not in ("path", "kind", "old_path")]
    return events.select(*others, F.inline(parts))


def debounced(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds", by: list[str] = (), time: str = "ts") -> DataFrame:
    """Batches that close after ``gap`` of silence: (by..., start, end, events). Streams need the watermark."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("events")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def batches_of_changes(events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """The batch form of ``stateful.debounced_changes``: (workspace, start, end, path, kind, events)."""
    order = Window.partitionBy("workspace").orderBy("ts", "seq")
    wide = F.expr(f"INTERVAL {gap}")
    begins = F.coalesce(F.col("ts") >= F.lag("ts").over(order) + wide, F.lit(True))
    marked = events.withColumn("begins", begins).withColumn("number", F.sum(F.col("begins").cast("int")).over(order))
    ends = marked.groupBy("workspace", "number").agg(F.min("ts").alias("start"), (F.max("ts") + wide).alias("end"))
    return coalesce_changes(marked, ["workspace", "number", "path"]).join(ends, ["workspace", "number"]).select("workspace", "start", "end", "path", "kind", "events")


def keep_index(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``apply`` on each batch of changes, one after the other, over what is there; returns the finished query."""
    query = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def reindex(tables: dict[str, tuple[DataFrame, str]], changed: DataFrame, extract: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables of an index with the rows of the changed files (file_path, text; a null text is a deletion) replaced by what ``extract`` makes of them.

    Rows of other files stay, also those that point at changed ones. Tables come with their path column.
    """
    kept = cascade_delete(tables, changed.select("file_path"), "file_path")
    fresh = extract(changed.where("text IS NOT NULL"))
    return {name: frame.unionByName(fresh[name].select(frame.columns)) if name in fresh else frame for name, frame in kept.items()}


def cold_start(files: DataFrame, quick: Callable[[DataFrame], DataFrame], full: Callable[[DataFrame], DataFrame], done: DataFrame | None, key: str = "file_path") -> DataFrame:
    """Rows of the full tier for the files (key) that have been through it, and of the quick tier for the others; adds tier."""
    rows = quick(files if done is None else files.join(done.select(key), key, "left_anti")).withColumn("tier", F.lit("syntax"))
    return rows if done is None else rows.unionByName(full(files.join(done.select(key), key, "left_semi")).withColumn("tier", F.lit("semantic")))
