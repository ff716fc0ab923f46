"""Change history as additive counts: a batch of commits adds a segment of its own counts, and readers sum them up."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace as with_values
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import MOST_FILES, couplings, pairs_and_paths
from .shared import new_path


@dataclass(frozen=True)
class History:
    """``types``: of paths and dates, for the reader's schemas."""

    path: str
    types: tuple[str, str]
    segments: tuple[str, ...] = ()

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{self.path}/{s}/{name}") for s in self.segments])

    def pairs(self, spark: SparkSession) -> DataFrame:
        path, date = self.types
        held = self._read(spark, "pairs", f"a {path}, b {path}, count long, last_seen {date}")
        return held.groupBy("a", "b").agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))

    def paths(self, spark: SparkSession) -> DataFrame:
        """(path, c): commits of a path that are not left out of pairs."""
        return self._read(spark, "paths", f"path {self.types[0]}, c long").groupBy("path").agg(F.sum("c").alias("c"))

    def days(self, spark: SparkSession) -> DataFrame:
        """(path, date, changes)"""
        return self._read(spark, "days", f"path {self.types[0]}, date {self.types[1]}, changes long")

    def commits(self, spark: SparkSession) -> DataFrame:
        """One row: n, the commits that are not left out of pairs."""
        return self._read(spark, "commits", "n long").agg(F.sum("n").alias("n"))


def started(changes: DataFrame) -> History:
    """A history without commits, for changes of this shape (commit, path, date)."""
    return History(new_path(changes.sparkSession, "history"), tuple(changes.schema[c].dataType.simpleString() for c in ("path", "date")))


def added(history: History, changes: DataFrame, most_files: int = MOST_FILES) -> History:
    """``history`` with a batch of whole commits (commit, path, date) that it has not; writes this batch's counts alone."""
    segment = uuid.uuid4().hex
    pairs, paths, n = pairs_and_paths(changes, most_files)
    for name, frame in (("pairs", pairs), ("paths", paths), ("commits", n), ("days", changes.groupBy("path", "date").agg(F.count(F.lit(1)).alias("changes")))):
        frame.write.parquet(f"{history.path}/{segment}/{name}")
    return with_values(history, segments=(*history.segments, segment))


def replaced(history: History, changes: DataFrame, most_files: int = MOST_FILES) -> History:
    """A history of these commits alone; the old one's segments stay with whoever holds it."""
    return added(with_values(history, segments=()), changes, most_files)


def merged(spark: SparkSession, history: History) -> History:
    """The same counts in one segment."""
    segment = uuid.uuid4().hex
    days = history.days(spark).groupBy("path", "date").agg(F.sum("changes").alias("changes"))
    for name, frame in (("pairs", history.pairs(spark)), ("paths", history.paths(spark)), ("commits", history.commits(spark)), ("days", days)):
        frame.write.parquet(f"{history.path}/{segment}/{name}")
    return with_values(history, segments=(segment,))


def cochanges(spark: SparkSession, history: History, least: int = 2) -> DataFrame:
    """What ``graph.cochanges`` gives for all commits of the history."""
    return couplings(history.pairs(spark), history.paths(spark), history.commits(spark), least)


def stats(spark: SparkSession, history: History, now, days: int = 90) -> DataFrame:
    """What ``delta.git_stats`` gives for all commits of the history."""
    recent = F.when(F.col("date") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS"), F.col("changes")).otherwise(0)
    return history.days(spark).groupBy("path").agg(F.sum(recent).alias("commits"), F.max("date").alias("last_modified"))
