"""Capture bundles: a folder with a manifest and a graph as JSON, read as node and edge rows, and merged across fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import canonical_union

GRAPH = "nodes array<struct<id: string, kind: string, name: string>>, edges array<struct<from: string, to: string, type: string>>"


def read_bundle(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(node, kind, name) and (from, to, type) of the graph files of a bundle, if its manifest has the version."""
    manifest = spark.read.schema("version int, target string").json(f"{path}/manifest", multiLine=True)
    found = [r["version"] for r in manifest.limit(2).collect()]
    if found != [version]:
        raise ValueError(f"the bundle at {path} has version {found}, not {version}: capture it again")
    graph = spark.read.schema(GRAPH).json(f"{path}/graph", multiLine=True)
    nodes = graph.select(F.explode("nodes").alias("n")).select(F.col("n.id").alias("node"), "n.kind", "n.name")
    return nodes, graph.select(F.explode("edges").alias("e")).select("e.from", "e.to", "e.type")


def merge_fragments(fragments: DataFrame, entity: str, target: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of several capture fragments as one: the first row of each entity in order, and which targets have it."""
    return canonical_union(fragments, entity, target, order)
