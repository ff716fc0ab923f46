"""Whole requests: rank candidates for a question, plan the context around seeds, and explain a plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import match_terms
from . import fusion, graph, packing, postings, search
from .emit import manifest
from .shared import saved


@dataclass(frozen=True)
class Request:
    """A question and its limits; values given here win over a configuration's, and those over the defaults."""

    query: str = ""
    most: int = 20
    depth: int = 2
    budget: int = 8000
    strict: bool = False
    fields: dict[str, float] = field(default_factory=lambda: {"body": 1.0, "name": 5.0})

    @classmethod
    def merged(cls, given: dict, configured: dict) -> Request:
        names = cls.__dataclass_fields__
        values = {k: v for source in (configured, given) for k, v in source.items() if k in names and v is not None}
        out = cls(**values)
        if out.most < 1 or out.depth < 0 or out.budget < 0:
            raise ValueError("most must be positive, depth and budget not negative")
        return out


def localize(chunks: DataFrame, files: DataFrame, request: Request, index: postings.Index, graph_of: tuple[DataFrame, DataFrame] | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """Ranked files for a question: key, file_path, score, sources, grade.

    ``chunks``: the index's key, file_path, name; ``files``: file_path. A first search of the index gives lexical
    candidates; names of its best files' hits widen the question for a second one, which adds files at a lower
    score. These and path candidates are fused by noisy-or, the grade decides how many stay. ``graph_of`` (edges,
    nodes) adds files one step from the best, ``hashes`` (file_path, content_hash) leaves one file of each content.
    The pool of the searches bounds what is ranked.
    """
    spark, key = chunks.sparkSession, index.key
    pool = max(4 * request.most, 80)

    def found(query: str) -> tuple[DataFrame, DataFrame]:
        best = postings.search(spark, index, query, request.fields, pool)
        order = Window.orderBy(F.desc("score"), key)  # pool rows
        ranks = F.broadcast(best.withColumn("rank", F.row_number().over(order) - 1))
        hits = saved(chunks.select(key, "file_path", "name").join(ranks, key), "hits")  # pool rows, read several times
        return hits, search.lexical_candidates(hits, tokens_of(query))

    hits, lexical = found(request.query)
    more = [r["term"] for r in search.feedback_terms(hits, tokens_of(request.query)).collect()]  # six terms at most
    parts = [named(lexical)]
    if more:
        parts.append(named(search.feedback_candidates(found(" ".join([request.query, *more]))[1], lexical)))
    parts.append(search.path_candidates(files, tokens_of(request.query), request.most).select("file_path", "score", F.lit("fts_path").alias("source")))
    both = reduce(DataFrame.unionByName, parts).select(F.lit(None).cast("string").alias("node_id"), "file_path", "score", "source", F.lit(0).alias("tokens"))
    fused = saved(fusion.noisy_or(both), "fused")  # the candidates of the pools
    chosen = fusion.select_candidates(fused, request.strict).select("key", "file_path", "score", F.array_join("sources", ",").alias("sources"))
    if graph_of is not None:
        near = graph_discovery(*graph_of, chosen.select("file_path", "score"))
        chosen = chosen.unionByName(near.select(F.concat(F.lit("file:"), "file_path").alias("key"), "file_path", "score", F.lit("graph").alias("sources")))
    order = [F.desc("score"), F.col("file_path")]
    if hashes is not None:
        of = hashes.join(F.broadcast(chosen.select("file_path")), "file_path", "left_semi")
        chosen = fusion.content_dedup(chosen, of, order, "file_path")
    return chosen.crossJoin(F.broadcast(fusion.grade(fused).select("grade"))).select("key", "file_path", "score", "sources", "grade").orderBy(*order).limit(request.most)


def tokens_of(query: str) -> list[str]:
    return [w for p in match_terms(query) for w in p]


def named(candidates: DataFrame) -> DataFrame:
    """Lexical candidates with their source: a name that holds a word of the question, or the text alone."""
    return candidates.select("file_path", "score", F.when(F.col("ceiling") == search.NAME_CEILING, "fts_symbol").otherwise("fts_body").alias("source"))


def context_plan(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, costs: DataFrame, request: Request, mode: str = "auto", tests: bool = True) -> DataFrame:
    """Files around seeds (node, score): role, tier, score, cost and whether they fit the budget.

    Seeds expand through the graph; a file is its best node. Seed files are kept in any case.
    ``costs``: file_path, cost.
    """
    reached = graph.expand(edges, seeds, request.depth)
    best = F.max_by(F.struct("node", "via", "hop"), F.struct("score", F.col("node")))
    per_file = reached.join(nodes, "node").groupBy("file_path").agg(F.max("score").alias("score"), best.alias("b"))
    rows = per_file.join(costs, "file_path", "left").select(F.lit("plan").alias("plan"), F.col("file_path").alias("path"), "score", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), (F.col("b.hop") == 0).alias("must_keep"), packing.role(F.col("b.via"), F.col("b.hop") == 0).alias("role"))
    wanted = rows if tests else rows.where("role <> 'test'")
    return packing.pack_plan(wanted.withColumn("tier", packing.tier(F.col("role"), mode)), request.budget).drop("plan")


def graph_discovery(edges: DataFrame, nodes: DataFrame, ranked: DataFrame, seeds: int = 2, most: int = 5) -> DataFrame:
    """New files one step from the best seeds (file_path, score), best first."""
    first = ranked.orderBy(F.desc("score"), "file_path").limit(seeds)
    start = nodes.join(F.broadcast(first), "file_path").select("node", "score")
    found = graph.expand(edges, start, 1).where("hop = 1").join(nodes, "node").groupBy("file_path").agg(F.max("score").alias("score"))
    return found.join(ranked.select("file_path"), "file_path", "left_anti").orderBy(F.desc("score"), "file_path").limit(most)


#: Edge types by the kind of an exact input, and the weight of its candidates' source.
EXACT = {"service": "di_resolves_to", "request": "mediatr_handles", "route": "route_handles", "config": "options_binds"}


def exact_candidates(edges: DataFrame, nodes: DataFrame, asked: list[tuple[str, str]]) -> DataFrame:
    """(kind, node, file_path, score): what exact inputs (kind, name) resolve to, at their source's weight; a focus is the node itself."""
    wanted = edges.sparkSession.createDataFrame(asked, "kind string, name string")
    types = edges.sparkSession.createDataFrame(list(EXACT.items()), "kind string, type string")
    through = wanted.join(F.broadcast(types), "kind").join(edges, (F.col("name") == F.col("from")) & (types["type"] == edges["type"])).select("kind", F.col("to").alias("node"))
    focus = wanted.where("kind = 'focus'").select("kind", F.col("name").alias("node"))
    found = through.unionByName(focus).distinct().join(nodes, "node")
    source = F.concat(F.when(F.col("kind") == "focus", "symbol").otherwise(F.col("kind")), F.lit("_exact"))
    return found.select("kind", "node", "file_path", fusion.source_weight(source).alias("score"))


def plan_seeds(edges: DataFrame, nodes: DataFrame, paths: list[str] = (), routes: list[str] = (), names: list[str] = ()) -> DataFrame:
    """(node, score): the nodes of the given files, what routes resolve to, and nodes of a name in any case; each once, at its best."""
    spark = edges.sparkSession
    listed = lambda values, column: F.broadcast(spark.createDataFrame([(v,) for v in values], f"{column} string"))
    by_file = nodes.join(listed(paths, "file_path"), "file_path").select("node", F.lit(1.0).alias("score"))
    by_route = edges.where("type = 'route_handles'").join(listed(routes, "from"), "from").select(F.col("to").alias("node"), F.lit(1.0).alias("score"))
    by_name = nodes.join(listed([n.lower() for n in names], "low"), F.lower("node") == F.col("low")).select("node", F.lit(0.9).alias("score"))
    return by_file.unionByName(by_route).unionByName(by_name).groupBy("node").agg(F.max("score").alias("score"))


def explain(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, costs: DataFrame, request: Request) -> DataFrame:
    """What ``context_plan`` would emit, without emitting it: per role and tier the files, those kept, and their tokens."""
    return manifest(context_plan(edges, nodes, seeds, costs, request))
