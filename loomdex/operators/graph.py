"""Typed property graph: degrees, PageRank, decayed expansion, neighbourhoods and co-change mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import pack_plan
from .shared import bucketed, saved

# Weights of edge types in expansion, and of any other type.
EDGE_WEIGHTS = {
    "route_handles": 1.00, "mediatr_handles": 0.95, "di_resolves_to": 0.95, "implements": 0.90, "di_depends_on_impl": 0.85, "options_binds": 0.85, "config_impacts": 0.80, "inherits": 0.75,
    "di_injects": 0.75, "options_consumes": 0.75, "sends_request": 0.70, "tests": 0.65, "cochanges": 0.45, "project_references": 0.30, "path_proximity": 0.20, "references": 0.15,
}
OTHER_WEIGHT, HOP_DECAY, THRESHOLD = 0.10, 0.65, 0.10
DAMPING, PAGERANK_ROUNDS = 0.85, 20


def edge_weight(kind):
    pairs = [x for k, w in EDGE_WEIGHTS.items() for x in (F.lit(k), F.lit(w))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(OTHER_WEIGHT))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges in and out; a self-loop counts twice."""
    return edges.select(F.col("from").alias("node")).unionByName(edges.select(F.col("to").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def normalised_degree(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return d.crossJoin(F.broadcast(d.agg(F.max("degree").alias("most")))).select("node", (F.col("degree") / F.col("most")).alias("centrality"))


def central_files(edges: DataFrame, nodes: DataFrame, prefix: str = "", limit: int | None = None) -> DataFrame:
    """Files by the largest degree of their nodes, under a path prefix in any case."""
    found = nodes.join(degrees(edges), "node").where(F.startswith(F.lower("file_path"), F.lit(prefix.lower()))).groupBy("file_path").agg(F.max("degree").alias("degree"))
    ordered = found.orderBy(F.desc("degree"), "file_path")
    return ordered if limit is None else ordered.limit(limit)


#: Links out of a node that one bucket holds at most; a node with more has a copy in several buckets.
HUB_LINKS = 50_000


def pagerank(edges: DataFrame, damping: float = DAMPING, rounds: int = PAGERANK_ROUNDS, hub_links: int = HUB_LINKS) -> DataFrame:
    """(node, rank) after exactly ``rounds`` rounds, divided by the largest; keys in any case.

    Mass of nodes without links out is spread evenly. Links are written once, in buckets of their source;
    the links of a node with more than ``hub_links`` are cut into shares, which lie in different buckets, and its rank is
    copied to each. A round shuffles the sums by target, combined in the input tasks, and its ranks, which it writes.
    """
    spread = edges.select(F.lower("from").alias("from"), F.lower("to").alias("to"))
    out = spread.groupBy("from").agg(F.count(F.lit(1)).alias("out")).withColumn("shares", F.ceil(F.col("out") / hub_links).cast("int"))
    hubs = saved(out.where("shares > 1").select("from", "shares"), "hubs")
    cut = spread.join(hubs, "from", "left").withColumn("share", F.pmod(F.xxhash64("to"), F.coalesce("shares", F.lit(1))).cast("int"))
    links = bucketed(cut.select("from", "share", "to"), ["from", "share"], "links")
    all_nodes = spread.select(F.col("from").alias("node")).union(spread.select("to")).distinct()
    base = bucketed(all_nodes.join(out.withColumnRenamed("from", "node"), "node", "left"), ["node"], "nodes")
    n = base.count()
    ranks = base.select("node", "out", "shares", F.lit(1.0 / max(1, n)).alias("rank"))
    for _ in range(rounds):
        lost = ranks.where("out IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        copies = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
        sending = ranks.where("out IS NOT NULL").select(F.col("node").alias("from"), copies, (F.col("rank") / F.col("out")).alias("part"))
        sent = links.join(sending, ["from", "share"]).groupBy(F.col("to").alias("node")).agg(F.sum("part").alias("got"))
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)
        ranks = bucketed(base.join(sent, "node", "left").select("node", "out", "shares", rank.alias("rank")), ["node"], "ranks")
    most = ranks.agg(F.max("rank").alias("most"))
    return ranks.crossJoin(F.broadcast(most)).select("node", (F.col("rank") / F.col("most")).alias("rank"))


def expand(edges: DataFrame, seeds: DataFrame, depth: int, threshold: float = THRESHOLD, decay: float = HOP_DECAY, weight=edge_weight, fan_out: bool = True, ways: str = "both", max_rounds: int = 50) -> DataFrame:
    """Best-first decayed expansion of (node, score) seeds: node, score, hop, via (type of the last edge).

    A step costs weight(type) * decay / sqrt(edges of that type at the parent, in and out). A node
    keeps its best path's hop, and is not expanded at the depth limit, so a label can be withdrawn when
    its parent's hop rises: a label is supported by the offers of its parents, and a round renews the offers of those whose
    label has changed or gone, and the labels that these offers reach, until none changes.
    Ties go to the smaller hop, then the smaller parent. ``ways`` limits the steps to edges out or in.
    """
    there, back = edges.select("from", "to", "type"), edges.select(F.col("to").alias("from"), F.col("from").alias("to"), "type")
    both = {"out": there, "in": back, "both": there.unionByName(back)}[ways]
    fan = both.groupBy("from", "type").agg(F.count(F.lit(1)).alias("fan"))
    steps = saved(both.distinct().join(fan, ["from", "type"]).select("from", "to", "type", (weight(F.col("type")) * decay / (F.sqrt("fan") if fan_out else F.lit(1.0))).alias("factor")))
    start = saved(seeds.groupBy("node").agg(F.max("score").alias("score")).select("node", "score", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("parent")))
    steps = bucketed(steps, ["from"], "steps")
    columns = ["node", "score", "hop", "via", "parent"]
    # offers: what each parent gives its neighbours now; a node's label is the best of its offers and its seed's
    labels, offers, changed = start, None, start.select(*columns)
    best = F.min(F.struct((-F.col("score")).alias("s"), "hop", "parent", "via"))
    for _ in range(max_rounds):
        reached = (
            changed.where(F.col("hop") < depth)
            .select(F.col("node").alias("from"), "score", "hop")
            .join(steps, "from")
            .select(F.col("to").alias("node"), (F.col("score") * F.col("factor")).alias("score"), (F.col("hop") + 1).alias("hop"), F.col("type").alias("via"), F.col("from").alias("parent"))
            .where(F.col("score") >= threshold)
        )
        fresh = saved(reached, "fresh")
        met = fresh.select("node")
        if offers is None:
            offers = fresh
        else:
            parents = changed.select(F.col("node").alias("parent"))
            met = met.union(offers.join(parents, "parent", "left_semi").select("node"))
            offers = saved(offers.join(parents, "parent", "left_anti").unionByName(fresh), "offers")
        touched = saved(met.distinct(), "touched")
        mine = offers.unionByName(start).join(touched, "node", "left_semi")
        redone = mine.groupBy("node").agg(best.alias("b")).select("node", (-F.col("b.s")).alias("score"), "b.hop", "b.via", "b.parent")
        was = labels.select(F.col("node").alias("old"), F.col("score").alias("old_score"), F.col("hop").alias("old_hop")).join(touched, F.col("old") == F.col("node"), "left_semi")
        both = saved(redone.join(was, F.col("node") == F.col("old"), "full"), "redone")
        labels = saved(labels.join(touched, "node", "left_anti").unionByName(both.where("node IS NOT NULL").select(*columns)), "labels")
        # a label without offers is gone, and so is what it gave: it has no hop and sends nothing
        changed = both.where("node IS NULL OR NOT (score <=> old_score AND hop <=> old_hop)").select(F.coalesce("node", "old").alias("node"), *columns[1:])
        if not changed.take(1):
            return labels
    raise RuntimeError("the expansion did not settle")


def neighbourhood(edges: DataFrame, nodes: DataFrame, file_path: str) -> DataFrame:
    """Files linked to a file's nodes, outgoing links first; then the files of its folder."""
    own = nodes.where(F.col("file_path") == file_path).select("node")
    far = lambda a, b, n, word: edges.join(own, edges[a] == own["node"], "left_semi").select(F.col(b).alias("node"), F.concat(F.lit(word), "type").alias("reason"), F.lit(n).alias("order"))
    linked = far("from", "to", 0, "-> ").unionByName(far("to", "from", 1, "<- ")).join(nodes, "node").select("file_path", "reason", "order")
    folder = file_path.rpartition("/")[0]
    near = nodes.where(F.regexp_replace("file_path", "/?[^/]*$", "") == folder).select("file_path", F.lit("same folder").alias("reason"), F.lit(2).alias("order"))
    first = F.min(F.struct("order", "reason"))
    return linked.unionByName(near).where(F.col("file_path") != file_path).groupBy("file_path").agg(first.alias("f")).select("file_path", "f.reason", "f.order")


def callers(edges: DataFrame, nodes: DataFrame, target: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Sources of links to a node, each once; of one edge type if given."""
    into = edges.where(F.col("to") == target) if kind is None else edges.where((F.col("to") == target) & (F.col("type") == kind))
    found = into.select(F.col("from").alias("node")).distinct().join(nodes, "node").orderBy("file_path", "node")
    return found if limit is None else found.limit(limit)


def resolve(edges: DataFrame, kind: str, source: str) -> DataFrame:
    return edges.where((F.col("type") == kind) & (F.col("from") == source)).select("to").distinct()


#: Files of a commit that counts for pairs, at most.
MOST_FILES = 40
#: Pairs of files of commits that a task adds up, at most about.
PAIRS_A_TASK = 500_000


def pairs_and_paths(changes: DataFrame, most_files: int = MOST_FILES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of (commit, path, date) that add up over commits: pairs (a, b, count, last_seen), paths (path, c) and commits (n).

    Commits of more than ``most_files`` files are left out, which bounds the pairs of a commit.
    """
    sets = changes.groupBy("commit").agg(F.sort_array(F.collect_set("path")).alias("paths"), F.max("date").alias("date"))
    held = saved(sets.where((F.size("paths") > 0) & (F.size("paths") <= most_files)), "commits")
    later = F.transform("paths", lambda a, i: F.transform(F.slice("paths", i + 2, F.size("paths")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    all_pairs = held.agg(F.sum((F.size("paths") * (F.size("paths") - 1) / 2).cast("long"))).first()[0] or 0
    tasks = max(int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + all_pairs // PAIRS_A_TASK)
    # few pairs come twice, so that sums before the shuffle would hold nearly all of a task's pairs in memory
    dealt = held.select("date", F.explode(F.flatten(later)).alias("p")).select("p.a", "p.b", "date").repartition(tasks, "a", "b")
    pairs = dealt.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"), F.max("date").alias("last_seen"))
    alone = held.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("c"))
    return pairs, alone, held.agg(F.count(F.lit(1)).alias("n"))


def couplings(pairs: DataFrame, paths: DataFrame, commits: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of ``least`` commits or more with their strength, from the counts of ``pairs_and_paths``."""
    ends = lambda end, n: paths.select(F.col("path").alias(end), F.col("c").alias(n))
    named = pairs.where(F.col("count") >= least).join(ends("a", "ca"), "a").join(ends("b", "cb"), "b").crossJoin(F.broadcast(commits))  # one row
    pmi = F.log2(F.col("count") * F.col("n") / (F.col("ca") * F.col("cb")))
    return named.select("a", "b", "count", pmi.alias("pmi"), (F.col("count") / (F.col("ca") + F.col("cb") - F.col("count"))).alias("jaccard"), "last_seen")


def cochanges(changes: DataFrame, least: int = 2, most_files: int = MOST_FILES) -> DataFrame:
    """Pairs of paths changed together: (a, b, count, pmi, jaccard, last_seen) from (commit, path, date); see ``pairs_and_paths``."""
    return couplings(*pairs_and_paths(changes, most_files), least)


def proximity_edges(files: DataFrame, smallest: int = 3, group: tuple[int, int] = (2, 4)) -> DataFrame:
    """Pairs of files whose lower-case names without extension and test suffix agree, in groups of two to four."""
    name = F.regexp_replace(F.lower(F.regexp_extract("file_path", r"([^/]+)$", 1)), r"\.[^.]*$", "")
    stem = F.regexp_replace(name, r"(tests?|specs?)$", "")
    stems = files.select("file_path", stem.alias("stem")).where(F.length("stem") >= smallest)
    # counts first: only groups small enough are ever gathered
    small = stems.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(*group)).select("stem")
    held = stems.join(small, "stem")
    return held.alias("x").join(held.alias("y"), "stem").where("x.file_path < y.file_path").select(F.col("x.file_path").alias("a"), F.col("y.file_path").alias("b"))


def owning_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Each file with the longest project folder that its path begins with: an equi-join on the file's own ancestors."""
    parts = F.split("file_path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    held = files.select("file_path", F.explode(ancestors).alias("project_dir")).join(projects.select("project_dir"), "project_dir", "left_semi")
    return held.groupBy("file_path").agg(F.max_by("project_dir", F.length("project_dir")).alias("project_dir"))


def reference_edges(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """Distinct (a, b) from files that use a type (file_path, type) to other files that declare it."""
    return references.select(F.col("file_path").alias("a"), "type").distinct().join(declarations.select(F.col("file_path").alias("b"), "type").distinct(), "type").where("a <> b").select("a", "b").distinct()


def grouped_links(links: DataFrame) -> DataFrame:
    """Parallel edges between two files as one, with their number and first type."""
    return links.groupBy("from_file", "to_file").agg(F.count(F.lit(1)).alias("links"), F.min("type").alias("type"))


def directory_of(path) -> Column:
    """The folder of a path; a file at the root is in ``.``."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.+)/[^/]*$", 1), F.lit("")), F.lit("."))


def directory_rollup(links: DataFrame) -> DataFrame:
    """Links between different folders, counted; folders that differ in case alone are one."""
    ends = links.select(directory_of("from_file").alias("from_dir"), directory_of("to_file").alias("to_dir"))
    return ends.where(F.lower("from_dir") != F.lower("to_dir")).groupBy("from_dir", "to_dir").agg(F.count(F.lit(1)).alias("links"))


def directory_totals(files: DataFrame) -> DataFrame:
    """(directory, files, tokens, centrality): sums over the files (file_path, tokens, centrality) of each folder, its name in any case; named by its first spelling."""
    sums = [F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"), F.round(F.sum("centrality"), 4).alias("centrality")]
    return files.withColumn("folder", directory_of("file_path")).groupBy(F.lower("folder").alias("low")).agg(F.min("folder").alias("directory"), *sums).drop("low")


def seed_cascade(files: DataFrame, types: DataFrame, seed: str) -> DataFrame:
    """Files for a seed: the exact path, else the file name, else a declared type, else a folder prefix."""
    low = seed.lower()
    path = F.lower("file_path")
    level = F.when(path == low, 0).when(F.regexp_extract(path, r"([^/]+)$", 1) == low, 1).when(F.startswith(path, F.lit(low.rstrip("/") + "/")), 3)
    found = files.select("file_path", level.alias("level")).where("level IS NOT NULL").unionByName(types.where(F.lower("type") == low).select("file_path", F.lit(2).alias("level")))
    best = found.agg(F.min("level").alias("best"))
    return found.crossJoin(F.broadcast(best)).where("level = best").select("file_path", "level").distinct()


def focus(edges: DataFrame, seeds: DataFrame, depth: int, ways: str = "both", centrality: DataFrame | None = None, share: float = 0.0, costs: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """Files around focus files: half the score per hop, whatever the edge; blended with a share of centrality (node, rank).

    With ``costs`` (node, cost) and a budget, only those that fit it, best first (see ``within_budget``).
    """
    found = expand(edges, seeds, depth, threshold=0.0, decay=0.5, weight=lambda kind: F.when(kind.isNotNull(), F.lit(1.0)).otherwise(F.lit(1.0)), fan_out=False, ways=ways)
    if centrality is not None:
        found = found.join(centrality, "node", "left").withColumn("score", F.col("score") + share * F.coalesce("rank", F.lit(0.0))).drop("rank")
    return found if budget is None else within_budget(found, costs, budget)


def subgraph(nodes: DataFrame, links: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Files (file_path) under a folder, and the links (from_file, to_file) with both ends there."""
    under = lambda c: F.startswith(F.lower(c), F.lit(prefix.lower().rstrip("/") + "/"))
    return nodes.where(under(F.col("file_path"))), links.where(under(F.col("from_file")) & under(F.col("to_file")))


def project_neighbours(files: DataFrame, projects: DataFrame, links: DataFrame, file_path: str, most: int = 48) -> DataFrame:
    """Files of the projects that a file's project refers to or is referred to by, the first by path. ``links``: from_dir, to_dir."""
    owned = owning_project(files, projects)
    own = owned.where(F.col("file_path") == file_path).select(F.col("project_dir").alias("own"))  # one row
    both = links.select("from_dir", "to_dir").unionByName(links.select(F.col("to_dir").alias("from_dir"), F.col("from_dir").alias("to_dir")))
    linked = both.join(F.broadcast(own), F.col("from_dir") == F.col("own")).select(F.col("to_dir").alias("project_dir")).distinct()
    return owned.join(linked, "project_dir", "left_semi").where(F.col("file_path") != file_path).orderBy("file_path").limit(most)


def within_budget(found: DataFrame, costs: DataFrame, budget: int) -> DataFrame:
    """Reached nodes (node, score, hop) that fit a budget, best first; one that doesn't fit is skipped and later ones are still tried."""
    rows = found.join(costs, "node", "left").select(F.lit("focus").alias("plan"), F.col("node").alias("path"), "score", "hop", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), (F.col("hop") == 0).alias("must_keep"))
    return pack_plan(rows, budget).where("kept").select(F.col("path").alias("node"), "score", "hop", "cost")


def graph_view(files: DataFrame, types: DataFrame, links: DataFrame, most: int = 25) -> DataFrame:
    """Files with their first type names, at most ``most``, their token cost, and their share of the highest degree to four places."""
    named = types.groupBy("file_path").agg(F.slice(F.sort_array(F.collect_set("name")), 1, most).alias("types"))  # a file's own types
    ends = links.select(F.col("from_file").alias("file_path")).unionByName(links.select(F.col("to_file").alias("file_path")))
    degree = ends.groupBy("file_path").agg(F.count(F.lit(1)).alias("degree"))
    top = degree.agg(F.max("degree").alias("top"))  # one row
    shares = degree.crossJoin(F.broadcast(top)).select("file_path", F.round(F.col("degree") / F.col("top"), 4).alias("centrality"))
    view = files.select("file_path", "tokens").join(named, "file_path", "left").join(shares, "file_path", "left")
    return view.select("file_path", "tokens", F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.coalesce("centrality", F.lit(0.0)).alias("centrality"))
