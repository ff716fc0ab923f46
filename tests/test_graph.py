import heapq
import math
import random
from collections import Counter, defaultdict

import pytest
from loomdex.operators import graph

KINDS = ["route_handles", "implements", "references", "hosted_service"]


def heap_expansion(edges, seeds, depth, threshold):
    around, fan = defaultdict(set), Counter()
    for a, b, k in edges:
        around[a].add((b, k))
        around[b].add((a, k))
        fan[a, k] += 1
        fan[b, k] += 1
    queue = [(-s, 0, n) for n, s in seeds.items()]
    heapq.heapify(queue)
    done = {}
    while queue:
        score, hop, node = heapq.heappop(queue)
        if node in done:
            continue
        done[node] = (-score, hop)
        if hop == depth:
            continue
        for other, kind in around[node]:
            next_score = -score * graph.EDGE_WEIGHTS.get(kind, 0.10) * 0.65 / math.sqrt(fan[node, kind])
            if next_score >= threshold and other not in done:
                heapq.heappush(queue, (-next_score, hop + 1, other))
    return {n: (round(s, 9), h) for n, (s, h) in done.items()}


@pytest.mark.parametrize("seed", range(4))
def test_expansion_equals_a_heap(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(10)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(KINDS)) for _ in range(22)] + [("n0", "n0", "implements")]
    seeds = {"n0": 1.0, "n1": 0.613}
    depth, threshold = 1 + seed % 3, 0.001
    got = graph.expand(spark.createDataFrame(edges, "from string, to string, type string"), spark.createDataFrame(list(seeds.items()), "node string, score double"), depth, threshold)
    assert {r["node"]: (round(r["score"], 9), r["hop"]) for r in got.collect()} == heap_expansion(edges, seeds, depth, threshold)


def test_weak_types_do_not_cross_the_default_threshold(spark):
    edges = spark.createDataFrame([("a", "b", "references"), ("a", "c", "hosted_service"), ("a", "d", "implements")], "from string, to string, type string")
    got = graph.expand(edges, spark.createDataFrame([("a", 1.0)], "node string, score double"), 2)
    assert {r["node"] for r in got.collect()} == {"a", "d"}


def test_cochange_leaves_out_large_commits(spark):
    rows = [(1, "a", 3), (1, "b", 3), (2, "a", 2), (2, "b", 2), (2, "c", 2)] + [(3, f"f{i}", 1) for i in range(41)]
    got = graph.cochanges(spark.createDataFrame(rows, "commit int, path string, date int")).collect()
    assert [(r["a"], r["b"], r["count"], r["last_seen"], r["jaccard"], round(r["pmi"], 6)) for r in got] == [("a", "b", 2, 3, 1.0, 0.0)]


def test_degrees_count_self_loops_twice(spark):
    edges = spark.createDataFrame([("a", "a", "x"), ("a", "b", "x")], "from string, to string, type string")
    assert {r["node"]: r["degree"] for r in graph.degrees(edges).collect()} == {"a": 3, "b": 1}


def test_hubs_are_cut_into_shares(spark):
    rng = random.Random(3)
    edges = [("hub", f"n{i}", "x") for i in range(40)] + [(f"n{rng.randrange(40)}", rng.choice(["hub", "n1", "n2"]), "x") for _ in range(30)]
    frame = spark.createDataFrame(edges, "from string, to string, type string")
    whole, cut = ({r["node"]: round(r["rank"], 12) for r in graph.pagerank(frame, hub_links=most).collect()} for most in (1000, 3))
    assert whole == cut and max(whole.values()) == 1.0


def test_expansion_joins_changed_labels_alone(spark, monkeypatch):
    """The offers of a round come from the labels that the round before has changed."""
    edges = [(f"a{i}", f"a{i + 1}", "route_handles") for i in range(6)] + [("a0", f"b{i}", "tests") for i in range(50)]
    made = []
    monkeypatch.setattr(graph, "saved", lambda df, name="t", f=graph.saved: made.append((name, f(df, name))) or made[-1][1])
    got = graph.expand(spark.createDataFrame(edges, "from string, to string, type string"), spark.createDataFrame([("a0", 1.0)], "node string, score double"), 6, 0.0)
    assert got.count() == 57
    fresh = [frame.count() for name, frame in made if name == "fresh"]
    assert fresh[0] == 51 and all(n <= 55 for n in fresh[1:]) and len(fresh) <= 9


def test_budget_passes_over_what_does_not_fit(spark):
    edges = spark.createDataFrame([("s", x, "tests") for x in "abc"], "from string, to string, type string")
    costs = spark.createDataFrame([("s", 900), ("a", 60), ("b", 500), ("c", 40)], "node string, cost long")
    got = graph.focus(edges, spark.createDataFrame([("s", 1.0)], "node string, score double"), 1, costs=costs, budget=1000)
    assert {r["node"] for r in got.collect()} == {"s", "a", "c"}


def test_directories(spark):
    links = spark.createDataFrame([("a/x", "b/y"), ("a/x", "A/z"), ("root", "a/b/c"), ("a/q", "b/y")], "from_file string, to_file string")
    assert {tuple(r) for r in graph.directory_rollup(links).collect()} == {("a", "b", 2), (".", "a/b", 1)}
    files = spark.createDataFrame([("a/x", 3, 0.1), ("A/y", 4, 0.25), ("root", 5, 0.0), ("/top", 6, 0.0)], "file_path string, tokens long, centrality double")
    assert {tuple(r) for r in graph.directory_totals(files).collect()} == {("A", 2, 7, 0.35), (".", 2, 11, 0.0)}
