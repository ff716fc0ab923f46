"""Queries without SQL against plain Python over the whole tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from loomdex import plans
from loomdex.functions import bpe, stemmer, text
from loomdex.operators import fusion, graph, packing, reduce, search
from loomdex.plans import fixtures, sources
from test_graph import heap_expansion


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def rows(spark, sf_dir, name):
    return plans.queries()[name](spark, sf_dir).collect()


def small_graph(spark, sf_dir):
    edges = [(r["from"], r["to"], r["type"]) for r in fixtures.edges(spark, sf_dir).collect()]
    return edges, {r["node"]: r["file_path"] for r in fixtures.nodes(spark, sf_dir).collect()}


def test_context_plan_and_its_explanation(spark, sf_dir):
    edges, nodes = small_graph(spark, sf_dir)
    found = heap_expansion(edges, {"n3": 1.0}, 2, 0.0)
    limit = graph.expand.__defaults__[0] if graph.expand.__defaults__ else 0.05
    found = heap_expansion(edges, {"n3": 1.0}, 2, limit)
    best = {}
    for node, (score, hop) in found.items():
        if node in nodes and score > best.get(nodes[node], (-1, 0))[0]:
            best[nodes[node]] = (score, hop)
    costs = Counter(nodes.values())
    want, used = {}, 0
    for path, (score, hop) in sorted(best.items(), key=lambda x: (x[1][1] != 0, -x[1][0], x[0])):
        kept = hop == 0 or used + 100 * costs[path] <= 4000
        used += 100 * costs[path] * kept
        want[path] = (round(score, 6), 100 * costs[path], kept)
    got = rows(spark, sf_dir, "pck1_context_plan")
    assert {r["path"]: (r["score"], r["cost"], r["kept"]) for r in got} == want
    assert all(r["tier"] == packing.TIERS.get(r["role"], "skeleton") for r in got)
    explained = rows(spark, sf_dir, "oth9_explained_plan")
    assert sum(r["files"] for r in explained) == len(want) and sum(r["kept"] for r in explained) == sum(k for *_, k in want.values())


def test_graph_discovery(spark, sf_dir):
    edges, nodes = small_graph(spark, sf_dir)
    ranked = {"r1": 0.9, "r2": 0.5, "r3": 0.1}
    seeds = {n: ranked[f] for n, f in nodes.items() if f in ("r1", "r2")}
    limit = graph.expand.__defaults__[0] if graph.expand.__defaults__ else 0.05
    best = defaultdict(float)
    for node, (score, hop) in heap_expansion(edges, seeds, 1, limit).items():
        if hop == 1 and node in nodes:
            best[nodes[node]] = max(best[nodes[node]], score)
    want = sorted(((f, round(s, 6)) for f, s in best.items() if f not in ranked), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r["file_path"], round(r["score"], 6)) for r in rows(spark, sf_dir, "rnk14_graph_discovery")] == want


def test_localize(spark, sf_dir, tables):
    query, most = "thing in src3 of theatre", 20
    weights = {"body": 1.0, "name": 5.0, "symbols": 4.0}
    plain = lambda s: re.findall(r"[^\W_]+", (s or "").lower().translate(str.maketrans(*text.LATIN)))
    chunks = [(r["doc_id"], {"body": plain(r["text"]), "name": plain(r["source"]), "symbols": plain(r["lang"])}, r["source"], f"{r['source']}/{r['lang']}") for r in tables("documents")]
    count = lambda words, p: sum(words[i : i + len(p)] == p for i in range(len(words)))
    of, n = {k: (name, path) for k, _, name, path in chunks}, len(chunks)
    size = {k: sum(map(len, fields.values())) for k, fields, _, _ in chunks}
    mean = sum(size.values()) / n

    def searched(question):
        """Hits of a question in their order, and its lexical candidates with their places."""
        phrases = text.match_terms(question)
        f = {k: [sum(w * count(fields[n], p) for n, w in weights.items()) for p in phrases] for k, fields, _, _ in chunks}
        have = [sum(x[i] > 0 for x in f.values()) for i in range(len(phrases))]
        idf = [max(1e-6, math.log((n - h + 0.5) / (h + 0.5))) for h in have]
        score = {k: sum(i * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[k] / mean)) for i, x in zip(idf, f[k], strict=True) if x) for k in f if any(f[k])}
        hits = sorted(score, key=lambda k: (-score[k], k))[: max(4 * most, 80)]
        tokens = [w for p in phrases for w in p]
        files = {}
        for rank, k in enumerate(hits):
            first, named = files.get(of[k][1], (rank, False))
            files[of[k][1]] = (first, named or any(t in (of[k][0] or "").lower() for t in tokens))
        order = sorted(files, key=lambda p: (files[p][0], p))
        ceiling = lambda p: search.NAME_CEILING if files[p][1] else search.BODY_CEILING
        return hits, tokens, {p: ceiling(p) * (1 - (place / (len(order) - 1) if len(order) > 1 else 0) * search.FALL) for place, p in enumerate(order)}

    hits, tokens, lexical = searched(query)
    first = sorted(lexical, key=lambda p: min(hits.index(k) for k in hits if of[k][1] == p))[:5]
    names = Counter(w for k in hits if of[k][1] in first for w in plain(of[k][0]) if len(w) >= 3 and w not in tokens)
    more = sorted(names, key=lambda w: (-names[w], w))[:6]
    if more:
        second = searched(" ".join([query, *more]))[2]
        lexical |= {p: 0.6 * second[p] for p in [p for p in second if p not in lexical][:8]}
    paths = set()
    for t in [t for t in tokens if len(t) >= 3]:
        paths |= set(sorted({p for *_, p in chunks if t.lower() in p.lower()}, key=lambda p: (len(p), p))[:most])
    fused = {p: 1 - (1 - lexical.get(p, 0)) * (1 - (0.70 if p in paths else 0)) for p in {*lexical, *paths}}
    ranked = sorted(fused, key=lambda p: (-fused[p], p))
    top = fused[ranked[0]]
    cluster = [p for p in ranked if fused[p] >= top - fusion.CLEAR_GAP]
    clear = top >= fusion.CONFIDENT and len(cluster) <= fusion.CLUSTER and len(cluster) < len(ranked)
    want, contents = [], {}
    for r in tables("documents"):
        path, digest = f"{r['source']}/{r['lang']}", hashlib.md5((r["text"] or "").encode()).hexdigest()
        contents[path] = min(digest, contents.get(path, digest))
    for p in cluster if clear else ranked[:10]:
        if contents[p] not in {contents[q] for q in want}:
            want.append(p)
    want = want[:most]
    got = rows(spark, sf_dir, "localize")
    assert {r["file_path"]: round(r["score"], 6) for r in got} == {p: round(fused[p], 6) for p in want}


def test_reduced_files(spark, sf_dir, tables):
    python = lambda p: p.replace(r"\z", r"\Z")
    kinds = {"en": "markdown", "fr": "javascript", "de": "yaml"}
    want = {}
    for r in tables("documents"):
        out = r["text"]
        if out is not None and r["lang"] in kinds:
            for pattern, by in reduce.STEPS[kinds[r["lang"]]]:
                out = re.sub(python(pattern), by.replace("$", "\\"), out, flags=re.A)
        elif out is not None:
            out = re.sub(r"(?m)^[ \t]*\r?\n", "", re.sub(r"(?m)^[ \t]+|[ \t]+$", "", out))
        want[r["doc_id"]] = None if out is None else len(out)
    assert {r["doc_id"]: r["chars"] for r in rows(spark, sf_dir, "red1_reduce_files")} == want


def test_secret_positions(spark, sf_dir, tables):
    from loomdex.operators.emit import secret_positions

    def places(t):
        for kind, pattern in reduce.SECRETS.items():
            for m in re.finditer(pattern, t or "", flags=re.A):
                yield kind, t.count("\n", 0, m.start()) + 1, m.start() - t.rfind("\n", 0, m.start())

    want = Counter((r["doc_id"], *p) for r in tables("documents") for p in places(r["text"]))
    assert Counter(tuple(r) for r in rows(spark, sf_dir, "oth4_secret_positions")) == want
    t = "a\n  password = 'abcdefgh12345678' x\n-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----\ntoken: ABCDEFGHIJKLMN token: ABCDEFGHIJKLMN"
    found = secret_positions(spark.createDataFrame([("p", t)], "path string, text string"), reduce.SECRETS)
    assert Counter((r["kind"], r["line_no"], r["column_no"]) for r in found.collect()) == Counter(places(t)) and len(list(places(t))) == 4


def test_bootstrap_interval_is_near_the_normal_one(spark, sf_dir, tables):
    values = [r["quality"] for r in tables("labels")]
    mean = sum(values) / len(values)
    error = (sum((v - mean) ** 2 for v in values) / len(values) ** 2) ** 0.5
    got = rows(spark, sf_dir, "met3_bootstrap_interval")[0]
    assert abs(got["low"] - (mean - 1.96 * error)) < 0.4 * error and abs(got["high"] - (mean + 1.96 * error)) < 0.4 * error


def test_stratified_sample(spark, sf_dir, tables):
    sizes = Counter(r["source"] for r in tables("documents"))
    got = rows(spark, sf_dir, "met6_stratified_sample")
    assert Counter(r["source"] for r in got) == {s: min(3, n) for s, n in sizes.items()} and len({r["doc_id"] for r in got}) == len(got)
    assert sorted(got) == sorted(rows(spark, sf_dir, "met6_stratified_sample"))


def test_stems_of_all_words(spark, sf_dir, tables):
    words = Counter()
    for r in tables("documents"):
        words.update(re.findall(r"[^\W_]+", (r["text"] or "").lower().translate(str.maketrans(*text.LATIN))))
    got = {r["word"]: (r["stem"], r["n"]) for r in rows(spark, sf_dir, "fts5_stems")}
    assert got == {w: (stemmer.stem(w), n) for w, n in words.items()}


def test_exact_tokens(spark, sf_dir, tables):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks_of(sources.VOCABULARY), special_tokens={})
    want = {r["doc_id"]: len(encoding.encode_ordinary(r["text"] or "")) for r in tables("documents")}
    assert {r["doc_id"]: r["tokens"] for r in rows(spark, sf_dir, "pck15_exact_tokens")} == want


def test_inventory_digest(spark, sf_dir, tables):
    lines = sorted((f"{r['source']}/{r['doc_id']}.{r['lang']}", hashlib.md5(r["text"].encode()).hexdigest()) for r in tables("documents") if r["text"] is not None)
    want = hashlib.sha256("".join(f"{p}\0{h}\0" for p, h in lines).encode()).hexdigest()
    assert [r["digest"] for r in rows(spark, sf_dir, "int2_inventory_digest")] == [want]
