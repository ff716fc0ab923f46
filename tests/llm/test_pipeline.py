import itertools
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from loomdex.llm import language_id as language
from loomdex.llm.decontaminate import common_subsequence, words_of
from loomdex.llm.similar import shingles
from loomdex.llm.common import stage


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        counts.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns
        assert all(before[r["doc_id"]]["text"] == r["text"] for r in docs.collect())
    assert counts[1] >= counts[2] > counts[3] > 0
    rows = docs.collect()
    for s in range(corpus_pipeline.SHARDS):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3


def test_null_and_repeated_ids_and_empty_tables(spark, sf_dir):
    rows = [(None, "the one and only text of this kind", "en", "a", 1), (None, "another text of the same kind here", "en", None, 2), (1, None, None, None, None), (2, "the same words again and again", "en", "b", 3), (2, "the same words again and again", "en", "b", 3), (3, "12 34", None, "b", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = frame
    sizes = {}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        sizes[name] = docs.count()
    assert sizes["language_id"] == 4 and sizes["near_dedup"] == 3 == sizes["decontamination"]
    docs = frame.limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_run_equals_brute_force(spark, sf_dir):
    """What each stage keeps, by plain loops over all documents, all pairs and all items."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    pieces = language.vocabulary()
    languages, model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces)
    ids, seen = language.numbered(pieces), {}

    def sure(text):
        words = language.words_of(text)
        for w in words:
            if w not in seen:
                seen[w] = language.long_word(w, ids, model)
        sums = sum(seen[w] for w in words) if words else None
        return sums is not None and 1 / np.exp(sums - sums.max()).sum() >= 0.5

    left = {d for d, r in docs.items() if sure(r["text"])}
    sets = {d: set(shingles(docs[d]["text"], 5).tolist()) for d in left}
    root = {d: d for d in left}
    near = [(a, b) for a, b in itertools.combinations(sorted(left), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(30):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    left = {d for d in left if root[d] == d}
    words = {d: words_of(docs[d]["text"]) for d in left}
    holds = {d for d in left if any(b" " + b" ".join(i) + b" " in b" " + b" ".join(words[d]) + b" " for i in items)}
    partly = {d for d in left if any(common_subsequence(i, words[d]) >= 0.6 * len(i) for i in items)}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    got = Counter(r["doc_id"] for r in rows)
    assert holds and not holds & set(got) and set(got) <= left and max(got.values()) <= 3
    assert all(docs[r["doc_id"]]["text"] == r["text"] for r in rows)
    # what the mix drops it drops whole sources' shares of, so that each source meets its target
    size = lambda d: len((docs[d]["text"] or "").split())
    sizes, taken = Counter(), Counter()
    for d in left - partly:
        sizes[docs[d]["source"]] += size(d)
    for d, n in got.items():
        taken[docs[d]["source"]] += n * size(d)
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 0.1 * sum(sizes.values()) and all(taken[x] <= 3.05 * sizes[x] + 50 for x in sizes)
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        shard_of[r["text"]].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in shard_of.values())


def test_columns_that_clash_with_those_of_stages(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 AS shard", "2 AS slot", "3 AS copies", "4 AS __row", "5 AS times", "6 AS component_id", "7 AS size", "8 AS row")
    docs = frame
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        if name != "sharding":
            assert docs.columns == frame.columns
    assert {(r["copies"], r["__row"], r["times"], r["component_id"], r["size"], r["row"]) for r in docs.collect()} == {(3, 4, 5, 6, 7, 8)}
    assert len({r["shard"] for r in docs.collect()}) == corpus_pipeline.SHARDS


def test_no_language_at_all_keeps_documents_with_a_letter(spark, sf_dir):
    rows = [(1, "words of a text"), (2, None), (3, "123"), (4, "é")]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, sf_dir).collect()} == {1, 4}
