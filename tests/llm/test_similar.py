import random

import corpus_pipeline
from loomdex.llm.similar import shingles, similar_components, similar_links


def similarity(a, b):
    x, y = set(shingles(a, 5).tolist()), set(shingles(b, 5).tolist())
    return len(x & y) / len(x | y)


def near_pairs(n, rng):
    """(text, changed text) with random words replaced, of a similarity from 0.8 to 0.95."""
    while n:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(80, 400))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) * rng.randrange(5, 25) // 1000)):
            other[at] = "changed"
        a, b = " ".join(words), " ".join(other)
        if 0.8 <= similarity(a, b) < 0.95:
            n -= 1
            yield a, b


def test_links_of_a_band_connect_what_brute_force_connects():
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(9)):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))

    def parts(links):
        root = list(range(60))
        for _ in range(60):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    sets = [shingles(t, 5) for t in texts]
    got = similar_links(sets, 0.8)
    assert len(got) < 60 and parts(got) == parts([(a, b) for a in range(60) for b in range(a) if similarity(texts[a], texts[b]) >= 0.8])


def test_the_pipeline_drops_near_copies_of_similarity_0_8(spark, sf_dir):
    rng = random.Random(4)
    pairs = list(near_pairs(100, rng))
    rows = [(2 * i + k, text, "en", "a", len(text)) for i, pair in enumerate(pairs) for k, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert {i for i in kept if i % 2 == 0} == set(range(0, 200, 2))
    assert len(kept) <= 101


def test_odd_inputs(spark):
    schema = "i long, text string"
    assert similar_components(spark.createDataFrame([], schema), "i").count() == 0
    rows = [(1, None), (2, ""), (5, "a  b"), (6, "A b"), (7, "w " * 50000), (8, "w w w w w w"), (9, "other")]
    got = {r["i"]: r["component_id"] for r in similar_components(spark.createDataFrame(rows, schema), "i").collect()}
    assert got == {1: 1, 2: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}


def test_heavy_bands_are_split_and_lose_no_pair(spark):
    rng = random.Random(6)
    rows = []
    for i in range(80):
        words = [f"w{j}" for j in range(120)]
        words[rng.randrange(120)] = f"x{i}"
        rows.append((f"d{i:03}" if i else None, i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id string, i long, text string")
    whole = {r["i"]: r["component_id"] for r in similar_components(docs, "i").collect()}
    split = {r["i"]: r["component_id"] for r in similar_components(docs, "i", heavy=3).collect()}
    by_size = {r["i"]: r["component_id"] for r in similar_components(docs, "i", heavy_shingles=1000).collect()}
    assert whole == split == by_size == dict.fromkeys(range(80), 0)
