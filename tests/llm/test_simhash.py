import itertools

import numpy as np
import pytest
import xxhash
from loomdex.llm.simhash import fingerprint, links_of, near_duplicates, op3_simhash_components, position_sets, tallied_links


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits):
    root = {fp: fp for fp in rows.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(list(root), 2):
        if (a ^ b).bit_count() <= bits:
            root[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for doc in sorted(rows):
        smallest.setdefault(find(rows[doc]), doc)
    return {doc: smallest[find(fp)] for doc, fp in rows.items()}


def test_fingerprints_match_the_definition():
    for text in (None, "", " \t", "One", "one Two three", "a b c d", "a a a a a a a", "É é\x0bÄ b c d e f", "w " * 3000 + "x"):
        assert fingerprint(text, 4) == brute_fingerprint(text, 4)


def test_position_sets_meet_every_match():
    for bits in range(1, 8):
        for kept in itertools.combinations(range(8), 8 - bits):
            assert any(set(s) <= set(kept) for s in position_sets(bits))


def test_links_of_a_posting_connect_what_is_near():
    values = np.array([0, 1, 3, 7, 0xFF, 1 << 63, (1 << 63) | 0xF0000], np.uint64).view(np.int64)
    assert len(tallied_links(values, 4)) == 5  # 0xFF is 5 bits or more from each of the others
    cluster = np.unique(np.random.default_rng(0).integers(0, 256, 3000)).astype(np.int64)
    assert len(tallied_links(cluster, 4)) == len(cluster) - 1


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {d: brute_fingerprint(t, 4) for d, t in docs.items()}
    want = brute_components(rows, 4)
    got = op3_simhash_components(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{rows[d]:016x}", want[d]) for d in rows}
    assert len(got) == len(docs)


def test_heavy_postings_are_split_and_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, np.uint64)
    values = np.unique(np.concatenate([base[i % 6] ^ (np.uint64(1) << rng.integers(0, 64, 1, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1, np.uint64)) for i in range(600)])).view(np.int64)
    frame = spark.createDataFrame([(int(v),) for v in values], "fp long").repartition(3)
    want = brute_components({i: int(v) & (1 << 64) - 1 for i, v in enumerate(values.tolist())}, 4)
    for heavy in (2, 40, 1 << 20):
        links = [(r["a"], r["b"]) for r in links_of(frame, 4, heavy).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
        number = {int(v): i for i, v in enumerate(values.tolist())}
        root = list(range(len(values)))
        for _ in range(40):
            for a, b in links:
                root[number[a]] = root[number[b]] = min(root[number[a]], root[number[b]])
        assert {i: r for i, r in enumerate(root)} == want


def test_odd_inputs(spark):
    schema = "doc_id long, text string, fp string, component_id int"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "x", 1), (2, "", None, None), (2, "", None, None), (None, "a b", "y", 2), (5, "a  b", None, 3), (7, "w " * 50000, None, 0)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (None, 5), (5, 5), (7, 7)], key=str)


@pytest.mark.parametrize("k", [1, 4, 5])
def test_shorter_texts_are_one_shingle(k):
    assert fingerprint("x", k) == brute_fingerprint("x", k)
