import math
import zlib
from collections import Counter

import numpy as np
import xxhash
from loomdex.llm import lm_score
from loomdex.llm.common import held_out
from loomdex.llm.lm_score import LEVEL_COUNTS, Filter, levels_of, mix, op2_lm_score, part_of, score_texts, segment


def brute(docs, trained):
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    c = Counter(w for t in trained for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for t in docs:
        ts = tokens(t)
        out.append((len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts)))
    return out


def test_filter_finds_levels_and_few_others():
    keys = mix(np.arange(40_000, dtype=np.uint64))
    counts = np.random.default_rng(0).zipf(1.5, len(keys)).clip(1, 10**6)
    order = np.argsort(part_of(keys, 4))
    parts = [segment(keys[part_of(keys, 4) == p], levels_of(counts[part_of(keys, 4) == p]), 8.0) for p in range(16)]
    model = Filter(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), 4)
    found, want = model.count(keys[order]), LEVEL_COUNTS[levels_of(counts[order])]
    assert (found >= want).all() and (found == want).mean() > 0.95
    assert (model.count(mix(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64))) > 0).mean() < 0.04


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    want = dict(zip([d for d, _ in docs], brute([t for _, t in docs], [t for d, t in docs if not out[d]]), strict=True))
    got = op2_lm_score(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # a better model of unseen texts


def test_rare_words_are_joined_and_odd_inputs_score(spark):
    rows = [(1, None, 9), (1, None, 9), (None, "A b a", None), (3, "", 1), (4, "zz \x1f " + "a " * 30000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in score_texts(docs, docs, hot_words=1).collect())
    assert got == sorted((*x[:3], round(x[3], 6)) for x in brute([r[1] for r in rows], [r[1] for r in rows]))
    empty = docs.limit(0)
    assert score_texts(empty, docs).count() == 0
    assert {r["n_known"] for r in score_texts(docs, empty).collect()} == {0}


MASK = (1 << 64) - 1


def scramble(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def test_scores_are_recomputed_by_plain_probes(spark, sf_dir):
    """Word by word with whole numbers, over the bits of the filter; and those bits hold every count."""
    gold = 0x9E3779B97F4A7C15
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trained = docs.where(~held_out(docs["doc_id"], 7))
    texts = trained.select("text")
    words = lm_score.word_counts(texts)
    table = {r["part"]: bytes(r["bits"]) for r in lm_score.build_segments(texts, words, 5).collect()}

    def count(key):
        bits = table.get(key >> 59, b"")
        for q in range(1, 64):
            places = [scramble(key + gold * (q * 4 + probe + 1) & MASK) % (8 * len(bits)) for probe in range(4)] if bits else []
            if not bits or not all(bits[i >> 3] >> (i & 7) & 1 for i in places):
                return LEVEL_COUNTS[q - 1]
        return LEVEL_COUNTS[63]

    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    word_key = lambda w: scramble(xxhash.xxh64_intdigest(w) + gold & MASK)
    pair_key = lambda a, b: scramble((xxhash.xxh64_intdigest(a) * gold + scramble(xxhash.xxh64_intdigest(b))) & MASK)
    exact = Counter(w for r in texts.collect() for w in tokens(r["text"]))
    assert all(count(word_key(w)) >= LEVEL_COUNTS[levels_of(np.array([c]))[0]] for w, c in exact.items())
    n, v, want = sum(exact.values()), len(exact), {}
    for r in docs.limit(40).collect():
        total, before = 0.0, None
        for w in tokens(r["text"]):
            seen, context = count(word_key(w)), count(word_key(before if before else b" "))
            pair, trust = min(count(pair_key(before if before else b"\n", w)), context), context / (context + 4.0)
            total += math.log10(min(1.0, trust * pair / max(context, 1) + (1 - trust) * (seen + 1) / (n + v + 1)))
            before = w
        want[r["doc_id"]] = total
    # the filter's number of segments is part of the model: take the same one
    segments = lm_score.build_segments(texts, words, 5)
    sizes = np.zeros(32, np.int64)
    for p, b in table.items():
        sizes[p] = len(b)
    hot = lm_score.hot_counts(words, 100)
    asked = docs.selectExpr("monotonically_increasing_id() AS row", "doc_id AS id", "text")
    for got in (lm_score.scored_by_broadcast(asked, lm_score.gathered(segments, sizes, 5), hot, n, v), lm_score.scored_by_segment(asked, segments, 5, hot, n, v)):
        found = {r["id"]: r["score"] for r in got.collect()}
        assert len(found) == docs.count() and all(math.isclose(found[d], x, rel_tol=1e-9) for d, x in want.items())


def test_a_filter_beyond_the_broadcast_gives_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(docs_id := "doc_id", "text")
    docs = docs.withColumn(docs_id, docs[docs_id].cast("string")).unionByName(spark.createDataFrame([(None, None), ("x", "")], "doc_id string, text string"))
    trained = docs.where("text IS NOT NULL")
    rows = lambda bound: sorted((tuple(r) for r in score_texts(docs, trained, hot_words=50, max_filter_bytes=bound).collect()), key=str)
    small, large = rows(0), rows(1 << 30)
    assert [r[:4] for r in small] == [r[:4] for r in large]
    assert all(math.isclose(a[4], b[4], rel_tol=1e-12) and math.isclose(a[5], b[5], rel_tol=1e-12) for a, b in zip(small, large, strict=True))


def test_blobs_iterate_over_the_parts_that_occur():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1_000_000, np.uint64))
    counts = np.ones(len(keys), np.int64)
    few = lm_score.blobs(keys, counts, lm_score.RANGE_BITS)
    assert few.num_rows <= 1 << lm_score.RANGE_BITS and b"".join(few.column(1).to_pylist()) == keys.tobytes()
    assert lm_score.runs_of(np.array([3, 3, 7, 9, 9])) == [(3, 0, 2), (7, 2, 3), (9, 3, 5)] and lm_score.runs_of(np.zeros(0, np.int64)) == []


def test_segments_in_two_steps_are_those_of_one(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    words = lm_score.word_counts(texts)
    read = lambda frame: {r["part"]: bytes(r["bits"]) for r in frame.collect()}
    one = read(lm_score.build_segments(texts, words, 6))
    assert read(lm_score.build_segments(texts, words, 6, range_bits=2)) == one
    assert read(lm_score.build_segments(texts, words, 6, range_bits=2, range_tokens=5000, n=200_000)) == one and len(one) == 64
