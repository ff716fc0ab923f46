import random
import zlib

import numpy as np
from loomdex.llm import language_id as language
from loomdex.llm import quality
from pyspark.sql import functions as F

PIECES = sorted([language.MARK, *"abcdeno", "▁a", "ab", "▁ab", "bc", "abc", "de", "one", "▁one"])


def brute(word, probability, unknown):
    s = language.MARK + word

    def total(i):
        if i == len(s):
            return 1.0
        out = 0.0
        for j in range(i + 1, len(s) + 1):
            p = probability.get(s[i:j], unknown if j == i + 1 else 0.0)
            if p:
                out += p * total(j)
        return out

    return total(0)


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    model = np.vstack([rng.random((len(PIECES), 2)), np.full((1, 2), language.UNKNOWN)])
    words = ["abc", "a", "abcdeabc", "xone", "one", "zz"]
    got = np.exp(language.Lattice(words, language.numbered(PIECES), len(PIECES)).log_probabilities(model))
    for m in range(2):
        table = dict(zip(PIECES, model[:-1, m], strict=True))
        assert np.allclose(got[:, m], [brute(w, table, language.UNKNOWN) for w in words])
    for i, w in enumerate(words):
        assert np.allclose(np.exp(language.long_word(w, language.numbered(PIECES), model)), got[i])


def test_long_words_do_not_underflow():
    pieces = language.vocabulary()
    ids, model = language.numbered(pieces), np.random.default_rng(2).random((len(pieces) + 1, 2)) * 1e-4
    word = "unbelievable" * 2
    short = language.Lattice([word], ids, len(pieces)).log_probabilities(model)[0]
    assert np.allclose(language.long_word(word, ids, model), short)
    assert np.isfinite(language.long_word("ab" * 10_000, ids, model)).all()


def test_expected_uses_are_those_of_the_posterior():
    model = np.r_[np.random.default_rng(1).random(len(PIECES)), language.UNKNOWN]
    lattice = language.Lattice(["abc", "abde"], language.numbered(PIECES), len(PIECES))
    uses = lattice.expected(model, np.array([1.0, 3.0]))
    total = lambda w: np.log(brute(w, dict(zip(PIECES, model, strict=False)), language.UNKNOWN))
    # derivative of the log probability by the log of a piece's probability
    for i, piece in enumerate(PIECES):
        up = model.copy()
        up[i] *= 1 + 1e-6
        more = lambda w: np.log(brute(w, dict(zip(PIECES, up, strict=False)), language.UNKNOWN))
        slope = sum(n * (more(w) - total(w)) / 1e-6 for w, n in (("abc", 1), ("abde", 3)))
        assert abs(slope - uses[i]) < 1e-4, piece


def test_language_query_is_right_on_held_out_texts(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = language.op10_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def test_language_query_equals_brute_force(spark, sf_dir):
    """Posteriors recomputed by a plain forward pass over each word, with the same fitted model."""
    from loomdex.llm.common import held_out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    pieces = language.vocabulary()
    languages, model = language.train(docs.where(~held_out(F.col("doc_id"), 4)), pieces)
    tables = [dict(zip(pieces, model[:-1, m].tolist(), strict=True)) for m in range(len(languages))]
    seen = {}

    def word(w):
        if w not in seen:
            s, out = language.MARK + w, []
            for table in tables:
                reach = [1.0] + [0.0] * len(s)
                for i in range(len(s)):
                    for j in range(i + 1, len(s) + 1):
                        reach[j] += reach[i] * table.get(s[i:j], language.UNKNOWN if j == i + 1 else 0.0)
                out.append(np.log(reach[-1]))
            seen[w] = np.array(out)
        return seen[w]

    got = {r["doc_id"]: r for r in language.op10_language_id(spark, sf_dir).collect()}
    for r in docs.limit(60).collect():
        words = language.words_of(r["text"])
        if not words:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        sums = sum(word(w) for w in words)
        assert got[r["doc_id"]]["lang_pred"] == languages[int(sums.argmax())]
        assert abs(got[r["doc_id"]]["score"] - 1 / np.exp(sums - sums.max()).sum()) < 1e-6


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "le chat et le chien", "fr", 2), (3, None, "en", 3), (4, "12 !? ² _", None, 4), (4, "12 !? ² _", None, 4), (None, "the " * 50000, None, 5), (6, "", "en", 6), (7, "x" * 5000, None, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    pieces = language.vocabulary()
    languages, model = language.train(frame, pieces)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(frame, languages, model, pieces).collect()}
    assert languages == ["en", "fr"] and {(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (None, "en"), (6, "und")} <= got
    kept = language.identified(frame, languages, model, pieces)
    assert kept.columns == frame.columns and sorted(r["score"] for r in kept.collect())[:3] == [1, 2, 5]
    assert {r["lang_pred"] for r in language.identify(frame, *language.train(frame.limit(0), pieces), pieces).collect()} == {"und"}
    assert language.identify(frame.limit(0), languages, model, pieces).count() == 0


def test_quality_query_separates_held_out_rows(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = quality.op4_quality(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_quality_query_equals_brute_force(spark, sf_dir):
    """Features, training and scores once more with plain numbers and dictionaries."""
    import re

    import xxhash

    mask, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2

    def features(text):
        tokens = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")
        words = [xxhash.xxh64_intdigest(t.lower()) for t in tokens]
        shapes = [xxhash.xxh64_intdigest("=", 1) if i and words[i] == words[i - 1] else xxhash.xxh64_intdigest(quality.shape(t), 1) for i, t in enumerate(tokens)]
        out = {0: 1.0}
        for kind, (ids, orders) in enumerate(((words, 2), (shapes, 3))):
            count = {}
            for order in range(orders):
                for at in range(len(ids) - order):
                    code = 11 + kind
                    for x in ids[at : at + order + 1]:
                        code = code * odd & mask ^ x
                    slot = ((code * odd & mask) >> 32) % ((1 << 18) - 1) + 1
                    count[slot] = count.get(slot, 0) + 1
            norm = sum((1 + np.log(n)) ** 2 for n in count.values()) ** 0.5
            for slot, n in count.items():
                out[slot] = out.get(slot, 0.0) + (1 + np.log(n)) / norm
        return out

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: int(r["quality"] != 0) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] is not None and not held(r["doc_id"]) and r["doc_id"] in texts}
    z, n = {}, {}

    def weight(slot):
        a = z.get(slot, 0.0)
        return 0.0 if abs(a) <= 0.02 else -(a - np.sign(a) * 0.02) / ((1.0 + n[slot] ** 0.5) / 0.5 + 0.1)

    rows = [({s: float(np.float32(v)) for s, v in features(texts[d]).items()}, labels[d]) for d in sorted(labels, key=lambda d: xxhash.xxh64_intdigest(str(d)))]
    for _ in range(4):
        for row, label in rows:
            w = {s: weight(s) for s in row}
            p = 1 / (1 + np.exp(-sum(w[s] * v for s, v in row.items())))
            for s, v in row.items():
                g, before = (p - label) * v, n.get(s, 0.0)
                z[s] = z.get(s, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / 0.5 * w[s]
                n[s] = before + g * g
    for r in quality.op4_quality(spark, sf_dir).collect():
        want = 1 / (1 + np.exp(-sum(weight(s) * v for s, v in features(texts[r["doc_id"]]).items() if s in z)))
        assert abs(r["score"] - want) < 1e-6 and r["held_out"] == held(r["doc_id"])


def test_quality_of_odd_rows(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(5))
    rows = [(i, " ".join(word() if i % 2 else word().upper() + "!!" for _ in range(30)), None) for i in range(80)]
    rows += [(100, None, 1), (101, "", 1), (None, "x", 1), (102, "A!! " * 30000, 1), (102, "A!! " * 30000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = docs.where("doc_id < 80").select("doc_id", (F.col("doc_id") % 2).alias("quality")).unionByName(spark.createDataFrame([(None, 1), (100, None)], "doc_id long, quality long"))
    weights = quality.train(docs, labels, shard_rows=30)
    got = quality.score(docs, weights).collect()
    assert len(got) == len(rows)
    assert min(r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] < 80 and r["doc_id"] % 2) > max(r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] < 80 and not r["doc_id"] % 2)
    assert len({r["score"] for r in got if r["doc_id"] in (100, 101)}) == 1
    assert {r["score"] for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), weights).count() == 0
