import hashlib
import random
import re
import struct

import pytest
import xxhash
from loomdex.llm import minhash_prints as prints
from pyspark.sql import functions as F

TEXTS = ["", " ", "one", "a b", "a b c d e", "a b c d e f", "A B c D e f", "x " * 5000, "é ü\tß\x0b one two three four", *[" ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta", "p q", "rho"], k=i)) for i in (3, 9, 40, 300, 2500)]]


def hashed(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<Q", v), h)
    return h


def brute(text, bins=prints.BINS, bits=prints.BITS, words=prints.WORDS):
    """The low-order bits of each bin, by probing bin after bin."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    tokens = [hashed([w.encode()]) for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    shift = 64 - bins.bit_length()
    own = {}
    for i in range(max(1, len(tokens) - words + 1)):
        key = (hashed(tokens[i : i + words]) >> 1) & ~1
        own[key >> shift] = min(own.get(key >> shift, key), key)
    starts, steps, _ = prints.probing(bins)
    out = []
    for j in range(bins):
        at = j
        if at not in own:
            at = starts[j]
            while at not in own:
                at = (at + steps[j]) % bins
        out.append(own[at] >> 1 & ((1 << bits) - 1))
    return out


def unpacked(longs, bits=prints.BITS):
    return [w >> s & ((1 << bits) - 1) for w in longs for s in range(64 - bits, -1, -bits)]


@pytest.mark.parametrize(("bins", "bits"), [(512, 4), (64, 8), (128, 1), (256, 16)])
def test_fingerprints_equal_brute_force(spark, bins, bits):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: unpacked(r["fingerprint"], bits) for r in prints.fingerprints(docs, bins=bins, bits=bits).collect()}
    assert got == {i: brute(t, bins, bits) for i, t in enumerate(TEXTS)}


def test_query_equals_brute_force(spark, sf_dir):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in prints.op13_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    text = lambda longs: "".join(f"{x:x}" for x in longs)

    def near(a, b):
        return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / prints.BINS - 1 / 16) / (1 - 1 / 16))

    for (doc, own), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half, r = len(own) // 2, got[doc]
        edited = own[: len(own) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        if doc % 5 == 0:
            a, b, c = brute(own), brute(edited), brute(after)
            assert (r["fingerprint"], r["edited_fingerprint"]) == (text(a), text(b))
            assert abs(r["near_edited"] - near(a, b)) < 1e-9 and abs(r["near_next"] - near(a, c)) < 1e-9


def test_likeness_is_near_the_similarity(spark):
    draw = random.Random(5)
    rows, truth = [], {}
    for i in range(300):
        words = [str(draw.randrange(10**6)) for _ in range(draw.choice([20, 60, 200, 1000]))]
        other = list(words)
        for _ in range(draw.randrange(0, len(words) // 6)):
            other[draw.randrange(len(words))] = "new"
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other))
        truth[i] = len(a & b) / len(a | b)
        rows.append((i, " ".join(words), " ".join(other)))
    frame = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r["i"]: r["near"] for r in frame.select("i", prints.likeness(prints.fingerprint(F.col("a")), prints.fingerprint(F.col("b"))).alias("near")).collect()}
    apart = [got[i] - truth[i] for i in got]
    assert abs(sum(apart) / len(apart)) < 0.01 and (sum(x * x for x in apart) / len(apart)) ** 0.5 < 0.05


def test_next_of_odd_rows(spark, monkeypatch):
    rows = [(3, "a b c d e f"), (3, None), (None, "null id"), (None, ""), (9, "x" * 10), (7, "nine"), *[(100 + i, f"text {i}") for i in range(40)]]
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, n_chars long, fingerprint string").coalesce(1)
    for size in (1, 7, 1000):
        monkeypatch.setattr(prints.with_next, "__defaults__", (size,))
        got = {(r["doc_id"], r["n_chars"]): r["edited"] for r in prints.edited_fingerprints(docs).where("doc_id > 8").collect()}
        assert got[9, 10] == "x" * 5 + "nine" and got[100, 6] == "tex" + "xxx" and len(got) == 41
        assert got[139, 7] == "text" + "tex"
        count = prints.edited_fingerprints(docs).groupBy("doc_id").count().collect()
        assert {r["doc_id"]: r["count"] for r in count} == {3: 2, None: 2, 9: 1, 7: 1, **{100 + i: 1 for i in range(40)}}
    assert prints.edited_fingerprints(docs.limit(0)).count() == 0
    one = prints.edited_fingerprints(docs.where("doc_id = 9")).collect()
    assert [(r["edited"], r["near_next"]) for r in one] == [("x" * 10, 1.0)]
    nulls = prints.edited_fingerprints(docs.where("doc_id IS NULL OR doc_id = 3")).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"], r["edited"]) for r in nulls)[:2] == [(False, 0, ""), (False, 11, "a b c ")]


def test_no_python_and_one_shuffle_of_texts(spark, sf_dir):
    plan = prints.op13_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_other_sizes_are_refused():
    for bins, bits in ((500, 4), (512, 3), (8, 4)):
        with pytest.raises(ValueError):
            prints.fingerprint(None, bins, bits)
