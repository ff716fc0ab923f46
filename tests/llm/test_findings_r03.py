import random

import corpus_pipeline
import pyarrow as pa
from loomdex.llm.lm_score import END, Chunk, coded, hashes_of, tokens_of
from loomdex.llm.similar import shingles


def test_coded_tokens_are_those_of_the_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbÉ\x0b\x0c\x1c\x85   \t\r\n") for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", " ", "x"]
    codes, words, sizes = coded(pa.array(texts))
    names, want = words.to_pylist(), [tokens_of(t) for t in texts]
    assert [names[c] for c in codes] == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want] and names[-1] == END
    assert len(names) == len(set(names))
    chunk = Chunk(pa.array(texts))
    assert chunk.words[chunk.word].tolist() == hashes_of([w for t in want for w in t]).tolist()


def test_near_dedup_links_by_fingerprints_too(spark, sf_dir):
    tail = lambda c: " ".join(f"{c}{i}" for i in range(24))
    texts = ["one two three four five six seven " * 200 + tail(c) for c in "xy"] + ["quite another text of some words"]
    a, b = (set(shingles(t, 5).tolist()) for t in texts[:2])
    assert len(a & b) < 0.5 * len(a | b)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()) == [0, 2]
