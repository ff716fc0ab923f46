import math

import numpy as np
from loomdex.llm import lm_score


def test_rows_that_are_probed_grow_with_the_tokens(spark, monkeypatch):
    """A filter of 1,024 segments is asked by few rows for many tokens, and gives what the broadcast gives."""
    random = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{n:06d}" for n in random.integers(0, 1000, 20_000))) for i in range(40)], "doc_id long, text string").coalesce(1)
    whole = {r["doc_id"]: r["score"] for r in lm_score.score_texts(docs, docs).collect()}
    asked, stage = [], lm_score.stage

    def kept(frame, name, rows=None):
        out = stage(frame, name, rows)
        if name == "lm-tokens":
            asked.append(out.where("part >= 0").count())
        return out

    monkeypatch.setattr(lm_score, "stage", kept)
    words = lm_score.word_counts(docs.select("text"))
    n, v = 40 * 20_001, 1001
    segments = lm_score.build_segments(docs.select("text"), words, 10)
    rows = docs.selectExpr("monotonically_increasing_id() AS row", "doc_id AS id", "text")
    got = {r["id"]: r["score"] for r in lm_score.scored_by_segment(rows, segments, 10, lm_score.hot_counts(words, 100), n, v).collect()}
    assert 1024 <= asked[0] <= 3 * 1024  # 10 and more chunks of 1,024 rows before
    # other segments have other false positives
    assert got.keys() == whole.keys() and all(math.isclose(got[d], x, rel_tol=0.01) for d, x in whole.items())


def test_keys_are_tallied_in_order():
    keys = np.random.default_rng(5).integers(0, 50, 1000, np.uint64)
    assert [x.tolist() for x in lm_score.tallied(keys)] == [x.tolist() for x in np.unique(keys, return_counts=True)]
    assert [len(x) for x in lm_score.tallied(keys[:0])] == [0, 0]
