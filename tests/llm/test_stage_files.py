"""Steps over small tables write no file for each shuffle partition, also where Spark doesn't coalesce them."""

import random

import pytest
from loomdex.llm import common
from loomdex.llm import language_id as language
from loomdex.llm.components import components
from loomdex.llm.mixing import balanced_copies
from loomdex.llm.sharding import kd_shards

PIECES = sorted([language.MARK, *"abcdeno", "▁a", "ab", "▁ab"])


@pytest.fixture
def dealt(spark):
    """A session with many shuffle partitions that stay as they are."""
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def written(monkeypatch):
    """Names of the stages from now on, each with the number of its files."""
    found, path_of = [], common.shared_path

    def noted(spark, name):
        found.append((name, path := path_of(spark, name)))
        return path

    monkeypatch.setattr(common, "shared_path", noted)

    def files(spark):
        return [(name, len(spark.read.parquet(path).inputFiles())) for name, path in found]

    return files


def test_rounds_of_components_have_few_files(dealt, written):
    rng = random.Random(5)
    links = {(rng.randrange(400), rng.randrange(400)) for _ in range(300)} | {(i, i + 1) for i in range(1000, 1200)}
    root = {x: x for link in links for x in link}
    for _ in root:
        changed = [(a, b) for a, b in links if root[a] != root[b]]
        if not changed:
            break
        for a, b in changed:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(dealt.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in link and link[0] != link[1] for link in links)}
    rounds = written(dealt)[1:]
    assert rounds and max(n for _, n in rounds) <= dealt.sparkContext.defaultParallelism


def test_components_of_no_links(dealt):
    assert components(dealt.createDataFrame([], "a long, b long")).count() == 0


def test_steps_of_mixing_and_sharding_have_few_files(dealt, written):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 60))), "en", rng.choice("xyz")) for i in range(400)]
    frame = dealt.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    assert balanced_copies(frame).count() == 400
    assert kd_shards(frame, n_shards=8).count() == 400
    few = [n for name, n in written(dealt) if name in ("mix-dual", "shard-cuts")]
    assert len(few) > 10 and max(few) <= dealt.sparkContext.defaultParallelism


def test_a_stage_of_many_rows_keeps_its_tasks(dealt):
    rows = dealt.range(1000).selectExpr("id % 500 AS k").groupBy("k").count()
    few = len(common.stage(rows, "few", 1000).inputFiles())
    assert few <= dealt.sparkContext.defaultParallelism < len(common.stage(rows, "many", 60 * common.ROWS_PER_TASK).inputFiles())


def test_language_model_leaves_neither_files_nor_cached_counts(dealt, written):
    docs = [(i, w * 5, lang) for i in range(40) for w, lang in (("abc ", "x"), ("dead one ", "y"))]
    frame = dealt.createDataFrame(docs, "doc_id long, text string, lang string")
    languages, model = language.train(frame, PIECES)
    assert languages == ["x", "y"] and model.shape == (len(PIECES) + 1, 2)
    assert written(dealt) == []
    assert not dealt.sparkContext._jsc.getPersistentRDDs()
