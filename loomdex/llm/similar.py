"""Near-duplicates by the Jaccard similarity of word shingles.

SimHash bits do not reach a similarity of 0.8 (about ten of 64 bits differ there, and the index of
simhash.py guarantees at most seven). Here texts that share a band of minimum hashes meet, and their
whole shingle sets decide. A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components
from .simhash import block_pairs

SEED = 42
BANDS, ROWS = 16, 5
#: Members of a band that a task compares; a heavier band is split into pairs of blocks of half as many.
HEAVY = 4096
#: Shingles of the members of a band that a task holds, eight bytes each; a band with more is split likewise.
HEAVY_SHINGLES = 4_000_000
_RANDOM = np.random.default_rng(SEED)
_FLIPS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words_per_shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    joined, k = b" ".join(words), words_per_shingle
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[: len(words) - k]]]
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band: a hash of its number and its minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[None, at : at + 4096] ^ _FLIPS) * _FACTORS).min(axis=1))
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def similar_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect all sets of a similarity of at least ``least``, fewer than there are sets.

    A set is compared with all that are not reached yet, so that a group of copies takes one step.
    """
    sizes = np.array([len(s) for s in sets])
    left, links, queue = np.arange(len(sets)), [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        x = queue.pop()
        # the smaller of two sets has at least that part of the larger one
        able = np.minimum(sizes[left], sizes[x]) >= least * np.maximum(sizes[left], sizes[x])
        some = left[able]
        if not len(some):
            continue
        every = np.concatenate([sets[i] for i in some])
        at = np.minimum(np.searchsorted(sets[x], every), sizes[x] - 1)
        common = np.add.reduceat((sets[x][at] == every).astype(np.int64), np.r_[0, np.cumsum(sizes[some])[:-1]])
        hit = common >= least * (sizes[some] + sizes[x] - common) - 1e-9
        reached = some[hit].tolist()
        links += [(x, y) for y in reached]
        queue += reached
        left = left[~np.isin(left, some[hit])]
    return links


def similar_components(docs: DataFrame, id_col: str, text_col: str = "text", words_per_shingle: int = 5, least: float = 0.8, heavy: int = HEAVY, heavy_shingles: int = HEAVY_SHINGLES) -> DataFrame:
    """(id_col, component_id): the smallest id that a text reaches by pairs of at least that similarity.

    Ids are distinct and not null. Null text is empty; texts without words are alike. Texts with the
    same shingles are one. An empty table gives no rows.
    """

    def keyed(batches):
        for batch in batches:
            digests, keys, sizes = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), words_per_shingle)
                digests.append(xxhash.xxh64_intdigest(found.tobytes(), SEED)), keys.append(bands(found)), sizes.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(np.array(keys, np.uint64).reshape(-1, BANDS).view(np.int64).tolist(), pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["id", "digest", "keys", "size"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(texts.mapInArrow(keyed, "id long, digest long, keys array<long>, size long"), "similar-rows")
    n = rows.count()
    # equal digests have equal keys; the row of the smallest id stands for them
    distinct = stage(rows.groupBy("digest").agg(F.min(F.struct("id", "keys", "size")).alias("f")).select("digest", "f.id", "f.keys", "f.size"), "similar-distinct", n)
    posted = distinct.select("id", "size", F.explode("keys").alias("key"))
    met = posted.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).where("n > 1")
    # of bands with the same members one is enough
    chosen = met.groupBy("n", "who").agg(F.min(F.struct("key", "all")).alias("f")).select("f.key", "f.all", "n")
    members = stage(posted.join(chosen, "key"), "similar-members", n * BANDS)
    is_light = (F.col("n") <= heavy) & (F.col("all") <= heavy_shingles)
    split = block_pairs(members.where(~is_light).select("key", "id", "size"), "key", "id", max(1, heavy // 2), "size", max(1, heavy_shingles // 2))
    members = members.where(is_light).select("key", "id").unionByName(split.select("key", "id"))

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), words_per_shingle).tobytes() for t in batch.column(1)], pa.binary())], ["id", "hashes"])

    sets = texts.join(members.select("id").distinct(), "id").select("id", "text").mapInArrow(hashed, "id long, hashes binary")

    def run(batches):
        key, ids, found = None, [], []

        def linked():
            links = similar_links(found, least) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in links], pa.int64()), pa.array([ids[b] for _, b in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for k, i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k != key:
                    yield linked()
                    key, ids, found = k, [], []
                ids.append(i), found.append(np.frombuffer(h.as_py(), np.uint64))
        yield linked()

    together = members.join(sets, "id").select("key", "id", "hashes").repartition("key").sortWithinPartitions("key")
    links = stage(together.mapInArrow(run, "a long, b long"), "similar-links")
    rooted = components(links, "similar-stars", links.count()).withColumnRenamed("node", "id")
    named = stage(distinct.join(rooted, "id", "left").select("digest", F.coalesce("root", "id").alias("component_id")), "similar-classes", n)
    return rows.join(named, "digest").select(F.col("id").alias(id_col), "component_id")
