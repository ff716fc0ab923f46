"""SimHash near-duplicates by an inverted index over fingerprint bytes.

A fingerprint has eight bytes. Two fingerprints that differ in at most ``max_bits`` bits
share the byte at 8 - max_bits positions or more: the count filter. For the default of 4,
twenty triples of positions meet every set of four positions, so the postings are keyed by
the bytes at such a triple; a task tallies the shared positional bytes of the fingerprints
in a posting, keeps pairs with the guaranteed matches and verifies their distance.

Only links that join two so far separate parts of a posting leave its task, so that a
posting of m fingerprints yields fewer than m rows; components lose nothing by it. A posting
of more than HEAVY fingerprints is split by one byte position more, which the pairs must
share as well, and what is still as heavy into pairs of blocks, so that no task holds more.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, stage
from .components import components

SEED = 42
#: Fingerprints compared at a time within a posting: bounds a task's memory, not its rows.
BLOCK = 2048
#: Fingerprints of a posting that a task compares; heavier postings are split.
HEAVY = 4096
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """SimHash of the word shingles of a text: a bit is set if it is in over half of their hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), words_per_shingle
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(joined, SEED)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[: len(words) - k]]]
    # a shingle is a slice of the joined words
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """(doc_id, fp long): one fingerprint for each row."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind_of(rows, 'id')}, fp long")


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Few sets of byte positions, one of which lies in every set of 8 - max_bits positions.

    For 4 bits these are triples: of the two rings 0-1-2 and so on of the positions' three parts,
    each part as a whole and each pair of a part with a position of the next one; a part of four
    positions cannot avoid all of them. Else every set of 8 - max_bits positions is taken.
    """
    if max_bits == 4:
        parts = ((0, 1, 2), (3, 4, 5), (6, 7))
        triples = [p for p in parts if len(p) == 3]
        triples += [(*pair, other) for i, part in enumerate(parts) for pair in itertools.combinations(part, 2) for other in parts[(i + 1) % 3]]
        if all(any(set(t) <= set(four) for t in triples) for four in itertools.combinations(range(8), 4)):
            return triples
    return list(itertools.combinations(range(8), max(1, 8 - max_bits)))


def tallied_links(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the parts of a posting: pairs with enough shared positional bytes, verified."""
    values = np.unique(values)
    n, least = len(values), 8 - max_bits
    label, links, codes = np.arange(n), [], values.view(np.uint8).reshape(n, 8)
    for a in range(0, n, BLOCK):
        left = codes[a : a + BLOCK]
        for b in range(a, n, BLOCK):
            right = codes[b : b + BLOCK]
            shared = np.zeros((len(left), len(right)), np.uint8)
            for position in range(8):
                shared += left[:, position, None] == right[None, :, position]
            i, j = np.nonzero(shared >= least)
            apart = (i + a < j + b) & (label[i + a] != label[j + b])
            i, j = i[apart], j[apart]
            near = _POPCOUNT[left[i] ^ right[j]].sum(axis=1) <= max_bits
            label = joined(label, i[near] + a, j[near] + b, links)
    return [(int(values[x]), int(values[y])) for x, y in links]


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray, links: list[tuple[int, int]]) -> np.ndarray:
    """Labels after joining the parts of x[k] and y[k] for all k; appends the links that joined two parts."""
    while True:
        apart = label[x] != label[y]
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        over, under = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
        # every part takes one link to a part with a smaller label: no cycle can arise
        parts, first = np.unique(over, return_index=True)
        links += zip(x[first].tolist(), y[first].tolist(), strict=True)
        to = np.arange(len(label))
        to[parts] = under[first]
        while (to != to[to]).any():
            to = to[to]
        label = to[label]


def tallied(postings: DataFrame, max_bits: int, heavy: int | None) -> DataFrame:
    """Links (a, b) within each posting of ``postings`` (posting, fp, kind); b is null and posting and kind are given for
    each fingerprint a of a posting of more than ``heavy``, which is passed on instead.

    A task reads its postings in order and holds one at a time.
    """

    def run(batches):
        posting, value, kind = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        over = None

        def out(links, passed):
            a, b = ([x[i] for x in links] for i in (0, 1))
            n = len(passed[0])
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(a, pa.int64()), pa.array(passed[1], pa.int64())]), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(n, pa.int64())])]
                + [pa.concat_arrays([pa.nulls(len(a), t), pa.array(x, t)]) for x, t in ((passed[0], pa.int64()), (passed[2], pa.int32()))],
                ["a", "b", "posting", "kind"],
            )

        for batch in itertools.chain(batches_of(batches), [None]):
            if batch is not None:
                posting, value, kind = (np.concatenate([x, y]) for x, y in zip((posting, value, kind), batch, strict=True))
            if not len(posting):
                continue
            starts = np.flatnonzero(np.r_[True, posting[1:] != posting[:-1]])
            sizes = np.diff(np.r_[starts, len(posting)])
            links, passed = [], posting == over if over is not None else np.zeros(len(posting), bool)
            # the last posting may go on in the next batch
            ended = len(starts) if batch is None else len(starts) - 1
            for i in np.flatnonzero(sizes > 1).tolist():
                rows = slice(starts[i], starts[i] + sizes[i])
                if heavy is not None and sizes[i] > heavy:
                    passed[rows], over = True, posting[starts[i]]
                elif i < ended and not passed[starts[i]]:
                    links += tallied_links(value[rows], max_bits)
            yield out(links, (posting[passed], value[passed], kind[passed]))
            kept = np.arange(len(posting)) >= (starts[-1] if batch is not None else len(posting))
            kept &= ~passed
            posting, value, kind = posting[kept], value[kept], kind[kept]

    together = postings.repartition("posting").sortWithinPartitions("posting")
    return together.select("posting", "fp", "kind").mapInArrow(run, "a long, b long, posting long, kind int")


def batches_of(batches):
    for batch in batches:
        yield [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]


def links_of(distinct: DataFrame, max_bits: int, heavy: int = HEAVY) -> DataFrame:
    """(a, b) links between distinct fingerprints (fp), enough of them to connect all that link."""
    sets = position_sets(max_bits)

    def masked(positions) -> Column:
        mask = sum(0xFF << (8 * p) for p in positions)
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    keys = [F.struct(F.xxhash64(F.lit(number), masked(positions)).alias("posting"), F.lit(number).alias("kind")) for number, positions in enumerate(sets)]
    first = stage(tallied(distinct.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.posting", "fp", "x.kind"), max_bits, heavy), "simhash-links")
    found, left = [first.where("b IS NOT NULL").select("a", "b")], first.where("b IS NULL").select("posting", F.col("a").alias("fp"), "kind")
    if len(sets[0]) < 8 - max_bits and left.limit(1).count():
        # pairs share one position more
        more = F.coalesce(*[F.when(F.col("kind") == number, F.array(*[F.xxhash64("posting", F.lit(p), masked([p])) for p in range(8) if p not in positions])) for number, positions in enumerate(sets)])
        second = stage(tallied(left.select(F.explode(more).alias("posting"), "fp", "kind"), max_bits, heavy), "simhash-links")
        found.append(second.where("b IS NOT NULL").select("a", "b"))
        left = second.where("b IS NULL").select("posting", F.col("a").alias("fp"), "kind")
    if left.limit(1).count():
        found.append(tallied(block_pairs(left, "posting", "fp", max(1, heavy // 2)), max_bits, None).select("a", "b"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def block_pairs(members: DataFrame, key: str, value: str, block: int, weight: str | None = None, heaviest: int = 1) -> DataFrame:
    """``members`` of each ``key`` dealt into hashed blocks, once for every pair of blocks they are in; the key names the pair.

    A block has about ``block`` members, and if they have a ``weight``, members of about ``heaviest`` together.
    """
    count = F.count(F.lit(1)) / block
    sizes = members.groupBy(key).agg(F.ceil(count if weight is None else F.greatest(count, F.sum(weight) / heaviest)).alias("blocks"))
    dealt = members.join(sizes, key).withColumn("own", F.pmod(F.xxhash64(value, F.lit(3)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumn(key, F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).drop("blocks", "own", "other")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, max_bits: int = 4, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest id that its fingerprint reaches.

    Ids have any type that has an order. Null text is empty; texts without words have fingerprint zero and link like any other. Rows that
    repeat a text or an id share a class. A null id never names a component unless all its members'
    ids are null. An empty table gives no rows. Other columns are ignored.
    """
    rows = stage(fingerprints(docs, id_col, text_col, words_per_shingle), "simhash-rows")
    n = rows.count()
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct", n)
    # a posting has fewer links than fingerprints
    links = stage(links_of(distinct, max_bits, heavy), "simhash-links", n * len(position_sets(max_bits)))
    rooted = components(links, "simhash-stars", links.count())
    classes = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage(classes.join(smallest, "root").select("fp", "component_id"), "simhash-classes", n)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_components(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, words_per_shingle=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
