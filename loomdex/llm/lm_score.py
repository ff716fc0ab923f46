"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and word pairs are gathered from the training texts, quantised on a
logarithmic scale, and an n-gram of level q enters the filter once for each level 1 to q.
A lookup probes level 1, 2, ... until one is missing; the last present level gives the
count. The filter has the same bits for each entry at every size. Workers get it by
broadcast as long as it fits in one; a larger filter stays in its segments, and the
distinct n-grams of some texts at a time travel to the segment of their key range and
their levels back, with the same scores. Beside the model's score a base score is computed
from exact word counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, kind_of, stage

#: Stands for the end of a text; no word has a space.
END = b" "
#: Bound of the broadcast filter; the segments of a larger one are probed where they are.
MAX_FILTER_BYTES = 128 << 20
BITS_PER_ENTRY, PROBES = 8.0, 4
#: Words whose exact counts are broadcast as (hash, count), 16 bytes each; the others' are joined.
HOT_WORDS = 150_000
#: Words and pairs of words that a task adds up before it passes them on; tokens scored at a time.
WORDS_AT_A_TIME, PAIRS_AT_A_TIME, CHUNK = 1 << 21, 1 << 20, 1 << 17
TOKENS_PER_PART = 1 << 21
#: Keys of a chunk that travel to a segment of the filter together, as far as chunks of MAX_CHUNK words allow.
KEYS_ASKED, MAX_CHUNK = 1 << 10, 1 << 20
#: Key ranges that an input task parts its counts into at most, and tokens of a range that a task cuts into the filter's parts.
RANGE_BITS, RANGE_TOKENS = 10, 1 << 26
#: Weight of the word's own probability against that given the word before.
KAPPA = 4.0
_A, _B, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_keys(h: np.ndarray) -> np.ndarray:
    return mix(h + _GOLD)


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * _GOLD + mix(h))


START = np.uint64(xxhash.xxh64_intdigest(b"\n"))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and one more for each doubling."""
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


#: The count that a level stands for: the middle of its range on the logarithmic scale; 1 and 0 are exact.
LEVEL_COUNTS = np.array([0.0, 1.0, *[2.0 ** (q - 1) * math.sqrt(1.5 if q == 2 else 2.0) for q in range(2, 64)]])


class Filter:
    """Segments by the leading bits of the key, each a Bloom filter of (key, level) entries."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, part_bits: int):
        """``bits``: the segments' bytes in turn; ``sizes``: the bytes of each."""
        self.part_bits, self.bytes = part_bits, bits if len(bits) else np.zeros(1, np.uint8)
        self.sizes = sizes.astype(np.uint64) * np.uint64(8)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]].astype(np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by probing one after the other; never below the stored level."""
        level = np.zeros(len(keys), np.uint8)
        part = part_of(keys, self.part_bits)
        sizes, starts = self.sizes[part], self.starts[part]
        alive = np.flatnonzero(sizes)
        for q in range(1, len(LEVEL_COUNTS)):
            for probe in range(PROBES):
                at = position(keys[alive], q, probe, sizes[alive]) + starts[alive]
                bit = self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
                alive = alive[(bit & 1).astype(bool)]
            if not len(alive):
                break
            level[alive] = q
        return level

    def count(self, keys: np.ndarray) -> np.ndarray:
        return LEVEL_COUNTS[self.levels(keys)]


def part_of(keys: np.ndarray, part_bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - part_bits)).astype(np.int64)


def position(keys: np.ndarray, level: int, probe: int, sizes: np.ndarray | np.uint64) -> np.ndarray:
    return mix(keys + np.uint64(int(_GOLD) * (level * PROBES + probe + 1) & 0xFFFFFFFFFFFFFFFF)) % sizes


def segment(keys: np.ndarray, levels: np.ndarray, bits_per_entry: float) -> bytes:
    entries = int(levels.sum())
    bits = np.zeros(8 * max(1, math.ceil(entries * bits_per_entry / 8)), np.uint8)
    for q in range(1, int(levels.max(initial=0)) + 1):
        at = keys[levels >= q]
        for probe in range(PROBES):
            bits[position(at, q, probe, np.uint64(len(bits)))] = 1
    return np.packbits(bits, bitorder="little").tobytes() if entries else b""


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z in lower case, then the end."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    found.append(END)
    return found


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def runs_of(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, first, end) of the parts that occur, in rising order."""
    first = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else np.zeros(0, np.int64)
    return list(zip(parts[first].tolist(), first.tolist(), [*first[1:].tolist(), len(parts)][: len(first)], strict=True))


def blobs(keys: np.ndarray, counts: np.ndarray, part_bits: int):
    """One (part, keys, counts) row for each part that occurs, from summed keys."""
    small = lambda c: c.astype(np.uint8 if c.max() <= 255 else np.int64).tobytes()
    rows = [(p, keys[a:b].tobytes(), small(counts[a:b])) for p, a, b in runs_of(part_of(keys, part_bits))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "keys", "counts"])


BLOB = "part int, keys binary, counts binary"


def _read(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, np.uint64)
    return k, np.frombuffer(counts, np.uint8 if len(counts) == len(k) else np.int64).astype(np.int64)


def coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, words, sizes): the tokens of the texts in turn as places among their distinct words, the last of which is the end, and the tokens of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    doc = pc.list_parent_indices(split).to_numpy().astype(np.int64)
    found = split.flatten().dictionary_encode()
    code, words = found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.binary())
    empty = pc.index(words, b"").as_py()  # before and after white space at a text's ends
    if empty >= 0:
        kept = code != empty
        doc, code = doc[kept], code[kept] - (code[kept] > empty)
        words = words.filter(pa.array(np.arange(len(words)) != empty))
    sizes = np.bincount(doc, minlength=len(texts)) + 1
    codes = np.full(len(code) + len(texts), len(words))
    codes[np.arange(len(code)) + doc] = code
    return codes, pa.concat_arrays([words, pa.array([END], pa.binary())]), sizes


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over a frame of one text column; some texts' words are added up at a time."""

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch.column(0), WORDS_AT_A_TIME):
                codes, words, _ = coded(batch.column(0)[a:b])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)))], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hashes_of(tokens: list[bytes] | np.ndarray) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def hashes_of_array(tokens: pa.Array) -> np.ndarray:
    return hashes_of(tokens.to_numpy(zero_copy_only=False))  # much faster than to_pylist


def pair_blobs(texts: DataFrame, part_bits: int) -> DataFrame:
    """Counts of word pairs (the start of a text counts as a word before) as blobs by key range."""

    def run(batches):
        keys, size = [], 0

        def out():
            found = np.concatenate(keys)
            keys.clear()
            return blobs(*tallied(found), part_bits)

        for batch in batches:
            for a, b in chunks(batch.column(0)):
                keys.append(Chunk(batch.column(0)[a:b]).pairs)
                size += len(keys[-1])
                if size > PAIRS_AT_A_TIME:
                    yield out()
                    size = 0
        if keys:
            yield out()

    return texts.mapInArrow(run, BLOB)


def word_blobs(words: DataFrame, part_bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield blobs(*summed(word_keys(hashes_of_array(batch.column(0))), batch.column(1).to_numpy()), part_bits)

    return words.select("word", "n").mapInArrow(run, BLOB)


def refined(ranges: DataFrame, part_bits: int, tasks: int) -> DataFrame:
    """Blobs of RANGE_BITS parts as blobs of ``part_bits`` parts, each with the keys of many: a task has some blobs of a range, and adds them up a million keys at a time."""

    def run(batches):
        held, size, now = [], 0, None

        def out():
            table = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return blobs(*summed(*table), part_bits)

        for batch in batches:
            for part, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if held and (part != now or size > PAIRS_AT_A_TIME):
                    yield out()
                    size = 0
                now = part
                held.append(_read(k.as_py(), c.as_py()))
                size += len(held[-1][0])
        if held:
            yield out()

    spread = F.pmod(F.xxhash64("keys"), F.lit(tasks))
    return ranges.repartition("part", spread).sortWithinPartitions("part").mapInArrow(run, BLOB)


def build_segments(texts: DataFrame, words: DataFrame, part_bits: int, range_bits: int = RANGE_BITS, range_tokens: int = RANGE_TOKENS, n: int = 0) -> DataFrame:
    """(part, bits): the filter's segments, a row for each key range that has n-grams, written in the shared folder.

    Input tasks pass on at most 2^range_bits blobs at a time. Where the filter has more parts than these, the
    blobs of a range meet in tasks of about ``range_tokens`` tokens and are cut into parts there.
    """

    def merge(table: pa.Table) -> pa.Table:
        read = [_read(k.as_py(), c.as_py()) for k, c in zip(table.column("keys"), table.column("counts"), strict=True)]
        keys, counts = summed(np.concatenate([k for k, _ in read]), np.concatenate([c for _, c in read]))
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([segment(keys, levels_of(counts), BITS_PER_ENTRY)], pa.binary())})

    first = min(part_bits, range_bits)
    blobbed = pair_blobs(texts, first).unionByName(word_blobs(words, first))
    if first < part_bits:
        blobbed = refined(blobbed, part_bits, max(1, math.ceil(n / range_tokens) >> first))
    return stage(blobbed.groupBy("part").applyInArrow(merge, "part int, bits binary"), "lm-segments")


def gathered(segments: DataFrame, sizes: np.ndarray, part_bits: int) -> Filter:
    """The whole filter on the driver, from one partition of the segments at a time."""
    ends = np.cumsum(sizes)
    bits = np.empty(int(sizes.sum()), np.uint8)
    for r in segments.toLocalIterator(prefetchPartitions=True):
        end = int(ends[r["part"]])
        bits[end - int(sizes[r["part"]]) : end] = np.frombuffer(r["bits"], np.uint8)
    return Filter(bits, sizes, part_bits)


def log_probabilities(seen: np.ndarray, pair: np.ndarray, first: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 probabilities of tokens, from the counts of their words, of their pairs and of the words before.

    ``first`` are the texts' first tokens. Before them stands the end of another text: the last
    token's count, for every text ends with it.
    """
    context = np.r_[seen[-1:], seen[:-1]]
    context[first] = seen[-1] if len(seen) else 0
    own = (seen + 1) / (n + v + 1)
    trust = context / (context + KAPPA)
    return np.log10(np.minimum(trust * np.minimum(pair, context) / np.maximum(context, 1) + (1 - trust) * own, 1.0))


class Chunk:
    """The tokens of some texts: hashes, distinct words, and the keys of words and pairs."""

    def __init__(self, texts: pa.Array):
        codes, self.names, self.sizes = coded(texts)
        self.first = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        each = hashes_of_array(self.names)  # a word is hashed once
        self.words, self.where, number = np.unique(each, return_index=True, return_inverse=True)
        self.word = number[codes]
        before = np.r_[START, each[codes[:-1]]]
        before[self.first] = START
        self.pairs = pair_keys(before, each[codes])

    def base(self, hot: np.ndarray, counts: np.ndarray):
        """Sum of log10(c + 1) and number of the tokens that are hot words, and (text, word, times) of the others."""
        at = np.minimum(np.searchsorted(hot, self.words), max(len(hot) - 1, 0))
        known = hot[at] == self.words if len(hot) else np.zeros(len(self.words), bool)
        logs = np.where(known, np.log10(counts[at] + 1.0), 0.0) if len(hot) else np.zeros(len(self.words))
        known, n = known[self.word], len(self.sizes)
        code, times = np.unique(self.doc[~known] * len(self.words) + self.word[~known], return_counts=True)
        names = self.names.take(pa.array(self.where[code % max(len(self.words), 1)]))
        return np.bincount(self.doc, logs[self.word], n), np.bincount(self.doc[known], minlength=n), code // max(len(self.words), 1), names, times


def chunks(texts: pa.Array, words: int = CHUNK):
    """(first, end) of runs of texts of about four bytes for each of so many words."""
    size, first = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        size += n
        if size >= words * 4:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


BASE = ["row", "id", "n_tokens", "hot_log", "hot_known", "words", "times"]
BASE_TYPES = "row long, id {}, n_tokens long, hot_log double, hot_known long, words array<binary>, times array<long>"


def base_columns(batch: pa.RecordBatch, a: int, b: int, chunk: Chunk, hot: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    base, known, doc, names, times = chunk.base(*hot)
    offsets = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
    words, times = (pa.ListArray.from_arrays(offsets, x) for x in (names, pa.array(times, pa.int64())))
    return [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(chunk.sizes, pa.int64()), pa.array(base.astype(float)), pa.array(known, pa.int64()), words, times]


def scored_by_broadcast(rows: DataFrame, model: Filter, hot: tuple[np.ndarray, np.ndarray], n: int, v: int) -> DataFrame:
    """BASE and score for each of ``rows`` (row, id, text)."""
    shared = rows.sparkSession.sparkContext.broadcast((model, hot))  # max_filter_bytes and hot_words

    def run(batches):
        for batch in batches:
            model, hot = shared.value
            for a, b in chunks(batch.column(2)):
                chunk = Chunk(batch.column(2)[a:b])
                seen = model.count(word_keys(chunk.words))[chunk.word]
                score = np.bincount(chunk.doc, log_probabilities(seen, model.count(chunk.pairs), chunk.first, n, v), b - a)
                yield pa.RecordBatch.from_arrays([*base_columns(batch, a, b, chunk, hot), pa.array(score)], [*BASE, "score"])

    return stage(rows.mapInArrow(run, BASE_TYPES.format(kind_of(rows, "id")) + ", score double"), "lm-scored")


def scored_by_segment(rows: DataFrame, segments: DataFrame, part_bits: int, hot: tuple[np.ndarray, np.ndarray], n: int, v: int) -> DataFrame:
    """What ``scored_by_broadcast`` gives, for a filter of any size.

    Texts are tokenised once. The distinct keys of some texts at a time go to their segment, which a
    task holds one after the other, and the levels found go back to those texts' tokens. Chunks grow with the
    number of segments, so that the rows that travel grow with the tokens, and a segment is probed for many chunks at once.
    """
    size_of_chunk = min(MAX_CHUNK, max(CHUNK, KEYS_ASKED << part_bits))
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def tokenise(batches):
        for batch in batches:
            for a, b in chunks(batch.column(2), size_of_chunk):
                chunk = Chunk(batch.column(2)[a:b])
                keys, back = np.unique(np.r_[word_keys(chunk.words), chunk.pairs], return_inverse=True)
                size = len(chunk.words)
                places = np.c_[back[:size][chunk.word], back[size:]].astype(np.int32).tobytes()
                number = batch.column(0)[a].as_py()
                base = base_columns(batch, a, b, chunk, shared.value)
                yield pa.RecordBatch.from_arrays([*base, pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], [*BASE, "chunk", "part", "data"])
                parts = [(p, keys[i:j].tobytes()) for p, i, j in runs_of(part_of(keys, part_bits))]
                # the tokens' places among the keys and the texts' sizes come before all parts
                parts += [(-1, places), (-2, np.array(batch.column(0)[a:b].to_pylist(), np.int64).tobytes() + chunk.sizes.astype(np.int64).tobytes())]
                none = [pa.nulls(len(parts), x.type) for x in base]
                yield pa.RecordBatch.from_arrays([*none, pa.array([number] * len(parts), pa.int64()), pa.array([p for p, _ in parts], pa.int32()), pa.array([d for _, d in parts], pa.binary())], [*BASE, "chunk", "part", "data"])

    tokenised = stage(rows.mapInArrow(tokenise, BASE_TYPES.format(kind_of(rows, "id")) + ", chunk long, part int, data binary"), "lm-tokens")
    asked = tokenised.where("part >= 0").select("part", F.lit(1).alias("asked"), "chunk", "data")
    there = segments.select("part", F.lit(0).alias("asked"), F.lit(0).cast("long").alias("chunk"), F.col("bits").alias("data"))

    def probe(batches):
        model, held, waiting, size = None, -1, [], 0

        def out():
            chunk, part, data = zip(*waiting, strict=True)
            keys = np.frombuffer(b"".join(data), np.uint64)
            level = model.levels(keys).tobytes() if held == part[0] else bytes(len(keys))
            ends = np.cumsum([len(d) // 8 for d in data]).tolist()
            found = [level[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(part, pa.int32()), pa.array(found, pa.binary())], ["chunk", "part", "data"])

        for batch in batches:
            for p, is_asked, c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if waiting and (not is_asked or p != waiting[0][1] or size > PAIRS_AT_A_TIME):
                    yield out()
                    size = 0
                if is_asked:
                    waiting.append((c, p, data.as_py()))
                    size += len(waiting[-1][2]) // 8
                else:
                    bits = data.as_py()
                    model, held = Filter(np.frombuffer(bits, np.uint8), np.array([len(bits)]), 0), p
        if waiting:
            yield out()

    together = there.unionByName(asked).repartition("part").sortWithinPartitions("part", "asked")
    levels = stage(together.mapInArrow(probe, "chunk long, part int, data binary"), "lm-levels")

    def finish(batches):
        number, parts = None, []

        def out():
            ids, sizes = np.frombuffer(parts[0], np.int64).reshape(2, -1)
            places = np.frombuffer(parts[1], np.int32).reshape(-1, 2)
            counts = LEVEL_COUNTS[np.frombuffer(b"".join(parts[2:]), np.uint8)]
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            logs = log_probabilities(counts[places[:, 0]], counts[places[:, 1]], first, n, v)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, len(sizes)))], ["row", "score"])

        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c != number and parts:
                    yield out()
                    parts = []
                number = c
                parts.append(data)
        if parts:
            yield out()

    back = levels.unionByName(tokenised.where("part < 0").select("chunk", "part", "data")).repartition("chunk").sortWithinPartitions("chunk", "part")
    scores = back.mapInArrow(finish, "row long, score double")
    return stage(tokenised.where("chunk IS NULL").select(*BASE).join(scores, "row"), "lm-scored")


def hot_counts(words: DataFrame, hot_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the commonest words, at most ``hot_words``."""
    # the smallest count whose words, and those above it, are at most hot_words
    counts = words.groupBy("n").count().orderBy(F.desc("n")).limit(hot_words + 1).toArrow()
    above = np.cumsum(counts["count"].to_numpy())
    fit = int(np.searchsorted(above, hot_words, side="right"))
    if not fit:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes_of_array(batch.column(0)).view(np.int64)), batch.column(1)], ["h", "n"])

    found = words.where(F.col("n") >= int(counts["n"][fit - 1].as_py())).select("word", "n").mapInArrow(run, "h long, n long").toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def score_texts(docs: DataFrame, trained: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``; ``trained`` gives the counts.

    Null text is empty: its only token is the end. Ids have any type; repeated rows are scored one by
    one, null ids are kept, other columns are ignored, an empty ``docs`` gives no rows; with an empty
    ``trained`` every word is unknown (N = V = 0). Scores don't depend on ``hot_words`` or
    ``max_filter_bytes``, which only bound what is broadcast.
    """
    texts = trained.select(F.col(text_col).cast("string").alias("text"))
    words = stage(word_counts(texts), "lm-words")
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    part_bits = max(4, math.ceil(math.log2(max(1, n / TOKENS_PER_PART))) + 1)
    segments = build_segments(texts, words, part_bits, n=n)
    each = segments.select("part", F.octet_length("bits").cast("long").alias("size"))
    whole = each.agg(F.sum("size")).first()[0] or 0
    hot = hot_counts(words, hot_words)
    asked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if whole <= max_filter_bytes:
        lengths = each.toArrow()  # a row per 2**20 tokens, of at most max_filter_bytes
        sizes = np.zeros(1 << part_bits, np.int64)
        sizes[lengths["part"].to_numpy()] = lengths["size"].to_numpy()
        rows = scored_by_broadcast(asked, gathered(segments, sizes, part_bits), hot, n, v)
    else:
        # numbered once: a row that is read again must keep its number
        rows = scored_by_segment(stage(asked, "lm-rows"), segments, part_bits, hot, n, v)
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    counted = rare.join(words, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_log"), F.sum("times").alias("rare_known"))
    log_all = F.log10(F.lit(float(n)) + F.lit(float(v)) + 1.0)
    return rows.drop("words", "times").join(counted, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * log_all).alias("base_score"),
        "score",
    )


def op2_lm_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 7)
    found = score_texts(docs, docs.where(~out))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
