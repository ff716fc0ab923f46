"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

DataFrame functions only. Every word shingle is hashed once; the upper bits of the hash name
its bin, and a bin keeps its least hash. A bin that stays empty borrows from the first filled
bin of a probing order of its own: start[j], start[j] + step[j], and so on modulo the number
of bins, a full cycle as steps are odd, so that every order ends. Two texts then agree in a
bin as often as their shingles are alike, borrowed bins included. Of each bin the lowest
``bits`` bits are kept, packed into 64-bit words; unlike values share them once in 2^bits
cases, which ``likeness`` corrects.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import JAVA_SPACE, is_scan, stage, text_of

BINS, BITS, WORDS = 512, 4, 5
#: Probes of a bin that are tried one by one; bins still empty then compare the places of all filled bins in their order.
PROBES = 8
#: Ranges of the documents' order at most: the bound of what the driver and the broadcast hold of it.
MAX_RANGES = 65_536
ROWS_PER_RANGE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def probing(bins: int) -> tuple[list[int], list[int], list[int]]:
    """Start, step and the step's inverse modulo ``bins`` for each bin; a fixed rule, alike in every session."""
    draw = random.Random(bins)
    starts, steps = [draw.randrange(bins) for _ in range(bins)], [draw.randrange(bins) | 1 for _ in range(bins)]
    return starts, steps, [pow(s, -1, bins) for s in steps]


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> Column:
    """The packed fingerprint (array of longs) of a text that is not null.

    Words are what stands between ASCII white space, A-Z in lower case. A text of fewer than ``words``
    words is one shingle, that of no words included. ``bins`` is a power of two, ``bits`` 1, 2, 4, 8 or 16.
    """
    if bins & (bins - 1) or 64 % bits or not 0 < bits <= 16 or bins * bits % 64:
        raise ValueError("bins must be a power of two, bits a divisor of 64 up to 16, and both together whole words")
    shift = 64 - bins.bit_length()
    low, mask = (1 << shift) - 1, bins - 1
    starts, steps, inverses = (F.lit(v) for v in probing(bins))
    # one odd key at the end of each bin, so that every bin has a key; those of shingles are even
    ends = F.lit([((j + 1) << shift) - 1 for j in range(bins)]).cast("array<bigint>")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = F.transform(F.filter(F.split(lowered, JAVA_SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))

    def keys(h: Column) -> Column:
        shingle = lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(words)])
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.shiftrightunsigned(shingle(i), 1).bitwiseAND(F.lit(-2)))

    def least(ordered: Column) -> Column:
        begins = lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(ordered, i - 1), shift))
        return F.transform(F.filter(ordered, begins), lambda x: F.when(x.bitwiseAND(F.lit(1)) == 0, x))

    def densified(own: Column, filled: Column) -> Column:
        def borrowed(j: Column) -> list[Column]:
            tried = [F.get(own, (F.get(starts, j) + F.lit(a) * F.get(steps, j)).bitwiseAND(F.lit(mask))) for a in range(PROBES)]
            turn = lambda x: ((F.shiftright(x, shift).cast("int") - F.get(starts, j)) * F.get(inverses, j)).bitwiseAND(F.lit(mask))
            rest = F.array_min(F.transform(filled, lambda x: F.shiftleft(turn(x).cast("long"), shift).bitwiseOR(x.bitwiseAND(F.lit(low)))))
            return [*tried, rest]

        return F.transform(own, lambda x, j: F.coalesce(x, *borrowed(j)))

    def packed(full: Column) -> Column:
        per = 64 // bits
        kept = lambda a, x: F.shiftleft(a, bits).bitwiseOR(F.shiftright(x, 1).bitwiseAND(F.lit((1 << bits) - 1)))
        return F.transform(F.sequence(F.lit(0), F.lit(bins // per - 1)), lambda w: F.aggregate(F.slice(full, w * per + 1, F.lit(per)), F.lit(0).cast("long"), kept))

    return let(hashed, lambda h: let(F.sort_array(F.concat(keys(h), ends)), lambda s: let(least(s), lambda own: let(F.filter(own, lambda x: x.isNotNull()), lambda filled: let(densified(own, filled), packed)))))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The estimated Jaccard similarity of the shingles of two fingerprints: the share of equal bins without what chance makes equal."""

    def unlike(x: Column, y: Column) -> Column:
        bit, by = x.bitwiseXOR(y), bits // 2
        while by:
            bit, by = bit.bitwiseOR(F.shiftrightunsigned(bit, by)), by // 2
        return F.bit_count(bit.bitwiseAND(F.lit(sum(1 << i for i in range(0, 64, bits)) - (1 << 64 if bits == 1 else 0))))

    apart = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), (1 - apart / F.lit(float(bins)) - chance) / (1 - chance))


def printed(packed: Column) -> Column:
    """The fingerprint as text: 16 lowercase hex digits a word."""
    return F.array_join(F.transform(packed, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """``id_col`` and the packed fingerprint of every row; null texts count as empty, other columns are ignored. No shuffle."""
    return docs.select(id_col, fingerprint(text_of(text_col), bins, bits, words).alias("fingerprint"))


def with_next(rows: DataFrame, order: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``rows`` dealt out by ranges of the unique column ``order``, descending, with the columns range and guest added.

    The first row of each range stands in the range before it as well, as a guest, and the very first one
    in the last range: the next row of any row is then in its range, guests last. Rows are dealt once.
    """
    spark, keys = rows.sparkSession, rows.select(order)
    n = min(MAX_RANGES, max(1, -(-keys.count() // rows_per_range)))
    firsts = keys.repartitionByRange(n, F.desc(order)).groupBy(F.spark_partition_id().alias("part")).agg(F.max(order).alias("first"))
    bounds = firsts.agg(F.sort_array(F.collect_list("first"), asc=False).alias("bounds")).withColumn("ranges", F.size("bounds"))  # one row of MAX_RANGES bounds
    held = spark.createDataFrame(bounds.collect(), bounds.schema)
    halves = F.lit([1 << b for b in reversed(range(MAX_RANGES.bit_length()))])
    own = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("bounds", at + step) >= F.col(order), at + step).otherwise(at))
    placed = rows.crossJoin(F.broadcast(held)).withColumn("range", own)  # one row
    place = lambda r, guest: F.struct(r.cast("int").alias("range"), F.lit(guest).alias("guest"))
    before = place(F.pmod(F.col("range") - 1, F.col("ranges")), True)
    at = F.when(F.get("bounds", "range").eqNullSafe(F.col(order)), F.array(place(F.col("range"), False), before)).otherwise(F.array(place(F.col("range"), False)))
    return placed.select(*rows.columns, F.explode(at).alias("at")).select(*rows.columns, "at.range", "at.guest").repartition("range")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """Every text beside its edited text, whose last half is the start of the next document.

    Returns ``id_col``, n_chars, edited (text), fingerprint, edited_fingerprint (packed), near_edited and
    near_next. Documents follow each other by descending id, null ids last, rows of the same id by the
    names of their files, descending, and by their order in a file; the first one follows the last one. Null texts count as empty; an empty table
    gives no rows and one document follows itself. Other columns are ignored. Each text is shuffled once.
    """
    named = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # a row's place in its file makes the order unique; rows from elsewhere are written once
    named = named if is_scan(named) else stage(named, "prints-rows")
    place = named.metadataColumn("_metadata")
    keyed = named.select("text", F.struct("id", place["file_path"].alias("file"), (-place["row_index"]).alias("row")).alias("order"))
    printed_ = with_next(keyed, "order").withColumn("fingerprint", fingerprint(F.col("text"), bins, bits, words))
    follows = Window.partitionBy("range").orderBy("guest", F.desc("order"))  # ROWS_PER_RANGE rows, spilled by Spark where they are long
    beside = printed_.select("*", F.lead("text").over(follows).alias("next"), F.lead("fingerprint").over(follows).alias("next_fingerprint")).where("NOT guest")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next", F.lit(1), half))
    both = beside.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited"), bins, bits, words))
    near = lambda other: likeness(F.col("fingerprint"), F.col(other), bins, bits)
    return both.select(F.col("order.id").alias(id_col), F.char_length("text").cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def op13_fingerprints(spark, sf_dir):
    found = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("fingerprint")).alias("fingerprint"), printed(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
