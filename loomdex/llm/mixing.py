"""Mixing sources to token targets by entropy balancing.

Among all rates for the documents, take those nearest in entropy to one copy each whose
words meet every source's target. The dual is convex with one multiplier per source:
a document of x mean sizes gets the rate min(max_rate, exp(multiplier * x)). Safeguarded
Newton steps solve it; each step is one distributed sum over (source, size) counts, and
the multipliers stay in a table, so there may be any number of sources. Rates become whole
copies by a hash, and few documents of each size class then take one copy more or less
until the source's words are near its target.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import JAVA_WORD, stage, text_of

MAX_RATE = 3
#: Exponents beyond this give the same clipped rates.
MAX_EXPONENT = 60.0
MAX_STEPS = 60
#: Stands for a bracket that is open on one side.
OPEN = 1e300


def ranked(totals: DataFrame) -> DataFrame:
    """``totals`` with ``s``, the place of its source in code point order, null last, from 0; no task sees all sources."""
    ordered = totals.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    placed = stage(ordered.withColumn("place", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("place", 33)
    before, offsets = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row per partition
        offsets.append((r["part"], before))
        before += r["count"]
    starts = totals.sparkSession.createDataFrame(offsets, "part long, before long")
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("s", F.col("before") + F.col("place") - F.shiftleft("part", 33)).drop("part", "before", "place")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_rate: int = MAX_RATE) -> DataFrame:
    """``sources`` (s, words, ...) with ``target``: shares of all words by weight, none above ``max_rate`` times its words, the excess reshared.

    With L the words for each unit of weight, the sources that stop are those with max_rate * words
    under L * weight; L only grows as more of them stop, so a few sums find it.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    most = F.col("words") * float(max_rate)
    left, share, stopped, stops = 0.0, 1.0, -1, F.lit(False)
    while True:
        sums = sources.agg(
            F.count(F.when(stops, 1)).alias("stopped"),
            F.sum(F.when(~stops, weight)).alias("share"),
            (F.coalesce(F.sum("words"), F.lit(0)) - F.coalesce(F.sum(F.when(stops, most)), F.lit(0.0))).alias("left"),
        ).first()
        if sums["stopped"] == stopped or not sums["share"]:
            return sources.withColumn("target", F.when(stops, most).otherwise(F.lit(left) * weight / F.lit(share)))
        left, share, stopped = float(sums["left"]), float(sums["share"]), sums["stopped"]
        stops = most < F.lit(left) * weight / F.lit(share)


def rate_of(max_rate: int) -> Column:
    """The rate of a document of ``size`` words; no multiplier stands for the largest rate."""
    free = F.exp(F.least(F.lit(MAX_EXPONENT), F.col("m") * F.col("size") / F.col("mean")))
    return F.when(F.col("m").isNull(), F.lit(float(max_rate))).otherwise(F.least(F.lit(float(max_rate)), free))


def solve_dual(counts: DataFrame, sources: DataFrame, max_rate: int = MAX_RATE, tolerance: float = 1e-7) -> DataFrame:
    """(s, m): multipliers of ``sources`` (s, words, mean, target) with words, for ``counts`` (s, size, n).

    Newton's method, kept within a bracket; a step is a sum over the counts of the sources that are
    not settled. A source that takes the largest rate throughout has no multiplier.
    """
    full = F.col("target") >= F.col("words") * max_rate * (1 - 1e-12)
    number = lambda x: F.lit(float(x))
    state = sources.where("words > 0").select("s", "mean", "target", F.when(~full, number(0)).alias("m"), number(-OPEN).alias("low"), number(OPEN).alias("high"), full.alias("settled"))
    n = counts.count()  # a step handles as many rows at most
    state = stage(state, "mix-dual", n)
    for _ in range(MAX_STEPS):
        if not state.where("NOT settled").limit(1).count():
            break
        rate, words = rate_of(max_rate), F.col("n") * F.col("size")
        inside = F.when(rate < max_rate, rate).otherwise(0.0)
        sums = counts.join(state.where("NOT settled").drop("settled"), "s").groupBy("s", "mean", "target", "m", "low", "high").agg(F.sum(words * rate).alias("g"), F.sum(words * inside * F.col("size") / F.col("mean")).alias("h"))
        gap = F.col("g") - F.col("target")
        settled = F.abs(gap) <= tolerance * F.greatest(number(1), "target")
        bound = sums.select("s", "mean", "target", "m", gap.alias("gap"), "h", settled.alias("settled"), F.when(gap > 0, F.col("low")).otherwise(F.col("m")).alias("low"), F.when(gap > 0, F.col("m")).otherwise(F.col("high")).alias("high"))
        newton = F.col("m") - F.col("gap") / F.nullif(F.col("h"), number(0))
        near = (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("m")) <= 4)
        closed = (F.col("low") > -OPEN) & (F.col("high") < OPEN)
        step = F.when(near, newton).when(closed, (F.col("low") + F.col("high")) / 2).otherwise(F.col("m") + F.when(F.col("gap") > 0, number(-2)).otherwise(number(2)))
        moved = bound.select("s", "mean", "target", F.when(F.col("settled"), F.col("m")).otherwise(step).alias("m"), "low", "high", "settled")
        state = stage(state.where("settled").unionByName(moved), "mix-dual", n)
    return state.select("s", "m")


def balanced_copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_rate: int = MAX_RATE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", hash_col: str | None = None, seed: int = 42) -> DataFrame:
    """A row per row of ``docs``: id_col, source, size, source_size, target, rate, copies, taken.

    Size counts words (null text: 0). A null source is a source of its own, last in order. A source
    without words has target 0 and its documents the rate 1. Ids have any type; rows that repeat an
    id share its hash, but each has copies of its own, 0 to ``max_rate``. An empty table gives no
    rows. Other columns are ignored; the same input gives the same rows in any order and
    partitioning. ``hash_col`` gives the hash where the id is another one.
    """
    measured = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(hash_col or id_col), F.lit(seed)).alias("hash"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_of(text_col), F.lit(JAVA_WORD)).cast("long").alias("size"))
    rows = stage(measured.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    counts = stage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    n = counts.count()  # sources are fewer
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("n"))
    totals = totals.withColumn("mean", F.greatest(F.col("words") / F.col("n"), F.lit(1e-9))).drop("n")
    sources = stage(with_targets(ranked(totals), weights, max_rate).withColumnRenamed("source", "named"), "mix-targets", n)
    by_source = F.col("source").eqNullSafe(F.col("named"))
    numbered = stage(counts.where("size > 0").join(sources.select("named", "s"), by_source).select("s", "size", "n"), "mix-numbered", n)
    multipliers = solve_dual(numbered, sources, max_rate)
    # a source without words has no multiplier to solve for: 0, hence the rate 1
    solved = stage(sources.join(multipliers.withColumn("solved", F.lit(True)), "s", "left").withColumn("m", F.when(F.col("solved").isNull(), F.lit(0.0)).otherwise(F.col("m"))).drop("solved"), "mix-solved", n)

    chance = F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53))
    rated = rows.join(solved, by_source).select("row", "id", "source", "s", "size", F.col("words").alias("source_size"), "target", rate_of(max_rate).alias("rate"), chance.alias("u"))
    rounded = stage(rated.withColumn("copies", (F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("int")).cast("long")), "mix-rounded")
    final = rounded.join(adjustments(rounded, max_rate), "row", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return final.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def adjustments(rounded: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """(row, change): whole copies to add or remove so that each source's words come near its target.

    Candidates are two rows that can take a copy and two that can give one, of every source and
    power-of-two size class, so at most 4 * 64 rows of a source meet in a task. Rows that tie in hash,
    id, size and copies are alike, whichever of them changes.
    """
    grows, shrinks = F.col("copies") < max_rate, F.col("copies") > 0
    pick = F.struct("u", "id", "size", "copies", "row")
    wanted = [f(F.when(ok, pick)).alias(f"{n}{i}") for n, ok in (("add", grows), ("cut", shrinks)) for i, f in enumerate((F.min, F.max))]
    classes = rounded.where("size > 0").groupBy("s", F.floor(F.log2(F.col("size").cast("double"))).alias("c")).agg(*wanted)
    gaps = rounded.groupBy("s").agg((F.min("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    candidates = classes.select("s", F.explode(F.array(*[F.col(x) for x in ("add0", "add1", "cut0", "cut1")])).alias("x")).where("x IS NOT NULL").select("s", "x.row", "x.size", "x.copies", "x.u", F.col("x.id").cast("string").alias("id")).distinct()

    def settle(table: pa.Table) -> pa.Table:
        # in an order that doesn't depend on the rows' numbers
        found = sorted(table.select(["u", "id", "size", "copies", "row"]).to_pylist(), key=lambda r: (r["u"], r["id"] or "", r["size"], r["copies"], r["row"]))
        change = closest_changes({i: (r["size"], r["copies"]) for i, r in enumerate(found)}, table["gap"][0].as_py(), max_rate)
        return pa.table({"row": pa.array([found[i]["row"] for i in change], pa.int64()), "change": pa.array(list(change.values()), pa.int32())})

    return stage(candidates.join(gaps, "s").groupBy("s").applyInArrow(settle, "row long, change int"), "mix-changes")


def closest_changes(rows: dict[int, tuple[int, int]], gap: float, max_rate: int, rounds: int = 64) -> dict[int, int]:
    """Changes of copies by id (``rows``: id to size and copies) that bring ``gap`` near 0, one or two documents at a time."""
    change = dict.fromkeys(rows, 0)
    for _ in range(rounds):
        moves = sorted((sign * size, doc, sign) for doc, (size, copies) in rows.items() for sign in (1, -1) if 0 <= copies + change[doc] + sign <= max_rate)
        sizes = [m[0] for m in moves]
        best = (abs(gap), ())
        for words, doc, sign in [(0, None, 0), *moves]:
            at = bisect.bisect_left(sizes, gap - words)
            for other in moves[max(0, at - 2) : at + 2]:
                if other[1] != doc and abs(gap - words - other[0]) < best[0] - 1e-9:
                    best = (abs(gap - words - other[0]), ((doc, sign), other[1:]))
        if not best[1]:
            break
        for doc, sign in best[1]:
            if doc is not None:
                change[doc] += sign
                gap -= sign * rows[doc][0]
    return {doc: c for doc, c in change.items() if c}


def op5_entropy_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return balanced_copies(docs).select("doc_id", "size", "source_size", "target", "taken")
