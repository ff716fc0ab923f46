"""Sharding by a k-d tree over document metadata.

A node is split at the weighted median of its widest metadata dimension until the leaves
reach the target bytes, or their number. Medians come from distributed bisection: each pass
sums the weights of every open node over bins of the still possible key range and keeps the
bin in which the median lies. Nodes, bins and cuts are tables, so the driver holds nothing
but the fact that nodes are open. Leaves are shards. Documents with equal texts form one
point of the tree, so a shard never splits a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from .common import stage, text_of

#: Split keys: 24 bits of the coordinate over 38 bits of the group's hash, so that ties split too.
COORDINATE_BITS, TIE_BITS, BIN_BITS = 24, 38, 13
KEY_BITS = COORDINATE_BITS + TIE_BITS
UNIT = (1 << COORDINATE_BITS) - 1


def default_dimensions(numeric_ids: bool = True) -> dict[str, Column]:
    """Metadata coordinates: log of the size, source and language as stable positions, and the id's place."""
    position = lambda name: F.coalesce((F.crc32(F.col(name).cast("binary")) % 1000003).cast("double"), F.lit(-1.0))
    return {
        "size": F.log2(F.col("size").cast("double") + 1),
        "source": position("source"),
        "lang": position("lang"),
        "place": F.coalesce(F.col("doc_id").cast("double") if numeric_ids else F.crc32(F.col("doc_id").cast("string").cast("binary")).cast("double"), F.lit(-1.0)),
    }


def keyed_points(groups: DataFrame, dimensions: list[str]) -> DataFrame:
    """``groups`` with each dimension as a key of KEY_BITS bits: the coordinate's place in its range over the group's hash."""
    ranges = groups.agg(*[f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))])

    def key(d: str) -> Column:
        low, high = F.col(f"lo_{d}"), F.col(f"hi_{d}")
        coordinate = F.when(high > low, ((F.col(d) - low) / (high - low) * UNIT).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.shiftleft(coordinate, TIE_BITS).bitwiseOR(F.col("group").bitwiseAND((1 << TIE_BITS) - 1))

    return groups.crossJoin(F.broadcast(ranges)).select("group", "weight", *[key(d).alias(d) for d in dimensions])  # one row


def median_cuts(points: DataFrame, nodes: DataFrame, dimensions: list[str], count: int) -> DataFrame:
    """The ``count`` ``nodes`` (node, dim, leaves, w) with ``cut``: the key of ``dim`` up to which a point goes to the lower child.

    The cut leaves to the lower child as near to its part of the leaves as whole points allow. A node
    has at most 2**BIN_BITS bins in a pass.
    """
    which = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in dimensions])
    cuts = nodes.withColumns({"start": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "aim": F.col("w") * F.floor(F.col("leaves") / 2) / F.col("leaves")})
    bits = KEY_BITS
    while bits:
        step = min(BIN_BITS, bits)
        bits -= step
        past = points.join(cuts, "node").select("node", "dim", "leaves", "w", "start", "before", "aim", "weight", (which - F.col("start")).alias("past"))
        binned = past.where((F.col("past") >= 0) & (F.col("past") < F.lit(1 << (bits + step)))).groupBy("node", "dim", "leaves", "w", "start", "before", "aim", F.shiftrightunsigned("past", bits).alias("bin")).agg(F.sum("weight").alias("own"))
        upto = binned.withColumn("upto", F.col("before") + F.sum("own").over(Window.partitionBy("node").orderBy("bin")))
        at = F.struct("bin", "upto", "own")
        kept = upto.groupBy("node", "dim", "leaves", "w", "start", "before", "aim").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("aim"), at)), F.max(at)).alias("at"))
        under = F.col("at.upto") - F.col("at.own")
        # at the last step the bin is one key: it goes to the lower child if that lands nearer to the aim
        back = F.when((under > 0) & (F.col("aim") - under < F.col("at.upto") - F.col("aim")), 1).otherwise(0) if not bits else F.lit(0)
        cuts = stage(kept.select("node", "dim", "leaves", "w", (F.col("start") + F.shiftleft("at.bin", bits) - back).alias("start"), under.alias("before"), "aim"), "shard-cuts", count << BIN_BITS)
    return cuts.select("node", "dim", "leaves", F.col("start").alias("cut"))


def tree_leaves(groups: DataFrame, dimensions: list[str], n_leaves: int | None = None, target: int | None = None) -> DataFrame:
    """(group, leaf) for ``groups`` (group, weight, one double per dimension); leaves are numbered from 0.

    With ``n_leaves`` the tree has so many leaves (fewer only if there are fewer points), as even as
    whole points allow; with ``target`` nodes are split until they weigh that or are one point. A point
    heavier than its fair share gets a leaf of its own; at most n_leaves such points exist.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("weight")).first()[0] or 0
    if not total:
        return groups.select("group", F.lit(0).alias("leaf"))
    left, rest, alone = n_leaves or math.ceil(total / target), total, []
    heavy = groups.where(F.col("weight") * left >= total).select("group", "weight").collect()  # at most as many rows as leaves
    for group, weight in sorted(heavy, key=lambda x: (-x[1], x[0])):
        if left > 1 and weight * left >= rest:
            alone.append((group, len(alone)))
            left, rest = left - 1, rest - weight
    own = spark.createDataFrame(alone, "group long, own int")
    keyed = stage(keyed_points(groups, dimensions).join(F.broadcast(own), "group", "left"), "shard-points")
    points = keyed.where("own IS NULL").drop("own").withColumn("node", F.lit(1).cast("long"))
    nodes = spark.createDataFrame([(1, left)], "node long, leaves long")
    # a node's children are 2 * node and 2 * node + 1
    done = spark.createDataFrame([], "node long")
    which = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in dimensions])
    while True:
        wide = F.array_max(F.array(*[F.struct((F.max(d) - F.min(d)).alias("width"), F.lit(d).alias("dim")) for d in dimensions]))
        boxes = points.groupBy("node").agg(F.sum("weight").alias("w"), wide.alias("wide")).join(nodes, "node")
        leaves = F.col("leaves") if target is None else F.when(F.col("wide.width") > 0, F.ceil(F.col("w") / target)).otherwise(1)
        boxes = stage(boxes.select("node", "w", F.col("wide.dim").alias("dim"), leaves.cast("long").alias("leaves")), "shard-nodes")
        done = done.unionByName(boxes.where("leaves <= 1").select("node"))
        nodes = boxes.where("leaves > 1")
        count = nodes.count()
        if not count:
            break
        cuts = median_cuts(points, nodes, dimensions, count)
        child = F.when(F.col("cut").isNull(), F.col("node")).when(which <= F.col("cut"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
        placed = points.join(cuts.select("node", "dim", "cut"), "node", "left").withColumn("child", child)
        # leaves that are done keep their points, which later passes no longer read
        points = stage(placed.select("group", "weight", *dimensions, F.col("child").alias("node")), "shard-level")
        half = F.floor(F.col("leaves") / 2)
        nodes = cuts.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), half.alias("leaves")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("leaves") - half).alias("leaves")))).alias("x")).select("x.node", "x.leaves")
        nodes = nodes.unionByName(done.select("node", F.lit(1).cast("long").alias("leaves")))
        done = spark.createDataFrame([], "node long")
    # a row per leaf: in the order of the tree, then the points of their own
    depth = F.floor(F.log2(F.col("node").cast("double")))
    names = done.withColumn("leaf", F.row_number().over(Window.orderBy((F.col("node") / F.pow(F.lit(2.0), depth)), "node")) - 1)
    count = done.count()
    light = points.join(names, "node").select("group", "leaf")
    return light.unionByName(keyed.where("own IS NOT NULL").select("group", (F.col("own") + count).alias("leaf")))


def gapless_slots(rows: DataFrame, shard: str, order: list[Column], spread: Column, block_rows: int = 50_000, n_shards: int = 8) -> DataFrame:
    """Number the rows of each shard from 0 without gaps and without one task per shard.

    Each shard is cut into hashed blocks of about ``block_rows`` rows; a row's slot is the size of
    the earlier blocks plus its place in its own.
    """
    blocks = max(1, math.ceil(rows.count() / (block_rows * n_shards)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(spread), F.lit(blocks)))
    counts = dealt.groupBy(shard, "block").count()
    before = counts.select(shard, "block", (F.sum("count").over(Window.partitionBy(shard).orderBy("block")) - F.col("count")).alias("before"))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy(shard, "block").orderBy(*order)) - 1)
    return placed.join(before, [shard, "block"]).withColumn("slot", F.col("before") + F.col("place")).drop("block", "before", "place")


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 50_000) -> DataFrame:
    """``docs`` as (id_col, size, text_crc32, group, shard, slot), a row for each row.

    Size is the UTF-8 bytes of the text plus 1; a null text has none and is grouped with the empty
    text. Give the number of shards or the bytes of a shard. Ids have any type. Missing source and
    lang columns, nulls, repeated rows and ties are allowed (ties are split by the group's hash); an
    empty table gives no rows. Columns other than id, text, source and lang are ignored.
    """
    there = set(docs.columns)
    named = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *[(F.col(c).cast("string") if c in there else F.lit(None).cast("string")).alias(c) for c in ("source", "lang")])
    measured = named.select("doc_id", "source", "lang", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("group"))
    rows = stage(measured, "shard-rows")
    dims = default_dimensions(isinstance(rows.schema["doc_id"].dataType, NumericType))
    groups = rows.groupBy("group").agg(F.sum("size").alias("weight"), F.max("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("doc_id").alias("doc_id"))
    groups = stage(groups.select("group", "weight", *[c.alias(f"d_{n}") for n, c in dims.items()]), "shard-groups")
    leaves = tree_leaves(groups, [f"d_{n}" for n in dims], n_shards, target_bytes)
    sharded = stage(rows.join(leaves, "group").select("doc_id", "size", "text_crc32", "group", F.col("leaf").alias("shard")), "shard-leaves")
    order = [F.col("doc_id").asc_nulls_last(), F.col("group"), F.col("size")]
    shards = n_shards or max(1, sharded.select("shard").distinct().count())
    slots = gapless_slots(sharded, "shard", order, F.struct("doc_id", "group"), block_rows, shards)
    return slots.withColumnRenamed("doc_id", id_col)


def op8_kd_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return kd_shards(docs, n_shards=8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
