"""Merkle manifest of a dataset: a tree over the rows of each group, one over the groups, and proofs by coordinates.

A node's coordinates are its group, level and index. Rows are numbered within their group by
ranges of the order, so that no task holds a group, and trees grow in passes: nodes meet in
blocks of 2^SPAN neighbours, and a block makes its nodes of the next SPAN levels. All nodes
are one table. A proof needs no tree: the siblings' coordinates follow from a row's index and
its group's size, they are exploded, looked up in the node table, ordered and concatenated.

The upper nodes of a group would be asked for by all its rows, so proofs are made in tiers:
a row asks for the siblings within its block of 2^SPAN rows, a block for those within its
block of blocks, and so on; no node is asked for more than 2^SPAN times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kind_of, stage, table

#: Levels that a pass makes and a tier of proofs spans.
SPAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the level above: the groups' roots are the rows of one group.
ALL = "all"


def encoded(column: Column) -> Column:
    """A value by its length in bytes, a colon and itself; a null is ``-``."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with index, their place from 0 in the group in ascending order, and m, the group's rows; written once.

    Tasks hold ranges of group and order; what is counted is a row for each group that a task has.
    """
    keys = [F.col(group), *[F.col(c) for c in order]]
    held = stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "merkle-rows")
    parts = held.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(group)
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(own).alias("m"))
    return held.join(offsets, [group, "part"]).withColumn("index", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def height(m: Column) -> Column:
    """Levels above the rows of a group of m."""
    return F.ceil(F.log2(m.cast("double"))).cast("int")


def paired(nodes: Column) -> Column:
    """The level above: each two consecutive digests, or the last one alone, hashed together."""
    two = lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1)), two)


def node_table(rows: DataFrame, group: str, digest: str) -> tuple[DataFrame, int]:
    """All nodes (group, m, level, index, node) over ``rows`` (group, index, m, digest), and the height of the highest tree; a pass of SPAN levels is written once."""
    level = rows.select(group, "m", F.lit(0).alias("level"), "index", F.col(digest).alias("node"))
    out, top = level, rows.agg(F.max(height(F.col("m"))).alias("top")).first()["top"] or 0
    for base in range(0, top, SPAN):
        going = level.where(height(F.col("m")) > base)
        blocks = going.groupBy(group, "m", F.shiftright("index", SPAN).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "node"))), lambda x: x["node"]).alias("nodes"))
        steps = F.sequence(F.lit(1), F.least(F.lit(SPAN), height(F.col("m")) - base))
        grown = F.aggregate(steps, F.array("nodes"), lambda a, _: F.concat(a, F.array(paired(F.element_at(a, -1)))))
        each = blocks.select(group, "m", "block", F.posexplode(grown).alias("up", "nodes")).where("up > 0").select(group, "m", "block", "up", F.posexplode("nodes").alias("i", "node"))
        index = F.expr(f"shiftleft(block, {SPAN} - up)") + F.col("i")
        made = stage(each.select(group, "m", (F.col("up") + base).alias("level"), index.alias("index"), "node"), "merkle-nodes")
        out, level = out.unionByName(made), made.where(F.col("level") == base + SPAN)
    return out, top


def proofs(nodes: DataFrame, group: str, top: int) -> DataFrame:
    """(group, index, proof) for every row: its siblings' digests from the lowest level to the group's root.

    Where a node is alone in its pair the proof has none. Rows of a group of one row are not in the result.
    """
    out = None
    for base in reversed(range(0, top, SPAN)):
        asked = nodes.where((F.col("level") == base) & (height(F.col("m")) > base)).select(group, "m", "index")
        ups = F.explode(F.sequence(F.lit(0), F.least(F.lit(SPAN), height(F.col("m")) - base) - 1)).alias("up")
        sibling = F.expr("shiftright(index, up) ^ 1")
        width = F.ceil(F.col("m") / F.expr(f"shiftleft(1L, {base} + up)"))
        wanted = asked.select(group, "m", "index", ups).select(group, "m", F.col("index").alias("of"), (F.col("up") + base).alias("level"), sibling.alias("index"), width.alias("width")).where("index < width")
        found = wanted.drop("width", "m").join(nodes.select(group, "level", "index", "node"), [group, "level", "index"])
        part = found.groupBy(group, F.col("of").alias("index")).agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "node"))), lambda x: x["node"]).alias("proof"))
        if out is not None:
            # a block's last row can be without siblings of its own, so all rows of the tier are kept
            above = out.select(group, F.col("index").alias("block"), F.col("proof").alias("more"))
            own = asked.select(group, "index").join(part, [group, "index"], "left").withColumn("block", F.shiftright("index", SPAN))
            none = F.array().cast("array<string>")
            part = own.join(above, [group, "block"], "left").select(group, "index", F.concat(F.coalesce("proof", none), F.coalesce("more", none)).alias("proof"))
        out = stage(part, "merkle-proofs") if base else part
    return nodes.select(group, "index").limit(0).withColumn("proof", F.array().cast("array<string>")) if out is None else out


def folded(node: Column, index: Column, m: Column, proof: Column) -> Column:
    """The root that a row's digest and proof give: at each level the node joins its sibling on the side that the index tells, or is hashed alone."""
    begin = F.struct(node.alias("node"), F.lit(0).alias("used"))

    def up(a: Column, level: Column) -> Column:
        at = F.call_function("shiftright", index, level)
        right = at % 2 == 1
        alone = ~right & (at + 1 >= F.ceil(m / F.call_function("shiftleft", F.lit(1).cast("long"), level)))
        sibling = F.get(proof, a["used"])
        joined = F.when(alone, a["node"]).when(right, F.concat(sibling, a["node"])).otherwise(F.concat(a["node"], sibling))
        return F.struct(F.sha2(joined, 256).alias("node"), (a["used"] + F.when(alone, 0).otherwise(1)).alias("used"))

    levels = F.when(height(m) > 0, F.sequence(F.lit(0), height(m) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, begin, up, lambda a: a["node"])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, leaf, group, index, size, subroot, group_index, groups, root, proof, given_leaf, folded_root, verified.

    A leaf is the hash of ``fields``. Within a group leaves ascend by id, null ids first and rows of the
    same id by leaf; groups ascend by their text's bytes, null first, and a null differs from any text. ``proof`` has the siblings up to
    the root of all groups. ``changed`` gives other values of some fields: given_leaf is made of them, and
    folded_root of given_leaf and the proof; it equals the root, and verified is true, only if nothing
    differs. An empty table gives no rows; other columns are ignored. Texts are not shuffled.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    given = [(changed or {}).get(c, F.col(c)) for c in fields]
    rows = placed(docs.select(F.col(id_col).alias("id"), group.alias("group"), leaf([F.col(c) for c in fields]).alias("leaf"), leaf(given).alias("given_leaf")), "group", ["id", "leaf"])
    nodes, top = node_table(rows, "group", "leaf")
    subroots = nodes.where(F.col("level") == height(F.col("m"))).select(F.lit(ALL).alias("all"), "group", F.col("node").alias("subroot"), F.col("m").alias("size"))
    groups = placed(subroots, "all", ["group"])
    upper, height_of_all = node_table(groups, "all", "subroot")
    root = upper.where(F.col("level") == height(F.col("m"))).select("all", F.col("node").alias("root"))  # one row
    none = F.array().cast("array<string>")
    named = groups.join(proofs(upper, "all", height_of_all), ["all", "index"], "left").join(F.broadcast(root), "all")
    named = stage(named.select("group", "subroot", "root", F.col("index").alias("group_index"), F.col("m").alias("groups"), F.coalesce("proof", none).alias("upper_proof")), "merkle-groups")
    proven = rows.join(proofs(nodes, "group", top), ["group", "index"], "left").join(named, "group").withColumn("own_proof", F.coalesce("proof", none))
    subroot = folded(F.col("given_leaf"), F.col("index"), F.col("m"), F.col("own_proof"))
    out = proven.withColumn("folded_subroot", subroot).withColumn("folded_root", folded(F.col("folded_subroot"), F.col("group_index"), F.col("groups"), F.col("upper_proof")))
    return out.select(F.col("id").alias(id_col), "leaf", F.when(F.col("group") != "", F.substr("group", F.lit(2))).alias("group"), "index", F.col("m").alias("size"), "subroot", "group_index", "groups", "root", F.concat("own_proof", "upper_proof").alias("proof"), "given_leaf", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = manifest(docs, changed={"n_chars": n_chars})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


OP11_SQL = r"""
WITH RECURSIVE e AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS g, n_chars, text, source FROM documents),
x AS (SELECT doc_id, g, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
  n_chars, coalesce(strlen(text) || ':' || text, '-') AS after,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
    lambda c, y: list_reduce(list_prepend(xor(c, y), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS c FROM e),
l AS (SELECT doc_id, g, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || after) AS leaf,
  sha256(before || coalesce(strlen((n_chars + coalesce(xor(c, 4294967295) % 7 = 0, false)::INTEGER)::VARCHAR) || ':' || (n_chars + coalesce(xor(c, 4294967295) % 7 = 0, false)::INTEGER), '-') || after) AS given FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM l),
n AS (SELECT g, m, m AS w, 0 AS level, i, leaf AS h FROM r
  UNION ALL SELECT g, m, (w + 1) // 2, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM n WHERE w > 1 GROUP BY g, m, w, level, i // 2),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM n WHERE w = 1),
u AS (SELECT m, m AS w, 0 AS level, i, subroot AS h FROM s
  UNION ALL SELECT m, (w + 1) // 2, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE w > 1 GROUP BY m, w, level, i // 2),
f AS (SELECT doc_id, g, leaf, 0 AS level, i, m AS w, given AS h, '' AS proof FROM r
  UNION ALL SELECT doc_id, f.g, leaf, f.level + 1, f.i // 2, (f.w + 1) // 2, sha256(CASE WHEN f.i % 2 = 1 THEN n.h || f.h ELSE f.h || coalesce(n.h, '') END), proof || coalesce(n.h, '')
  FROM f LEFT JOIN n ON n.g = f.g AND n.level = f.level AND n.i = xor(f.i, 1) WHERE f.w > 1),
v AS (SELECT doc_id, leaf, s.subroot, 0 AS level, s.i, s.m AS w, f.h, f.proof, f.g FROM f JOIN s ON s.g = f.g WHERE f.w = 1
  UNION ALL SELECT doc_id, leaf, subroot, v.level + 1, v.i // 2, (v.w + 1) // 2, sha256(CASE WHEN v.i % 2 = 1 THEN u.h || v.h ELSE v.h || coalesce(u.h, '') END), proof || coalesce(u.h, ''), v.g
  FROM v LEFT JOIN u ON u.level = v.level AND u.i = xor(v.i, 1) WHERE v.w > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE w = 1) AS root, sha256(proof) AS proof_sha256, v.h AS folded_root, v.h = (SELECT h FROM u WHERE w = 1) AS verified
FROM v WHERE w = 1
"""
