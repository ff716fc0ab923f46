"""Budgeted packing: greedy rules as running folds over each plan's rows in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string
from pyspark.sql.window import Window

from .shared import saved

OVERHEAD = 30
# Roles by the type of the last edge; tiers by role.
ROLES = {
    "route_handles": "route-handler", "mediatr_handles": "request-handler", "di_resolves_to": "di-implementation", "di_depends_on_impl": "di-implementation", "di_injects": "consumer",
    "sends_request": "consumer", "options_binds": "config", "options_consumes": "config", "config_impacts": "config", "tests": "test",
}
TIERS = {"changed": "reduced", "exact-seed": "reduced", "route-handler": "reduced", "request-handler": "reduced", "di-implementation": "reduced", "config": "full"}


def _case(value: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), F.lit(other))


def role(via: Column, must_keep: Column) -> Column:
    return F.when(must_keep, F.lit("exact-seed")).otherwise(_case(via, ROLES, "dependency"))


def tier(role_col: Column, mode: str = "auto") -> Column:
    fixed = {"source": "full", "reduced": "reduced", "skeleton": "skeleton", "publicApi": "publicApi"}.get(mode)
    return F.lit(fixed) if fixed else _case(role_col, TIERS, "skeleton")


def running(rows: DataFrame, plan: str, order: list[str], inputs: list[str], name: str, kind: str, begin, step) -> DataFrame:
    """Adds ``name``: what ``step(state, *inputs)``, which gives the next state and a value, makes of each plan's rows in order.

    Plans are read in order from sorted partitions, a batch at a time: linear in the rows, and a task
    holds one state however long a plan is.
    """
    schema = StructType([*rows.schema.fields, StructField(name, _parse_datatype_string(kind))])
    arrow = to_arrow_type(schema[name].dataType)

    def run(batches):
        plan_now, state, fresh = None, begin, True
        for batch in batches:
            out = []
            for p, *values in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (plan, *inputs)), strict=True):
                if fresh or p != plan_now:
                    plan_now, state, fresh = p, begin, False
                state, value = step(state, *values)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], schema.names)

    return rows.repartition(plan).sortWithinPartitions(plan, *order).mapInArrow(run, schema)


def _fit(used: int, cost: int, always: bool, limit: int):
    kept = always or used + cost <= limit
    return used + cost * kept, kept


def pack_plan(rows: DataFrame, budget: int, plan: str = "plan") -> DataFrame:
    """Must-keep rows stay even over the budget; others stay if they fit, and later ones are still tried.

    ``rows``: plan, path, score, cost long, must_keep. Adds kept. Order: must-keep, score desc, path.
    """
    ordered = rows.withColumn("o1", F.when(F.col("must_keep"), 0).otherwise(1)).withColumn("o2", -F.col("score")).withColumn("o3", F.col("path"))
    limited = ordered.withColumn("limit", F.lit(budget))
    return running(limited, plan, ["o1", "o2", "o3"], ["cost", "must_keep", "limit"], "kept", "boolean", 0, _fit).drop("o1", "o2", "o3", "limit")


def pack_density(rows: DataFrame, budget: int | Column, plan: str = "plan", overhead: int = OVERHEAD) -> DataFrame:
    """Trivial rows are free; the most relevant row always stays; the rest by score per cost, if they fit.

    ``rows``: plan, path, score, tokens, trivial. Adds cost and kept.
    """
    top = rows.where(~F.col("trivial")).groupBy(F.col(plan).alias("top_plan")).agg(F.min(F.struct(-F.col("score"), "path"))["path"].alias("top_path"))  # a row per plan
    marked = rows.join(top, F.col(plan).eqNullSafe(F.col("top_plan")), "left")
    costed = marked.withColumn("cost", F.when(F.col("trivial"), F.lit(0)).otherwise(F.col("tokens") + overhead).cast("long"))
    costed = costed.withColumn("always", F.col("trivial") | F.coalesce(F.col("path") == F.col("top_path"), F.lit(False))).drop("top_plan", "top_path")
    ordered = costed.withColumn("o1", F.when(F.col("always"), 0).otherwise(1)).withColumn("o2", -F.col("score") / F.greatest(F.col("cost"), F.lit(1))).withColumn("o3", F.col("path"))
    limited = ordered.withColumn("limit", budget if isinstance(budget, Column) else F.lit(budget))
    return running(limited, plan, ["o1", "o2", "o3"], ["cost", "always", "limit"], "kept", "boolean", 0, _fit).drop("o1", "o2", "o3", "always", "limit")


def prefixed(rows: DataFrame, order: list[Column], cost: str | None = None, plan: str = "plan") -> DataFrame:
    """Adds n, the place of each row in its plan from 1, and total, the costs up to it; no task holds a plan.

    Tasks sort ranges of plan and order, and what a range adds is summed up for each plan; a row's
    numbers are those within its range and what the ranges before it add. Rows alike in the order are in one range.
    """
    keys = [F.col(plan), *order]
    at = saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "ranges")
    added = F.coalesce(F.sum(cost), F.lit(0)) if cost else F.lit(0).cast("long")
    parts = at.groupBy(plan, "__part").agg(F.count(F.lit(1)).alias("__n"), added.alias("__total"))
    before = Window.partitionBy(plan).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a plan
    offsets = parts.select(F.col(plan).alias("__plan"), F.col("__part").alias("__of"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__n", "__total")])
    own = Window.partitionBy(plan, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    within = at.withColumns({"n": F.row_number().over(own), "total": F.sum(cost).over(own) if cost else F.lit(0)})
    joined = within.join(offsets, F.col(plan).eqNullSafe(F.col("__plan")) & (F.col("__part") == F.col("__of")))
    return joined.select(*rows.columns, (F.col("n") + F.col("__n")).cast("int").alias("n"), (F.col("total") + F.col("__total")).cast("long").alias("total"))


def emit_prefix(rows: DataFrame, budget: int, order: list[str], plan: str = "plan") -> DataFrame:
    """Adds n, total and kept: rows in order until the first that overflows; the first row always stays. ``rows``: plan, cost."""
    return prefixed(rows, [F.col(c) for c in order], "cost", plan).withColumn("kept", (F.col("n") == 1) | (F.col("total") <= budget))


def emit_parts(rows: DataFrame, budget: int, plan: str = "plan") -> DataFrame:
    """Adds part from 1: a new part begins at a row that would overflow the current one. ``rows``: plan, seq, cost."""

    def step(state, cost):
        used, part = state
        over = used > 0 and used + cost > budget
        state = (cost, part + 1) if over else (used + cost, part)
        return state, state[1]

    return running(rows, plan, ["seq"], ["cost"], "part", "int", (0, 1), step)


def emission_order(rows: DataFrame, plan: str = "plan") -> DataFrame:
    """Adds seq from 1: by score, tokens and path if any row of the plan has a score, else by tokens and path."""
    scored = rows.groupBy(F.col(plan).alias("scored_plan")).agg(F.max(F.col("score").isNotNull()).alias("any"))  # a row per plan
    first = F.when(F.col("any"), -F.coalesce("score", F.lit(0.0))).otherwise(F.lit(0.0))
    ordered = rows.join(scored, F.col(plan).eqNullSafe(F.col("scored_plan"))).withColumn("__first", first).drop("any", "scored_plan")
    return prefixed(ordered, [F.col("__first"), -F.col("tokens"), F.col("path")], None, plan).withColumnRenamed("n", "seq").drop("__first", "total")


def downgrade_tail(rows: DataFrame, budget: int, order: list[str], plan: str = "plan") -> DataFrame:
    """Rows beyond the budget are replaced by their sketch (sketch_tokens) where that is smaller; adds sketched."""
    summed = prefixed(rows, [F.col(c) for c in order], "tokens", plan).drop("n")
    beyond = (F.col("total") > budget) & (F.col("sketch_tokens") < F.col("tokens"))
    return summed.withColumn("sketched", beyond).withColumn("tokens", F.when(beyond, F.col("sketch_tokens")).otherwise(F.col("tokens"))).drop("total")


#: Rough tokens of the text around a plan's entries: its frame and a line for each.
FRAME, FRAME_LINE = 120, 12


def pack_framed(rows: DataFrame, budget: int, plan: str = "plan", overhead: int = OVERHEAD) -> DataFrame:
    """``pack_density`` with room for the frame: its tokens for the rows kept at first are taken off the budget, and rows are packed again."""
    first = pack_density(rows, budget, plan, overhead).groupBy(F.col(plan).alias("framed")).agg((F.count(F.when(F.col("kept"), 1)) * FRAME_LINE + FRAME).alias("reserve"))
    held = rows.join(first, F.col(plan).eqNullSafe(F.col("framed"))).drop("framed")
    return pack_density(held, F.lit(budget) - F.col("reserve"), plan, overhead).drop("reserve")


def contents_levels(files: DataFrame, budgets: list[int]) -> DataFrame:
    """(budget, level): the finest table of contents that fits each budget: files, folders, or totals alone.

    ``files``: file_path, tokens. A line costs its characters by four, rounded up; totals are given in any case.
    """
    line = lambda text: F.ceil((F.length(text) + 8) / 4).cast("long")
    folders = contents_table(files)
    costs = files.agg(F.coalesce(F.sum(line(F.col("file_path"))), F.lit(0)).alias("files")).crossJoin(F.broadcast(folders.agg(F.coalesce(F.sum(line(F.col("folder"))), F.lit(0)).alias("folders"))))  # one row each
    asked = files.sparkSession.createDataFrame([(b,) for b in budgets], "budget long")
    level = F.when(F.col("files") <= F.col("budget"), "files").when(F.col("folders") <= F.col("budget"), "folders").otherwise("totals")
    return asked.crossJoin(F.broadcast(costs)).select("budget", level.alias("level"))


def contents_table(files: DataFrame) -> DataFrame:
    """Per folder the number of files and their tokens."""
    return files.groupBy(F.regexp_replace("file_path", "/?[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"))


def review_bound(changed: DataFrame, most: int = 150, shown: int = 200) -> DataFrame:
    """Changed files with whether they are reviewed in full or only listed, at most ``shown`` then."""
    n = changed.agg(F.count(F.lit(1)).alias("n"))
    listed = changed.orderBy("file_path").limit(shown)
    full = changed.crossJoin(F.broadcast(n)).where(F.col("n") <= most).select("file_path", F.lit("review").alias("state"))
    return full.unionByName(listed.crossJoin(F.broadcast(n)).where(F.col("n") > most).select("file_path", F.lit("listed").alias("state")))
