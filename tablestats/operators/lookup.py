"""Lookup operators taken from the reference's planner rules.

* G1 ``last_writer_edges``: for each statement/event that reads names, the
  latest earlier one that wrote each name; edges grouped per (src, dest).
* G2 ``group_by_dependency``: statements whose sets of (name, writer)
  dependencies are identical share a group.
* G3 ``best_fit_lookup``: for each row the smallest capacity >= its need.
* G4 ``peak_step_usage``: per step, live sizes plus the step's own cost, and
  the peak over steps.
* G4 over intervals ``peak_interval_usage``: items that live from a start to an end,
  the highest total size at any one time, without a row per item and step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablestats.operators.asof import quantile_bucket, ranged, running_extreme
from tablestats.session import checkpoint_root


def dependency_rows(stmts: DataFrame, line_col: str, reads_col: str, writes_col: str) -> DataFrame:
    """One row per (line, name) a statement reads or writes, with both flags; no shuffle."""
    names = F.array_distinct(F.concat(F.coalesce(F.col(reads_col), F.array()),
                                      F.coalesce(F.col(writes_col), F.array())))
    rows = stmts.select(F.col(line_col).alias("line"), F.col(reads_col).alias("_r"), F.col(writes_col).alias("_w"),
                        F.explode(names).alias("name"))
    return rows.select("line", "name", F.coalesce(F.array_contains("_r", F.col("name")), F.lit(False)).alias("reads"),
                       F.coalesce(F.array_contains("_w", F.col("name")), F.lit(False)).alias("writes"))


def last_writer_edges(stmts: DataFrame, line_col: str, reads_col: str, writes_col: str,
                      rows_per_bucket: int | None = None) -> DataFrame:
    """G1: edges ``(src, dest, names)``: ``src`` is the last statement strictly
    before ``dest`` (in ``line_col`` order, unique per statement) that wrote
    each name ``dest`` reads; names without an earlier writer give no edge.
    ``names`` is sorted (the reference lists them in read order).

    The "last earlier writer" is a running max of writer lines per name,
    split into ranges of the lines (as many as shuffle partitions, however sparse the lines
    are; or of about ``rows_per_bucket`` statements) so one busy name is not one task.
    """
    rows = dependency_rows(stmts, line_col, reads_col, writes_col)
    if rows_per_bucket:
        bucket = quantile_bucket(stmts.select(F.col(line_col).alias("line")), "line", rows_per_bucket)
    else:
        rows, bucket = ranged(rows, F.col("line")), F.col("_range")
    found = running_extreme(rows, ["name"], "line", F.when(F.col("writes"), F.col("line")), "src", "max",
                            include_current=False, bucket=bucket)
    edges = found.where(F.col("reads") & F.col("src").isNotNull())
    return edges.groupBy("src", F.col("line").alias("dest")).agg(F.array_sort(F.collect_list("name")).alias("names"))


def dependency_signatures(edges: DataFrame) -> DataFrame:
    """Per destination, the set of its dependencies: sorted ``array<struct<name, src>>``."""
    pairs = edges.select("dest", F.explode("names").alias("name"), "src")
    return pairs.groupBy("dest").agg(F.array_sort(F.collect_set(F.struct("name", "src"))).alias("signature"))


def group_by_dependency(edges: DataFrame, stmts: DataFrame, line_col: str) -> DataFrame:
    """``(line, signature, group_size)`` for every statement.

    The signature is the set of (name, src) structs; statements without
    dependencies share the empty one. Groups stay long (one row per member)
    instead of one list per group: a popular signature would otherwise be one
    huge row. Members are written once and counted and joined from there
    (adaptive execution splits a hot signature).
    """
    sigs = dependency_signatures(edges)
    kind = sigs.schema["signature"].dataType
    lines = stmts.select(F.col(line_col).alias("line"))
    checkpoint_root(stmts.sparkSession)
    member = lines.join(sigs, lines["line"] == sigs["dest"], "left") \
        .select("line", F.coalesce(F.col("signature"), F.array().cast(kind)).alias("signature")).checkpoint()
    sizes = member.groupBy("signature").agg(F.count(F.lit(1)).alias("group_size"))
    return member.join(sizes, "signature").select("line", "signature", "group_size")


def _common(a, b):
    """Type in which needs and capacities compare without loss where there is one."""
    exact = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
    if a == b:
        return a
    if isinstance(a, exact) and isinstance(b, exact):
        scale = max(t.scale if isinstance(t, T.DecimalType) else 0 for t in (a, b))
        return T.DecimalType(38, scale)
    return T.DoubleType()


def best_fit_lookup(df: DataFrame, need: Column, nodes: DataFrame, out_col: str = "node",
                    memory_col: str = "memory", pos_col: str = "pos", rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``out_col`` = the node struct with the smallest ``memory >= need``.

    Ties go to the smallest ``pos`` (first in the node list); NULL when no
    node is large enough or the need is NULL. Integer and decimal values are compared exactly.

    The answer depends only on the need, so the lookup runs once for every
    distinct need (a value held by a third of the rows is one row here) and is
    joined back by value (adaptive execution broadcasts a small answer table and
    splits a hot join key). Needs and distinct capacities form one stream in descending order
    of value, capacities before needs at equal value; the running minimum of the
    capacities, plain numbers, is the answer, taken per range of values with a
    carried minimum (as many ranges as shuffle partitions, or of about
    ``rows_per_bucket`` values). The node itself is joined to its capacity afterwards. The
    same for any number of nodes.
    """
    node = F.struct(F.col(memory_col).alias("memory"), F.col(pos_col).alias("pos"),
                    *[F.col(c) for c in nodes.columns if c not in (memory_col, pos_col)])
    kind = _common(df.select(need.alias("n")).schema["n"].dataType, nodes.schema[memory_col].dataType)
    caps = nodes.where(F.col(memory_col).isNotNull()).groupBy(F.col(memory_col).cast(kind).alias("_cap")).agg(F.min(node).alias(out_col))
    needs = df.select(need.cast(kind).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    both = needs.select("_v", F.lit(1).alias("_kind")).unionByName(caps.select(F.col("_cap").alias("_v"), F.lit(0).alias("_kind")))
    if rows_per_bucket:
        bucket = -quantile_bucket(both, "_v", rows_per_bucket)
    else:
        both, bucket = ranged(both, F.col("_v").desc()), F.col("_range")
    found = running_extreme(both, [], F.col("_v").desc(), F.when(F.col("_kind") == 0, F.col("_v")), "_cap", "min", include_current=True,
                            bucket=bucket, tie_cols=["_kind"])
    answers = found.where((F.col("_kind") == 1) & F.col("_cap").isNotNull()).select("_v", "_cap").join(caps, "_cap").drop("_cap")
    return df.withColumn("_v", need.cast(kind)).join(answers, "_v", "left").drop("_v")


def peak_step_usage(live: DataFrame, cost: DataFrame, step_col: str = "step", size_col: str = "size",
                    cost_col: str = "bytes", cost_order_col: str | None = None) -> DataFrame:
    """``(step, live, cost, usage, peak)``.

    ``live`` holds item sizes per step (summed); ``cost`` the step's own
    cost - when a step has several, the last by ``cost_order_col`` (the
    largest without one). A step
    missing on either side counts 0 there. ``peak`` is the max usage over all
    steps, attached as a scalar subquery (one aggregate, run once).
    """
    live_sum = live.groupBy(step_col).agg(F.sum(size_col).alias("live"))
    if cost_order_col:
        step_cost = cost.groupBy(step_col).agg(F.max_by(cost_col, cost_order_col).alias("cost"))
    else:
        step_cost = cost.groupBy(step_col).agg(F.max(cost_col).alias("cost"))
    per_step = live_sum.join(step_cost, step_col, "full").select(
        step_col, F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("cost", F.lit(0)).alias("cost"))
    per_step = per_step.withColumn("usage", F.col("live") + F.col("cost"))
    peak = per_step.agg(F.coalesce(F.max("usage"), F.lit(0)).alias("peak")).scalar()
    return per_step.withColumn("peak", peak)


def interval_usage(intervals: DataFrame, start_col: str, end_col: str, size_col: str) -> DataFrame:
    """G4 by a sweep line: ``(at, usage)``, the total size of the live items at every time it changes.

    An item is live from its start up to its end, the end included (ends are the last
    time, so that an item whose start is its end counts there). Items with a
    missing bound or size, or an end before the start, never live.

    Each item is two changes, not one row per time between: its size at the start, and
    its size taken off right after the end. Changes of equal times are added up, the
    times are sorted into ranges, and a running sum within a range starts from
    the total of the ranges before: one row per range.
    """
    live = intervals.where(F.col(start_col) <= F.col(end_col)).where(F.col(size_col).isNotNull())
    changes = live.select(F.explode(F.array(
        F.struct(F.col(start_col).alias("at"), F.lit(0).alias("after"), F.col(size_col).alias("change")),
        F.struct(F.col(end_col).alias("at"), F.lit(1).alias("after"), (-F.col(size_col)).alias("change")))).alias("x")).select("x.*")
    checkpoint_root(intervals.sparkSession)
    times = changes.groupBy("at", "after").agg(F.sum("change").alias("change"))
    ranged = times.repartitionByRange("at", "after").sortWithinPartitions("at", "after").withColumn("_range", F.spark_partition_id()).checkpoint()
    order = Window.partitionBy("_range").orderBy("at", "after").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("change").alias("_total")).select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    swept = ranged.withColumn("_own", F.sum("change").over(order)).join(F.broadcast(totals), "_range")
    # After an end nothing new is live: the time itself has the usage before it.
    return swept.select("at", "after", (F.col("_before") + F.col("_own")).alias("usage"))


def peak_interval_usage(intervals: DataFrame, start_col: str, end_col: str, size_col: str) -> DataFrame:
    """G4 over intervals: one row ``(peak, at)``, the highest total size of live items and the first time it is reached.

    Without live items the peak is 0 and ``at`` NULL. Sizes that are integers or decimals
    are added exactly.
    """
    usage = interval_usage(intervals, start_col, end_col, size_col).where("after = 0")
    best = usage.agg(F.max("usage").alias("peak"), F.min_by("at", F.struct((-F.col("usage")).alias("u"), "at")).alias("at"))
    return best.select(F.coalesce("peak", F.lit(0)).alias("peak"), "at")
