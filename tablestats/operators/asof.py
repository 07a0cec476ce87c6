"""Running extremes over an order ("latest earlier", "smallest at least") without hot partitions.

A window ``partitionBy(key).orderBy(order)`` puts every row of a key into one
task; with one key holding a third of the table that task holds a third of
the data. Here the order axis is also cut into ranges (buckets):

1. inside each (key, bucket) a window gives the extreme of the rows before;
2. one aggregate gives each (key, bucket) its own extreme - a table with
   one row per bucket, not per row;
3. a window over that small table carries the extreme of all earlier
   buckets, and is joined back on (key, bucket), the same keys the first
   window is partitioned by, so the large side is not shuffled again.

The answer is the extreme of the in-bucket value and the carried value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablestats.session import checkpoint_root

def ranged(df: DataFrame, *order: Column, col: str = "_range") -> DataFrame:
    """``df``, written once, with ``col``: the number of the range of ``order`` that a row lies in.

    Spark's range partitioner cuts at quantiles of a sample of the rows, into as many
    ranges as the session has shuffle partitions, so ranges follow the data and the
    cluster; rows equal in ``order`` share a range.
    """
    checkpoint_root(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn(col, F.spark_partition_id()).checkpoint()


def quantile_bucket(df: DataFrame, order_col: str, rows_per_bucket: int) -> Column:
    """A non-decreasing bucket of ``order_col`` with about ``rows_per_bucket`` rows of ``df`` in each.

    For a stated width; the cuts come to the driver and every row is compared with them,
    so this is for some hundreds of buckets (``ranged`` has no such limit). Cut at quantiles of
    the rows, so neither gaps nor dense stretches of the values matter.
    """
    n = df.agg(F.count(order_col)).first()[0]
    buckets = -(-n // rows_per_bucket)
    if buckets < 2:
        return F.lit(0)
    cuts = df.agg(F.percentile_approx(order_col, [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0]
    return F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c <= F.col(order_col)))


def running_extreme(df: DataFrame, keys, order_col: str | Column, cand: Column, out_col: str, extreme: str = "max",
                    include_current: bool = False, bucket: Column | None = None, tie_cols=()) -> DataFrame:
    """Add ``out_col``: the max (or min) of ``cand`` over the earlier rows of the same ``keys``.

    Rows are ordered by ``order_col`` then ``tie_cols``; ``include_current``
    also counts the row itself. ``bucket`` is a non-decreasing function of
    ``order_col`` that splits the order range; without it one bucket is used.
    """
    agg = F.max if extreme == "max" else F.min
    pick = F.greatest if extreme == "max" else F.least
    keys = list(keys)
    b = bucket if bucket is not None else F.lit(0)
    data = df.withColumn("_bucket", b).withColumn("_cand", cand)
    frame_end = Window.currentRow if include_current else -1
    local_w = Window.partitionBy(*keys, "_bucket").orderBy(order_col, *tie_cols) \
        .rowsBetween(Window.unboundedPreceding, frame_end)
    local = data.withColumn("_local", agg("_cand").over(local_w))
    # Derived from the windowed rows, which are already partitioned by
    # (keys, bucket): no second scan and no second shuffle of the input.
    per_bucket = local.groupBy(*keys, "_bucket").agg(agg("_cand").alias("_bext"))
    carry_w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, "_bucket", agg("_bext").over(carry_w).alias("_carry"))
    joined = local.join(carry, [*keys, "_bucket"], "left")
    return joined.withColumn(out_col, pick(F.col("_local"), F.col("_carry"))) \
        .drop("_bucket", "_cand", "_local", "_carry")
