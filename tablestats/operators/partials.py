"""Partial aggregates and their merge.

A partial is one row ``(total_sum, item_count, min_value, max_value)`` plus an
optional ``frequency_map map<string,bigint>`` - the result of one worker on its
slice. Merging is an ordinary aggregate over partials, so a table of any
number of partials merges with partial + final hash aggregation.

Fixed semantics of the merge: average = final sum / final count (never an
average of averages); with no items the count is 0, the average 0 and
min/max NULL. Empty partials carry NULL (not +/-inf) for min and max.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablestats.operators.columns import INTEGRAL, value
from tablestats.operators.exact import exact_partials, merged_sum

PARTIAL_DDL = ("total_sum double, item_count bigint, min_value double, max_value double, "
               "frequency_map map<string,bigint>")


def partials_by(df: DataFrame, node_col: str, value_col: str, exact: bool = False) -> DataFrame:
    """One partial per value of ``node_col`` (the reference's per-node chunk).

    With ``exact`` a partial also carries its sum as integer limbs (``exact``), so
    that the merged sum is the same however the values were dealt to nodes.
    """
    v = value(df, value_col).cast("double")
    out = df.groupBy(node_col).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("total_sum"),
        F.count(v).alias("item_count"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )
    if not exact:
        return out
    limbs = exact_partials(df, value_col, node_col).withColumnRenamed(node_col, "_node")
    return out.join(limbs, out[node_col].eqNullSafe(limbs["_node"]), "left").drop("_node")


def partials_by_task(df: DataFrame, value_col: str) -> DataFrame:
    """One partial per input partition: a task's rows are folded before any shuffle."""
    return partials_by(df.withColumn("_task", F.spark_partition_id()), "_task", value_col).drop("_task")


def frequency_partials_by_task(df: DataFrame, key_col: str) -> DataFrame:
    """Frequency rows ``(key, count)`` per input partition."""
    return frequency_partials(df.withColumn("_task", F.spark_partition_id()), "_task", key_col).drop("_task")


def frequency_partials(df: DataFrame, node_col: str, key_col: str) -> DataFrame:
    """Per-node frequency maps kept long: ``(node, key, count)``.

    Long rows instead of one map per node: a node with many distinct keys
    would otherwise build an unbounded map in one task.
    """
    return df.groupBy(node_col, F.col(key_col).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("count"))


def merge_partials(partials: DataFrame, frequencies: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Fold partials into the one-row report.

    With ``frequencies`` (long rows ``(key, count)``), or if the partials carry a
    ``frequency_map``, the report ends in ``most_common``: the ``k`` most frequent
    keys of all partials together, as an array of (item, frequency) in that order.
    If the partials carry ``limbs``, sum and average are the exact ones, rounded once.
    """
    cnt = F.coalesce(F.sum("item_count"), F.lit(0)).cast("bigint")
    total = F.coalesce(F.sum("total_sum"), F.lit(0.0))
    has = cnt > 0
    report = partials.agg(
        cnt.alias("total_records_processed"),
        total.alias("overall_sum"),
        F.when(has, total / cnt).otherwise(F.lit(0.0)).alias("overall_average"),
        F.when(has, F.min("min_value")).alias("overall_minimum"),
        F.when(has, F.max("max_value")).alias("overall_maximum"),
    )
    if "limbs" in partials.columns:
        exact = merged_sum(partials).scalar()
        n = F.col("total_records_processed")
        report = report.withColumn("overall_sum", exact).withColumn("overall_average", F.when(n > 0, F.col("overall_sum") / n).otherwise(F.lit(0.0)))
    if frequencies is None and "frequency_map" in partials.columns:
        frequencies = partials
    if frequencies is None:
        return report
    entry = F.struct((-F.col("frequency")).alias("o"), "item", "frequency")
    top = merge_frequencies(frequencies, k).agg(F.array_sort(F.collect_list(entry)).alias("t"))
    top = top.select(F.transform("t", lambda x: F.struct(x["item"].alias("item"), x["frequency"].alias("frequency"))).alias("t"))
    return report.withColumn("most_common", top.scalar())


def merge_frequencies(freq: DataFrame, k: int = 5, key_col: str = "key", count_col: str = "count") -> DataFrame:
    """Add up frequency counts and keep the ``k`` most common.

    Accepts long rows ``(key, count)`` or partials with a ``frequency_map``
    column. Ties are broken by key ascending (the reference keeps first-seen
    order, which a distributed merge has no notion of). ``limit`` after
    ``orderBy`` plans as TakeOrderedAndProject: each task keeps its top k.
    """
    if "frequency_map" in freq.columns:
        freq = freq.select(F.explode("frequency_map").alias(key_col, count_col))
    summed = freq.groupBy(F.col(key_col).alias("item")).agg(F.sum(count_col).cast("bigint").alias("frequency"))
    return summed.orderBy(F.desc("frequency"), F.asc("item")).limit(k)


TAGS = {"c", "a", "s", "m", "n", "l", "i"}


def parse_aggregation_tag(text: str) -> tuple[str, str]:
    """Split a ``"type:name"`` merge annotation (``"s:result"``, ``":data"``).

    Returns ``(tag, name)``; the tag must be one of ``TAGS`` or empty (run
    unsplit), and the name must be present.
    """
    tag, sep, name = text.partition(":")
    tag, name = tag.strip(), name.strip()
    if not sep or not name:
        raise ValueError(f"aggregation must look like 'type:name', got {text!r}")
    if tag not in TAGS and tag != "":
        raise ValueError(f"invalid aggregation tag {tag!r}")
    return tag, name


def merge_by_tag(partials: DataFrame, tag: str, value_col: str = "partial", chunk_col: str = "chunk_id",
                 weight_col: str | None = None) -> DataFrame:
    """Combine per-chunk result vectors position by position.

    ``partials`` has one row per chunk with an array ``value_col``. Tags:
    ``s`` sum, ``a`` average (weighted by ``weight_col`` - the chunk's row
    count - when given), ``m`` max, ``n`` min, ``l`` total length (sum of the
    per-chunk lengths), ``i`` product, ``c`` concatenation in chunk order.
    The empty tag means "do not split" and has nothing to merge.

    Returns ``(pos, value)``; for ``c`` the position is the index in the
    concatenated list.
    """
    if tag == "":
        raise ValueError("empty tag: the step runs unsplit, there is nothing to merge")
    if tag not in TAGS:
        raise ValueError(f"invalid aggregation tag {tag!r}")
    cols = [F.col(chunk_col)]
    if weight_col:
        cols.append(F.col(weight_col).alias("_w"))
    long = partials.select(*cols, F.posexplode(value_col).alias("pos", "v"))
    if tag == "c":
        sizes = partials.select(F.col(chunk_col), F.size(value_col).alias("_len"))
        # One row per chunk: a window without partitioning is fine at this
        # size. No broadcast hint: adaptive execution broadcasts the offsets
        # only when their measured size is below its threshold.
        offs = sizes.select(chunk_col, F.coalesce(F.sum("_len").over(
            Window.orderBy(chunk_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
        return long.join(offs, chunk_col).select((F.col("_off") + F.col("pos")).alias("pos"),
                                                 F.col("v").alias("value"))
    agg = {
        "s": F.sum("v"),
        "l": F.sum("v"),
        "m": F.max("v"),
        "n": F.min("v"),
        "i": F.product("v"),
        "a": (F.sum(F.col("v") * F.col("_w")) / F.sum("_w")) if weight_col else F.avg("v"),
    }[tag]
    return long.groupBy("pos").agg(agg.alias("value"))


def merge_tagged(partials: DataFrame, tags: dict, chunk_col: str = "chunk_id",
                 weight_col: str | None = None) -> DataFrame:
    """D12 for several result vectors at once: ``tags`` maps each array column
    of ``partials`` to its tag (``s a m n l i``; use ``merge_by_tag`` for ``c``).

    All vectors are exploded together and merged by one aggregate keyed by
    (column, position) - one shuffle for all of them. Returns
    ``(name, tag, pos, value, exact)``: ``exact`` is the value as ``decimal(38,0)``
    where the vector holds integers and the tag keeps them whole (s, l, m, n),
    so sums beyond 2^53 lose nothing; NULL otherwise.
    """
    bad = {c: t for c, t in tags.items() if t not in TAGS - {"c"}}
    if bad:
        raise ValueError(f"merge_tagged handles s/a/m/n/l/i, got {bad}")
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)

    def labelled(c):
        whole = isinstance(partials.schema[c].dataType.elementType, INTEGRAL)
        return F.transform(F.col(c), lambda x, i: F.struct(
            F.lit(c).alias("name"), i.alias("pos"), x.cast("double").alias("v"),
            (x if whole else F.lit(None)).cast("decimal(38,0)").alias("d")))

    cells = [labelled(c) for c in tags]
    long = partials.select(w.alias("_w"), F.explode(F.concat(*cells)).alias("e")).select("_w", "e.*")
    merged = long.groupBy("name", "pos").agg(
        F.sum("v").alias("_s"), F.max("v").alias("_m"), F.min("v").alias("_n"), F.product("v").alias("_i"),
        (F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("_a"),
        F.sum("d").alias("_ds"), F.max("d").alias("_dm"), F.min("d").alias("_dn"))
    tag_of = F.create_map(*[x for c, t in tags.items() for x in (F.lit(c), F.lit(t))])[F.col("name")]
    value = (F.when(tag_of.isin("s", "l"), F.col("_s")).when(tag_of == "m", F.col("_m"))
             .when(tag_of == "n", F.col("_n")).when(tag_of == "i", F.col("_i")).otherwise(F.col("_a")))
    exact = F.when(tag_of.isin("s", "l"), F.col("_ds")).when(tag_of == "m", F.col("_dm")).when(tag_of == "n", F.col("_dn"))
    return merged.select("name", tag_of.alias("tag"), "pos", value.alias("value"), exact.alias("exact"))
