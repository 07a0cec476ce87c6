"""Queries for the function surface (F1-F4) and the streaming partial merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablestats.functions import udf as U
from tablestats.functions.quantiles import QuantileDigest
from tablestats.operators import partials as PM
from tablestats.operators.rows import filter_above
from tablestats.plans.q_stats import _REPORT_SQL, report_rows
from tablestats.plans.registry import register, rnd
from tablestats.plans.steps import NamedSteps
from tablestats.plans.tables import CONST_COL, LINEITEM_NUMERIC, lineitem_numeric, table, tidy
from tablestats.session import work_dir
from tablestats.streaming.partials import stream_corrected_partials, stream_partials_merge

COLS = LINEITEM_NUMERIC + [CONST_COL]


@register("named_steps", " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, {rnd(f'coalesce(avg({c}) FILTER (WHERE {c} > 20), 0.0::double)')} AS mean_value "
    f"FROM (SELECT *, 7.0::double AS {CONST_COL} FROM lineitem)" for c in COLS))
def q_named_steps(spark, sf_dir):
    """The two-step mean-above program: filter values above 20, then mean per column (0 if none)."""
    names = spark.createDataFrame([(c,) for c in COLS], "col_name string")

    def mean_values(filtered):
        means = filtered.groupBy("col_name").agg(F.avg("v").alias("m"))
        return names.join(F.broadcast(means), "col_name", "left") \
            .select("col_name", F.coalesce("m", F.lit(0.0)).alias("mean_value"))

    steps = (NamedSteps()
             .add("filtered", lambda d: filter_above(d, COLS, 20), "data")
             .add("mean_values", mean_values, "filtered"))
    out = steps.run(data=lineitem_numeric(spark, sf_dir))
    return tidy(out["mean_values"])


def _net_charge(pdf: pd.DataFrame) -> pd.DataFrame:
    net = pdf["l_extendedprice"] * (1 - pdf["l_discount"])
    return pd.DataFrame({"l_orderkey": pdf["l_orderkey"], "l_linenumber": pdf["l_linenumber"],
                         "net": net, "charge": net * (1 + pdf["l_tax"])})


@register("udf_rowwise", "SELECT l_orderkey, l_linenumber, "
          f"{rnd('l_extendedprice * (1 - l_discount)')} AS net, "
          f"{rnd('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} AS charge FROM lineitem")
def q_udf_rowwise(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    out = U.udf_rowwise(li, _net_charge, "l_orderkey long, l_linenumber int, net double, charge double")
    return tidy(out)


_DIGEST = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


@register("udaf_tree", " UNION ALL ".join(f"SELECT l_returnflag, {q}::DOUBLE AS q, count(l_extendedprice) AS n, true AS within FROM lineitem GROUP BY l_returnflag" for q in _DIGEST))
def q_udaf_tree(spark, sf_dir):
    """F4 with a state of the user's own: quantiles of the prices by return flag, and whether their exact ranks are within the digest's proven error."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    found = U.udaf_tree(li, QuantileDigest("l_extendedprice", _DIGEST), "l_returnflag string, q double, value double, n bigint, error bigint", keys="l_returnflag").checkpoint()
    v = F.col("l_extendedprice")
    ranks = li.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag", "q").agg(
        F.count_if(v < F.col("value")).alias("below"), F.count_if(v <= F.col("value")).alias("upto"), F.first("n").alias("n"), F.first("error").alias("error"))
    at = F.col("q") * F.col("n")
    within = (F.col("below") <= at + F.col("error")) & (F.col("upto") >= at - F.col("error")) & (F.col("error") <= F.col("n") * 0.01 + 1)
    return ranks.select("l_returnflag", "q", "n", within.alias("within"))


def _streak(state: tuple, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Rises of the price without a break, carried on from the rows before."""
    last, streak = state
    price = pdf["o_totalprice"].to_numpy()
    before = np.concatenate([[np.inf if last is None else last], price[:-1]])
    rise = price > before
    at = np.arange(len(price))
    start = np.maximum.accumulate(np.where(rise, -1, at))
    out = np.where(start < 0, at + 1 + streak, at - start)
    return (price[-1], int(out[-1])), pd.DataFrame({"o_orderkey": pdf["o_orderkey"], "hot_key": pdf["hot_key"], "streak": out})


# One key holds a third of the orders.
@register("udf_grouped_stream", "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS hot_key, o_totalprice FROM orders), "
          "r AS (SELECT *, coalesce(o_totalprice > lag(o_totalprice) OVER (PARTITION BY hot_key ORDER BY o_orderkey), false) AS rise FROM o), "
          "g AS (SELECT *, sum(CASE WHEN rise THEN 0 ELSE 1 END) OVER (PARTITION BY hot_key ORDER BY o_orderkey) AS run FROM r) "
          "SELECT o_orderkey, hot_key, row_number() OVER (PARTITION BY hot_key, run ORDER BY o_orderkey) - 1 AS streak FROM g")
def q_udf_grouped_stream(spark, sf_dir):
    """F3 on groups of any size: how many prices in a row have risen, per customer in the order of orders."""
    key = F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).cast("bigint")
    o = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("hot_key"), "o_totalprice")
    return U.udf_grouped_stream(o, "hot_key", "o_orderkey", lambda: (None, 0), _streak, "o_orderkey bigint, hot_key bigint, streak bigint")


def _rank_orders(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per customer: order rank by date and the running total - vectorised over
    a frame holding several whole customers."""
    pdf = pdf.sort_values(["o_custkey", "o_orderdate", "o_orderkey"], kind="stable")
    by = pdf.groupby("o_custkey", sort=False)
    return pd.DataFrame({"o_custkey": pdf["o_custkey"], "o_orderkey": pdf["o_orderkey"],
                         "order_rank": by.cumcount() + 1, "running_total": by["o_totalprice"].cumsum()})


@register("udf_grouped", "SELECT o_custkey, o_orderkey, row_number() OVER w AS order_rank, "
          f"{rnd('sum(o_totalprice) OVER w')} AS running_total FROM orders "
          "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING "
          "AND CURRENT ROW)")
def q_udf_grouped(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    out = U.udf_grouped(o, "o_custkey", _rank_orders,
                        "o_custkey long, o_orderkey long, order_rank long, running_total double", per_group=False)
    return tidy(out)


@register("udaf_partial", f"SELECT count(l_extendedprice) AS n, {rnd('avg(l_extendedprice)')} AS mean, "
          f"{rnd('stddev_pop(l_extendedprice)')} AS std_pop, {rnd('min(l_extendedprice)')} AS min, "
          f"{rnd('max(l_extendedprice)')} AS max FROM lineitem")
def q_udaf_partial(spark, sf_dir):
    return tidy(U.moments(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@register("stream_partials_merge", _REPORT_SQL)
def q_stream_partials_merge(spark, sf_dir):
    """Per-task partials of events, with their frequency maps, land as parquet files; a streaming fold merges them."""
    base = work_dir(spark, "stream")
    events = table(spark, sf_dir, "events").withColumn("_task", F.spark_partition_id())
    # A handful of event types: a map per task stays small.
    maps = PM.frequency_partials(events, "_task", "event_type").groupBy("_task").agg(F.map_from_entries(F.collect_list(F.struct("key", "count"))).alias("frequency_map"))
    partials = PM.partials_by(events, "_task", "value").join(maps, "_task").drop("_task")
    partials.write.mode("overwrite").parquet(f"{base}/in")
    return report_rows(stream_partials_merge(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint"))


@register("stream_corrected_partials", _REPORT_SQL)
def q_stream_corrected_partials(spark, sf_dir):
    """Partials of ten nodes arrive several times, first halved ones, the right ones, and late old ones; the report is that of the right ones."""
    base = work_dir(spark, "corrected")
    events = table(spark, sf_dir, "events").withColumn("node", F.concat(F.lit("n"), (F.col("event_id") % 10).cast("string")))
    maps = PM.frequency_partials(events, "node", "event_type").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("key", "count"))).alias("frequency_map"))
    right = PM.partials_by(events, "node", "value").join(maps, "node").checkpoint()
    wrong = right.withColumn("total_sum", F.col("total_sum") / 2).withColumn("min_value", F.lit(-1e9)).withColumn("frequency_map", F.transform_values("frequency_map", lambda k, v: v * 3))
    fields = ["node", "version", "total_sum", "item_count", "min_value", "max_value", "frequency_map"]
    for version, rows in ((1, wrong), (3, right), (2, wrong.withColumn("item_count", F.lit(5).cast("bigint")))):
        rows.withColumn("version", F.lit(version).cast("bigint")).select(*fields).write.mode("append").parquet(f"{base}/in")
    return report_rows(stream_corrected_partials(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", max_files_per_trigger=3))
