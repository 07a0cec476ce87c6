"""Queries for the lookup operators (G1-G4) on events, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablestats.operators import lookup as L
from tablestats.plans.registry import register, rnd
from tablestats.plans.tables import table, tidy


def _event_stmts(spark, sf_dir):
    """Every event reads its user, its type and, where the id is even, the user's group of ten; clicks write the user, every seventh event its type."""
    e = table(spark, sf_dir, "events")
    user, kind = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_type")
    group = F.concat(F.lit("g:"), (F.col("user_id") % 10).cast("string"))
    reads = F.when(F.col("event_id") % 2 == 0, F.array(user, kind, group)).otherwise(F.array(user, kind))
    writes = F.filter(F.array(F.when(kind == "click", user), F.when(F.col("event_id") % 7 == 0, kind), F.when(F.col("event_id") % 5 == 0, group)), lambda x: x.isNotNull())
    return e.select("event_id", reads.alias("reads"), writes.alias("writes"))


# The last writer of each name before an event, as a running maximum.
_DEPS = ("w AS (SELECT event_id AS line, 'u' || user_id AS name, true AS r, event_type = 'click' AS w FROM events "
         "UNION ALL SELECT event_id, event_type, true, event_id % 7 = 0 FROM events "
         "UNION ALL SELECT event_id, 'g:' || (user_id % 10), event_id % 2 = 0, event_id % 5 = 0 FROM events), "
         "x AS (SELECT line, name, r, max(CASE WHEN w THEN line END) OVER (PARTITION BY name ORDER BY line "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM w), "
         "d AS (SELECT line, name, src FROM x WHERE r AND src IS NOT NULL)")


@register("last_writer_edges", f"WITH {_DEPS} SELECT src, line AS dest, string_agg(name, ',' ORDER BY name) AS names FROM d GROUP BY src, line")
def q_last_writer_edges(spark, sf_dir):
    edges = L.last_writer_edges(_event_stmts(spark, sf_dir), "event_id", "reads", "writes")
    return edges.select("src", "dest", F.array_join("names", ",").alias("names"))


@register("group_by_dependency", f"WITH {_DEPS}, s AS (SELECT line, list(DISTINCT {{'name': name, 'src': src}}) AS q FROM d GROUP BY line), "
          "t AS (SELECT e.event_id AS line, list_sort(coalesce(s.q, [])) AS q FROM events e LEFT JOIN s ON e.event_id = s.line) "
          "SELECT line, array_to_string(list_transform(q, lambda x: x.name || '=' || x.src), ' ') AS signature, "
          "count(*) OVER (PARTITION BY q) AS group_size FROM t")
def q_group_by_dependency(spark, sf_dir):
    stmts = _event_stmts(spark, sf_dir)
    edges = L.last_writer_edges(stmts, "event_id", "reads", "writes")
    out = L.group_by_dependency(edges, stmts, "event_id")
    text = F.array_join(F.transform("signature", lambda x: F.concat(x["name"], F.lit("="), x["src"].cast("string"))), " ")
    return out.select("line", text.alias("signature"), "group_size")


# Capacities are the parts' retail prices, needs a share of the lines' prices.


@register("best_fit_lookup", "WITH n AS (SELECT CAST(p_retailprice AS DECIMAL(18, 2)) AS memory, min(p_partkey) AS pos FROM part GROUP BY 1), "
          "l AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 0.04, 2) AS DECIMAL(18, 2)) AS need FROM lineitem) "
          "SELECT l_orderkey, l_linenumber, need::DOUBLE AS need, n.pos AS part, n.memory::DOUBLE AS capacity "
          "FROM l ASOF LEFT JOIN n ON l.need <= n.memory")
def q_best_fit_lookup(spark, sf_dir):
    need = F.round(F.col("l_extendedprice") * 0.04, 2).cast("decimal(18,2)")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", need.alias("need"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_retailprice").cast("decimal(18,2)").alias("memory"), F.col("p_partkey").alias("pos"))
    out = L.best_fit_lookup(li, F.col("need"), nodes)
    return out.select("l_orderkey", "l_linenumber", F.col("need").cast("double").alias("need"), F.col("node.pos").alias("part"),
                      F.col("node.memory").cast("double").alias("capacity"))


@register("peak_step_usage", "WITH l AS (SELECT CAST(l_shipdate AS DATE) AS step, sum(l_extendedprice) AS live "
          "FROM lineitem GROUP BY 1), c AS (SELECT CAST(o_orderdate AS DATE) AS step, "
          "arg_max(o_totalprice, o_orderkey) AS cost FROM orders GROUP BY 1), "
          "p AS (SELECT coalesce(l.step, c.step) AS step, coalesce(live, 0) AS live, coalesce(cost, 0) AS cost "
          "FROM l FULL JOIN c ON l.step = c.step) "
          f"SELECT step, {rnd('live')} AS live, {rnd('cost')} AS cost, {rnd('live + cost')} AS usage, "
          f"{rnd('(SELECT max(live + cost) FROM p)')} AS peak FROM p")
def q_peak_step_usage(spark, sf_dir):
    live = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("step"),
                                                   F.col("l_extendedprice").alias("size"))
    cost = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("step"),
                                                 F.col("o_totalprice").alias("bytes"), "o_orderkey")
    return tidy(L.peak_step_usage(live, cost, cost_order_col="o_orderkey"))


# A line is live from its order's date to its shipping date.
@register("peak_interval_usage", "WITH i AS (SELECT CAST(o_orderdate AS DATE) AS s, CAST(l_shipdate AS DATE) AS e, CAST(l_quantity AS BIGINT) AS z "
          "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) <= CAST(l_shipdate AS DATE)), "
          "c AS (SELECT t, after, sum(change) AS change FROM (SELECT s AS t, 0 AS after, z AS change FROM i UNION ALL SELECT e, 1, -z FROM i) GROUP BY t, after), "
          "u AS (SELECT t, after, sum(change) OVER (ORDER BY t, after) AS usage FROM c) "
          "SELECT usage::BIGINT AS peak, t AS \"at\" FROM u WHERE after = 0 ORDER BY usage DESC, t LIMIT 1")
def q_peak_interval_usage(spark, sf_dir):
    """G4 over intervals by a sweep line."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("until"), F.col("l_quantity").cast("bigint").alias("size"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("since"))
    return L.peak_interval_usage(li.join(o, "l_orderkey"), "since", "until", "size")
