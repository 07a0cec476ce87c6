"""Connected components of an edge table, by alternating star contraction.

Each round hangs every node's larger neighbours on its smallest neighbour, then
every node's smaller neighbours on the smallest of them; a forest of stars is
reached in about log(n) rounds. Edges never leave the executors; each round is
written to the shared checkpoint folder, so lineage stays short. Tables that are
joined are written first, so that a hub's rows can be split among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablestats.llm.common import saved

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of long ids); root: the smallest node reachable."""
    a, b = edges.columns
    e = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = saved(e)
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = saved(small)
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
