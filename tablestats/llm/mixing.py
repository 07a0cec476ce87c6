"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are words. Sources in code point order (null last) weigh 5, 2, 1, repeating,
and share the total size by weight; a target stops at three times its source's
size, and what is over is shared among the others by weight until none is above.

A source gives as many whole copies of itself as its target holds. For the rest
its documents are counted by exact size; each size gives its proportional share,
rounded down, or up while more than ``DP_BUDGET`` words remain. What then remains of the budget
is filled by dynamic programming over the documents left (a bounded knapsack, each size as often as
documents are left), which hits it exactly if any choice of them does. ``DP_BUDGET`` bounds the
program's table, not what is mixed: shares rounded up always leave less than the table
holds, unless the sizes that could be rounded up are themselves larger than what remains;
then smaller documents are taken first. Which documents of a size are taken is
decided by a seeded hash.

Only counts by source and size meet in one task (as many rows as a source has
different sizes); documents are counted by id in buckets of about the square root of
their number, so a size shared by very many documents is spread out. The order ends
at one id of each source and size; where that id is repeated and not all its rows
are taken, they are ordered in the same way by their texts' hash and a written row
number.

Edge cases: a null text has size 0 and is never taken; a null source is a source
of its own; rows that share id, source and size are counted one by one; null ids
are ordered like any other; a table without words has targets 0; other columns are ignored or, in ``mixed``, kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablestats.llm.common import WORD_PATTERN, broadcast_if_small, column, free_names, saved, written
from tablestats.operators.chunks import with_row_index

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SEED = 20
#: Words that dynamic programming distributes at most.
DP_BUDGET = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_row_index(sources, [F.col("source").asc_nulls_last()], "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = saved(ranked.select("source", "source_size", w.alias("weight"), (max_copies * F.col("source_size")).cast("double").alias("cap")))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    # Sources whose share is above their cap are set to it; the level of the others rises, which may put more above.
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("cap")
        r = ranked.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if full == r[2] or not r[1]:
            break
        full, level = r[2], (total - r[0]) / r[1]
    return saved(ranked.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target")))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that sizes add up to the budget or just below it."""
    take = np.zeros(len(sizes), np.int64)
    whole = int((sizes * counts).sum())
    if budget <= 0 or not whole:
        return take
    if budget >= whole:
        return counts.copy()
    take = np.array([int(c) * budget // whole for c in counts], np.int64)
    take[sizes <= 0] = 0
    left = budget - int((take * sizes).sum())
    order = np.argsort(-sizes)
    for rounded in (True, False):  # shares rounded up; only then any documents
        for i in order:
            if left <= DP_BUDGET:
                break
            if sizes[i] > 0:
                n = min(int(counts[i] - take[i]), (left - DP_BUDGET + int(sizes[i]) - 1) // int(sizes[i]), left // int(sizes[i]), 1 if rounded else left)
                take[i] += n
                left -= n * int(sizes[i])
    # reach[s]: the item that first made the sum s; items are powers of two of a size.
    reach = np.full(left + 1, -2, np.int64)
    reach[0] = -1
    items: list[tuple[int, int]] = []
    for i in order:
        n, part = int(counts[i] - take[i]), 1
        while n > 0 and 0 < sizes[i] and reach[left] == -2:
            k = min(part, n)
            step = k * int(sizes[i])
            if step <= left:
                new = np.flatnonzero((reach[:-step] > -2) & (reach[step:] == -2))
                reach[new + step] = len(items)
                items.append((int(i), k))
            n -= k
            part *= 2
    at = int(np.flatnonzero(reach > -2)[-1])
    while at > 0:
        i, k = items[reach[at]]
        take[i] += k
        at -= k * int(sizes[i])
    return take


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies of every document of a size, and how many documents get one more."""
    whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    copies = int(target // whole) if whole else 0
    rows = rows.sort_values("size", ignore_index=True)
    extra = fit_budget(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), round(target - copies * whole))
    return rows.assign(copies=copies, extra=extra)[["source", "size", "n", "source_size", "target", "copies", "extra"]]


def _by_size(rows: DataFrame, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``sizes``, one row per source and size."""
    other = sizes.withColumnsRenamed({"source": "s", "size": "z"})
    return rows.join(other, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), how).drop("s", "z")


def _last(rows: DataFrame, bucket: str, *order: str) -> DataFrame:
    """Where the first ``need`` rows by bucket and order end: (source, size, the last one's bucket and order, its rows ``same``, how many ``of`` them)."""
    keys = saved(rows.groupBy("source", "size", "need", bucket, *order).agg(F.count(F.lit(1)).alias("same")))
    held = keys.groupBy("source", "size", "need", bucket).agg(F.sum("same").alias("held"))
    so_far = W.partitionBy("source", "size").rowsBetween(W.unboundedPreceding, -1)
    before = held.withColumn("before", F.coalesce(F.sum("held").over(so_far.orderBy(bucket)), F.lit(0))).where("before < need AND need <= before + held")
    inside = _by_size(keys, before.select("source", "size", F.col(bucket).alias("b"), "before")).where(F.col(bucket) == F.col("b"))
    below = inside.withColumn("of", F.col("need") - F.col("before") - F.coalesce(F.sum("same").over(so_far.orderBy(*order)), F.lit(0))).where("0 < of AND of <= same")
    return saved(below.select("source", "size", *[F.col(c).alias(f"last_{c}") for c in (bucket, *order)], "same", "of"))


def mix_rows(rows: DataFrame, seed: int = SEED, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies) from rows (row, doc_id, source, size, text_hash); row numbers are unique."""
    rows = saved(rows)
    aims = targets(rows, weights, max_copies)
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = saved(joined.groupBy("source").applyInPandas(_plan, "source string, size long, n long, source_size long, target double, copies long, extra long"))
    # A seeded order within each size: by bucket, then by hash; about sqrt(n) buckets of sqrt(n) documents.
    dealt = _by_size(rows, broadcast_if_small(plan, plan)).withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("h", F.ceil(F.sqrt("n")))).withColumnRenamed("extra", "need")
    dealt = saved(dealt)
    last = _last(dealt.where("need > 0"), "bucket", "h", "doc_id")
    # Rows of that id, if only some are taken: the same again by text and row number.
    at, end = F.struct("bucket", "h", "doc_id"), F.struct("last_bucket", "last_h", "last_doc_id")
    g = F.xxhash64(F.lit(seed), "text_hash", "row")
    split = _by_size(dealt, last.where("of < same")).where(at == end).withColumn("need", F.col("of")).withColumn("g", g).withColumn("part", F.pmod("g", F.ceil(F.sqrt("same"))))
    last_rows = _last(split.select("source", "size", "need", "part", "g", "row"), "part", "g", "row").drop("same", "of")
    ends = saved(_by_size(last, last_rows, "left"))
    out = _by_size(dealt, broadcast_if_small(ends, ends), "left")
    some = F.struct(F.pmod(g, F.ceil(F.sqrt("same"))), g, F.col("row")) <= F.struct("last_part", "last_g", "last_row")
    more = F.when(F.col("of").isNull() | (at > end), False).when((at < end) | (F.col("of") == F.col("same")), True).otherwise(some)
    return out.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("copies") + more.cast("long")).alias("copies"))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    text = column(docs, text_col).cast("string")
    return docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), column(docs, id_col).cast("long").alias("doc_id"), column(docs, source_col).cast("string").alias("source"),
                       word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    return mix_rows(_sized(docs, id_col, source_col, text_col), seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    i, n, k = free_names(docs, "row_", "copies_", "copy_")
    rows = written(docs.withColumn(i, F.monotonically_increasing_id()))
    plan = mix_rows(_sized(rows, id_col, source_col, text_col, column(rows, i)), seed).where("copies > 0")
    both = rows.join(saved(plan.select("row", F.col("copies").alias(n))).withColumnRenamed("row", k), F.col(i) == F.col(k)).drop(k)
    return both.select(*[column(both, c) for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias(k)).drop(k)
