"""Pearson correlation matrix with the source programs' zero-variance rule.

A pair whose either side has zero variance gets 0, also on the diagonal.
Spark's ``corr`` cannot be used as is: under ANSI it raises on a constant
column and it returns 1.0 for ``corr(c, c)`` of a constant ``c``.

There is one path for any number of columns p, two passes over the data. Pass 1
gives mean, minimum and maximum per column: every task folds its Arrow batches into p rows,
which are added up by column (3p numbers to the driver). Pass 2: every task folds its Arrow batches, centred by the means,
into a p x p Gram matrix with numpy; the tasks' matrices travel as rows of p
numbers and are added row by row, each row in one task. Nothing of size p x p
passes through the driver, and no generated code grows with p.

Missing values (NULL or NaN) follow one stated rule, ``missing``:

* ``"complete"`` (default): a row with a missing value in any of the columns is
  left out, as the comparison scripts of the source programs do. The answer for
  a pair then depends on which columns take part.
* ``"pairwise"``: a row is left out of the pairs it has a missing value in (the
  rule of pandas' ``corr``). The same Gram matrices are built for values, squares
  and presence, so adding a column never changes the other pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablestats.operators.columns import resolve, value_sql
from tablestats.session import checkpoint_root

MISSING = ("complete", "pairwise")
#: Tasks that build a Gram matrix, per core; more splits are read by one task one after the other.
TASKS_PER_CORE = 4
#: A pair's variance below this share of its rows' mean square deviation is rounding noise of a constant.
NOISE = 1e-14


def _ranges(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[pa.RecordBatch]:
    """One task's count, sum, minimum and maximum of every column: rows (k, n, s, lo, hi)."""
    n, s, lo, hi = np.zeros(p, np.int64), np.zeros(p), np.full(p, np.inf), np.full(p, -np.inf)
    for b in batches:
        x = np.asarray(b.column(0).flatten(), np.float64).reshape(-1, p)
        if len(x):
            there = ~np.isnan(x)
            n += there.sum(0)
            s += np.where(there, x, 0.0).sum(0)
            lo, hi = np.fmin(lo, np.fmin.reduce(x)), np.fmax(hi, np.fmax.reduce(x))
    held = n > 0
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(p, dtype=np.int32)[held]), *[pa.array(v[held]) for v in (n, s, lo, hi)]], ["k", "n", "s", "lo", "hi"])


def _gram(batches: Iterator[pa.RecordBatch], means: np.ndarray, pairwise: bool) -> Iterator[pa.RecordBatch]:
    """One task's sums of products: rows (i, kind, values)."""
    p = len(means)
    acc = np.zeros((4 if pairwise else 1, p, p))
    for b in batches:
        x = np.asarray(b.column(0).flatten(), np.float64).reshape(-1, p) - means
        if pairwise:
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            there = there.astype(np.float64)
            # Of rows where both are present: sums of products, of the first, of its square, and their number.
            acc += np.stack([x.T @ x, x.T @ there, (x * x).T @ there, there.T @ there])
        else:
            acc[0] += x.T @ x
    kinds, rows = np.divmod(np.arange(len(acc) * p), p)
    yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(kinds.astype(np.int32)), pa.array(list(acc.reshape(-1, p)), pa.list_(pa.float64()))], ["i", "kind", "s"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same (i, kind), which are in this task, added up."""
    acc: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for i, kind, s in zip(b.column("i").to_pylist(), b.column("kind").to_pylist(), b.column("s")):
            v = np.asarray(s.values)
            acc[i, kind] = acc[i, kind] + v if (i, kind) in acc else v.copy()
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in acc], pa.int32()), pa.array([k[1] for k in acc], pa.int32()), pa.array(list(acc.values()), pa.list_(pa.float64()))], ["i", "kind", "s"])


def correlation_matrix(df: DataFrame, cols=None, strict: bool = False, missing: str = "complete") -> DataFrame:
    """Long result ``(col_i, col_j, corr)`` with p * p rows; the diagonal is 1 (0 for a constant column)."""
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    cols = resolve(df, cols, strict)
    if not cols:
        raise ValueError("no numeric columns to correlate")
    p, pairwise = len(cols), missing == "pairwise"
    # One array column per row: p separate aliased, NULL-filtered columns make
    # the optimizer's constraint inference grow with p.
    row = F.array(*[F.expr(f"CAST({value_sql(df, c)} AS DOUBLE)") for c in cols])
    x = df.select(row.alias("v"))
    if not pairwise:
        x = x.where(~F.exists("v", lambda e: e.isNull()))
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    folded = x.coalesce(tasks).mapInArrow(lambda it: _ranges(it, p), "k int, n bigint, s double, lo double, hi double")
    stats = folded.groupBy("k").agg((F.sum("s") / F.sum("n")).alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    means, const = np.zeros(p), [True] * p
    for r in stats:  # p rows
        means[r.k], const[r.k] = r.m or 0.0, r.lo is None or r.lo == r.hi
    checkpoint_root(df.sparkSession)
    ddl = "i int, kind int, s array<double>"
    sums = x.coalesce(tasks).mapInArrow(lambda it: _gram(it, means, pairwise), ddl).repartition(min(p, tasks), "i").mapInArrow(_add, ddl).checkpoint()
    cells = sums.where("kind = 0").select("i", F.posexplode("s").alias("j", "xy"))
    if pairwise:
        def of(kind, names):
            return sums.where(f"kind = {kind}").select("i", F.posexplode("s").alias("j", "s")).select(*names, "s")

        for kind, name in ((1, "x"), (2, "xx"), (3, "n")):
            cells = cells.join(of(kind, ["i", "j"]).withColumnRenamed("s", name), ["i", "j"])
        for kind, name in ((1, "y"), (2, "yy")):  # the same for the pair's other side
            cells = cells.join(of(kind, [F.col("j").alias("i"), F.col("i").alias("j")]).withColumnRenamed("s", name), ["i", "j"])
        vx, vy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
        sxy = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
        flat = (F.col("n") < 2) | (vx <= NOISE * F.col("xx")) | (vy <= NOISE * F.col("yy"))
    else:
        diag = cells.where("i = j").select(F.col("i").alias("k"), F.col("xy").alias("d"))
        cells = (cells.join(diag.withColumnsRenamed({"k": "i", "d": "di"}), "i").join(diag.withColumnsRenamed({"k": "j", "d": "dj"}), "j"))
        vx, vy, sxy = F.col("di"), F.col("dj"), F.col("xy")
        flat = (vx <= 0) | (vy <= 0)
    flags, names = F.array(*[F.lit(c) for c in const]), F.array(*[F.lit(c) for c in cols])
    zero = F.get(flags, F.col("i")) | F.get(flags, F.col("j")) | flat
    r = F.when(zero, F.lit(0.0)).when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(sxy / F.sqrt(vx * vy))
    return cells.select(F.get(names, F.col("i")).alias("col_i"), F.get(names, F.col("j")).alias("col_j"), r.alias("corr"))
