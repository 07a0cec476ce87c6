"""Whole-table column aggregates (D1-D8) and the one-scan column profile.

Every function plans a single ``agg`` over all requested columns, so Spark
runs one scan with a partial aggregate per task and a final aggregate over
one row per task; no column is scanned twice and nothing is shuffled by key.

Semantics (fixed by the source programs and their pandas twins):
* NaN is skipped like NULL (see ``columns.value``); NULL is skipped.
* ``count_above`` / ``mean_above`` use a strict ``>``; the mean is 0 when no
  value passes.
* Standard deviation is the population one (``ddof=0``).
* ``constant_columns`` is 1 when every row holds the same value, a NULL
  counting as a value; all-NULL and single-row columns are constant.
* Sums of integer columns are exact (``decimal(38,0)``), since ANSI ``sum`` of
  ``bigint`` raises on overflow and the source language has unbounded ints.
* Integers of any length, held as text in columns marked by the reader (``bigints``),
  are summed and compared as integers; sums, minima and maxima come back as text.
* Sums of doubles depend on the order they are added in, in the last digits; with
  ``exact=True`` sum, mean and deviation are those of ``exact``: rounded once, the same
  for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestats.operators.bigints import big_digits, big_extreme, big_mean, big_sum
from tablestats.operators.columns import FRACTIONAL, is_integral, resolve, value, value_sql
from tablestats.operators.exact import exact_columns

DEFAULT_THRESHOLD = 20


def _rows() -> Column:
    return F.count(F.lit(1))


def sum_expr(df: DataFrame, c: str) -> Column:
    if digits := big_digits(df, c):
        return big_sum(F.col(c), digits)
    v = value(df, c)
    if is_integral(df, c):
        return F.sum(v.cast("decimal(38,0)"))
    return F.sum(v.cast("double"))


def mean_expr(df: DataFrame, c: str) -> Column:
    if digits := big_digits(df, c):
        return big_mean(F.col(c), digits)
    return F.avg(value(df, c).cast("double"))


def std_pop_expr(df: DataFrame, c: str) -> Column:
    return F.stddev_pop(value(df, c).cast("double"))


def count_above_expr(df: DataFrame, c: str, threshold) -> Column:
    return F.count_if(value(df, c) > F.lit(threshold))


def mean_above_expr(df: DataFrame, c: str, threshold) -> Column:
    v = value(df, c).cast("double")
    return F.coalesce(F.avg(F.when(v > F.lit(threshold), v)), F.lit(0.0))


def constant_expr(df: DataFrame, c: str) -> Column:
    """1/0 flag; min = max rather than variance = 0 (floating noise), NULL on an empty table."""
    v = value(df, c)
    n_rows, n_vals = _rows(), F.count(v)
    return (F.when(n_rows == 0, F.lit(None).cast("int"))
            .when(n_vals == 0, F.lit(1))
            .when((n_vals == n_rows) & (F.min(v) == F.max(v)), F.lit(1))
            .otherwise(F.lit(0)))


def _wide(df: DataFrame, cols, make) -> DataFrame:
    if not cols:
        raise ValueError("no columns of a suitable type to aggregate")
    return df.agg(*[make(c).alias(c) for c in cols])


def _exactly(df: DataFrame, cols: list[str], field: str, make) -> DataFrame:
    """One row: ``field`` of the exact statistics for floating columns, ``make`` for the others, in the order of ``cols``."""
    if not cols:
        raise ValueError("no columns of a suitable type to aggregate")
    floating = [c for c in cols if isinstance(df.schema[c].dataType, FRACTIONAL)]
    others = [c for c in cols if c not in floating]
    if not floating:
        return _wide(df, cols, make)
    out = exact_columns(df, floating, field)
    if others:
        rest = df.agg(F.struct(*[make(c).alias(c) for c in others]).alias("s")).scalar()
        out = out.withColumn("_rest", rest).select(*[F.col(c) if c in floating else F.col("_rest")[c].alias(c) for c in cols])
    return out


def column_sum(df: DataFrame, cols=None, strict: bool = False, exact: bool = False) -> DataFrame:
    """One row, one sum per column, named like the column (the header echo)."""
    cols = resolve(df, cols, strict, big_ok=True)
    make = lambda c: sum_expr(df, c)
    return _exactly(df, cols, "sum", make) if exact else _wide(df, cols, make)


def column_mean(df: DataFrame, cols=None, strict: bool = False, exact: bool = False) -> DataFrame:
    """Mean per column."""
    cols = resolve(df, cols, strict, big_ok=True)
    make = lambda c: mean_expr(df, c)
    return _exactly(df, cols, "mean", make) if exact else _wide(df, cols, make)


def _extreme(df: DataFrame, c: str, largest: bool) -> Column:
    return big_extreme(F.col(c), largest) if big_digits(df, c) else (F.max if largest else F.min)(value(df, c))


def column_min(df: DataFrame, cols=None, strict: bool = False) -> DataFrame:
    """D3: minimum per column; integer columns keep their type."""
    cols = resolve(df, cols, strict, text_ok=True, big_ok=True)
    return _wide(df, cols, lambda c: _extreme(df, c, False))


def column_max(df: DataFrame, cols=None, strict: bool = False) -> DataFrame:
    """Maximum per column."""
    cols = resolve(df, cols, strict, text_ok=True, big_ok=True)
    return _wide(df, cols, lambda c: _extreme(df, c, True))


def column_std_pop(df: DataFrame, cols=None, strict: bool = False, exact: bool = False) -> DataFrame:
    """Population standard deviation per column (one row gives 0.0)."""
    cols = resolve(df, cols, strict)
    if exact:
        return exact_columns(df, cols, "std_pop") if cols else _wide(df, cols, None)
    return _wide(df, cols, lambda c: std_pop_expr(df, c))


def count_above(df: DataFrame, cols=None, threshold=DEFAULT_THRESHOLD, strict: bool = False) -> DataFrame:
    """Number of values strictly above ``threshold`` per column."""
    cols = resolve(df, cols, strict)
    return _wide(df, cols, lambda c: count_above_expr(df, c, threshold))


def mean_above(df: DataFrame, cols=None, threshold=DEFAULT_THRESHOLD, strict: bool = False) -> DataFrame:
    """Mean of the values strictly above ``threshold``, 0 when none is."""
    cols = resolve(df, cols, strict)
    return _wide(df, cols, lambda c: mean_above_expr(df, c, threshold))


def constant_columns(df: DataFrame, cols=None, strict: bool = False) -> DataFrame:
    """1 for a column whose rows all hold one value, else 0."""
    cols = resolve(df, cols, strict, text_ok=True)
    return _wide(df, cols, lambda c: constant_expr(df, c))


PROFILE_FIELDS = ["n", "sum", "min", "max", "mean", "count_above", "mean_above", "std_pop", "is_const"]
#: Columns profiled by one row of the aggregate: its 11 buffers a column stay
#: below 100 fields, where whole-stage code generation works and pays.
GROUP_COLUMNS = 8


def column_profile(df: DataFrame, cols=None, threshold=DEFAULT_THRESHOLD, strict: bool = False) -> DataFrame:
    """D1-D8 for every column in one scan, returned long: one row per column.

    Output ``(col_name, n, sum, min, max, mean, count_above, mean_above,
    std_pop, is_const)``; ``sum/min/max`` are doubles here so that the rows
    share one type. Whether a column is constant is decided on its own type,
    by a hash of the value that is one-to-one for 64-bit values, so integers
    beyond 2^53 are told apart.

    A row is dealt out as one row per ``GROUP_COLUMNS`` columns, and one
    aggregate by group computes all statistics of a group's columns, so the
    generated code is the same for 5 and for 5,000 columns.
    """
    cols = resolve(df, cols, strict)
    if not cols:
        raise ValueError("no numeric columns to profile")
    t = f"CAST({threshold!r} AS DOUBLE)"
    width = min(GROUP_COLUMNS, len(cols))
    groups = [cols[i:i + width] for i in range(0, len(cols), width)]
    # v_k: the values as doubles; h_k: their hashes (NULL for a missing value).
    flat, tuples = [], []
    for g, names in enumerate(groups):
        for k in range(width):
            v = value_sql(df, names[k]) if k < len(names) else None
            flat.append(f"CAST({v or 'NULL'} AS DOUBLE) AS v_{g}_{k}")
            flat.append(f"CASE WHEN {v} IS NOT NULL THEN xxhash64({v}) END AS h_{g}_{k}" if v else f"CAST(NULL AS BIGINT) AS h_{g}_{k}")
        tuples.append("(" + ", ".join(f"v_{g}_{k}, h_{g}_{k}" for k in range(width)) + f") AS `{g}`")
    rows = df.selectExpr(*flat)
    if len(groups) > 1:
        out = ", ".join(f"v_{k}, h_{k}" for k in range(width))
        rows = df.sparkSession.sql(f"SELECT * FROM {{rows}} UNPIVOT INCLUDE NULLS (({out}) FOR g IN ({', '.join(tuples)}))", rows=rows)
    else:
        rows = rows.selectExpr("'0' AS g", *[f"{c}_0_{k} AS {c}_{k}" for k in range(width) for c in "vh"])
    aggs = ["count(1) AS _rows"]
    for k in range(width):
        v, h = f"v_{k}", f"h_{k}"
        aggs += [f"count({v}) AS _{k}_n", f"sum({v}) AS _{k}_sum", f"min({v}) AS _{k}_min", f"max({v}) AS _{k}_max",
                 f"count_if({v} > {t}) AS _{k}_ca", f"sum(CASE WHEN {v} > {t} THEN {v} END) AS _{k}_sa",
                 f"stddev_pop({v}) AS _{k}_sd", f"min({h}) AS _{k}_lo", f"max({h}) AS _{k}_hi"]
    wide = rows.groupBy("g").agg(*[F.expr(a) for a in aggs])
    if len(groups) == 1:  # one row also for an empty table
        wide = rows.agg(*[F.expr(a) for a in aggs]).selectExpr("'0' AS g", "*")
    else:
        empty = df.sparkSession.range(len(groups)).selectExpr("CAST(id AS STRING) AS g")
        wide = empty.join(wide, "g", "left")
    lists = F.array(*[F.array(*[F.lit(n) for n in names]) for names in groups])
    rows_n = "coalesce(_rows, 0)"
    structs = [
        f"named_struct('k', {k}, 'n', coalesce(_{k}_n, 0), 'sum', _{k}_sum, 'min', _{k}_min, 'max', _{k}_max, "
        f"'mean', _{k}_sum / nullif(_{k}_n, 0), 'count_above', coalesce(_{k}_ca, 0), "
        f"'mean_above', coalesce(_{k}_sa / nullif(_{k}_ca, 0), 0.0D), 'std_pop', _{k}_sd, "
        f"'is_const', CASE WHEN {rows_n} = 0 THEN CAST(NULL AS INT) WHEN _{k}_n = 0 THEN 1 "
        f"WHEN _{k}_n = {rows_n} AND _{k}_lo = _{k}_hi THEN 1 ELSE 0 END)" for k in range(width)]
    long = wide.selectExpr("g", f"inline(array({', '.join(structs)}))")
    name = F.get(F.get(lists, F.col("g").cast("int")), F.col("k"))
    return long.withColumn("col_name", name).where("col_name IS NOT NULL").select("col_name", *PROFILE_FIELDS)
