"""Casts, filters and per-row reshaping. All but the ragged lists are narrow (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablestats.operators.chunks import _PLACED, POSITION, with_row_index


def cast_numeric_strict(df: DataFrame, cols=None) -> DataFrame:
    """B1: every cell ``float(x)``; a cell that is not a number raises (ANSI cast)."""
    cols = cols or df.columns
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def cast_numeric_coerce_drop(df: DataFrame, cols=None) -> DataFrame:
    """B2: non-numbers become NULL (``try_cast``) and rows with one are dropped."""
    cols = cols or df.columns
    out = df.select(*[F.col(c).try_cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])
    return out.dropna(how="any", subset=list(cols))


def cast_cells_strict(cells: Column) -> Column:
    """B1 on an ``array<string>`` of cells."""
    return F.transform(cells, lambda c: c.cast("double"))


def filter_above(df: DataFrame, cols, threshold, ids=(), name_col: str = "col_name",
                 value_col: str = "v") -> DataFrame:
    """Per column, the values strictly above ``threshold``, as long rows.

    ``(ids..., col_name, v)``; the ragged per-column lists of the source are
    these rows grouped by ``col_name`` in ``ids`` order. They are not
    collected into arrays: one list per column would hold a whole column in
    one row.
    """
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    long = typed.unpivot(list(ids), list(cols), name_col, value_col)
    v = F.col(value_col)
    return long.where(v.isNotNull() & ~F.isnan(v) & (v > F.lit(threshold)))


def filter_above_lists(df: DataFrame, cols, threshold, order_by, ids=(), name_col: str = "col_name", pos_col: str = "pos", value_col: str = "v",
                       block_rows: int | None = None) -> DataFrame:
    """B4 as the ragged lists themselves: per column, the values strictly above ``threshold`` in row order.

    ``(ids..., col_name, pos, v)``: ``pos`` is the value's 0-based place in its
    column's filtered list; rows are in ``order_by`` order, by default (None) in input order.

    Row numbers cut the table into blocks of ``block_rows`` rows (about the square root of the
    row count). A value's place is its place among the passing values of its column and block,
    plus those of the blocks before: windows over at most a block's rows, and over one row per
    block. Only passing values are shuffled, once.
    """
    plain = df.select(*ids, *[c for c in cols if c not in ids], *[c for c in POSITION if c in df.columns])
    indexed = with_row_index(plain if order_by is not None or not hasattr(df, _PLACED) else df, order_by, "_row", "_rows")
    size = F.lit(block_rows) if block_rows else F.greatest(F.ceil(F.sqrt(F.col("_rows"))), F.lit(1))
    rows = indexed.withColumn("_at", F.floor(F.col("_row") / size).cast("bigint"))
    long = filter_above(rows, cols, threshold, [*ids, "_row", "_at"], name_col, value_col)
    block, column = Window.partitionBy(name_col, "_at"), Window.partitionBy(name_col)
    long = long.withColumn("_in", F.row_number().over(block.orderBy("_row")))
    # Counted on the rows that are already dealt out by column and block.
    held = long.groupBy(name_col, "_at").agg(F.max("_in").cast("bigint").alias("_n"))
    before = F.coalesce(F.sum("_n").over(column.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(name_col, "_at", before.alias("_before"))
    return long.join(starts, [name_col, "_at"]).select(*ids, name_col, (F.col("_before") + F.col("_in") - 1).alias(pos_col), value_col)


def row_length_filter(df: DataFrame, cells_col: str, length: int) -> DataFrame:
    """Keep rows whose cell list has exactly ``length`` entries."""
    return df.where(F.size(cells_col) == F.lit(length))


def cell_arith(cell: Column) -> Column:
    """``str(int(cell) + 1)``."""
    return (cell.cast("long") + F.lit(1)).cast("string")


def row_fanout(df: DataFrame, cols, seq_col: str = "seq") -> DataFrame:
    """Each row becomes two: ``[int(c0) + 1]`` (other cells NULL), then the row.

    ``seq`` (0, 1) keeps the order of the pair; with a row key, ``(key, seq)``
    orders the whole output. Done with ``inline`` over a two-element array,
    so it stays a narrow projection.
    """
    cols = list(cols)
    first = F.struct(F.lit(0).alias(seq_col), cell_arith(F.col(cols[0])).alias(cols[0]),
                     *[F.lit(None).cast("string").alias(c) for c in cols[1:]])
    second = F.struct(F.lit(1).alias(seq_col), *[F.col(c).cast("string").alias(c) for c in cols])
    others = [c for c in df.columns if c not in cols]
    return df.select(*others, F.inline(F.array(first, second)))


def project_case(branches, otherwise=None) -> Column:
    """``if/elif/else`` per row: ``branches`` is a list of (condition, value)."""
    out = None
    for cond, val in branches:
        val = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    if otherwise is not None:
        out = out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
    return out
