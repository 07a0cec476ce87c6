"""Global row positions, equal chunks, slices, concatenation, top-k.

The global 0-based row index is computed without moving the table into one
partition (what an unpartitioned ``row_number()`` window would do):

1. sort by the order columns (range-partitioned shuffle, sorted runs);
2. tag rows with ``monotonically_increasing_id`` - partition index in the
   upper 31 bits, position within the partition in the lower 33;
3. checkpoint to the shared checkpoint folder, so the tags survive a lost
   executor and every later use sees the same rows in the same place;
4. count rows per partition (one row per partition), turn the counts into
   start offsets, broadcast that table (its size is the partition count,
   checked) and add the offset to the in-partition position.

For input order (``order_by=None``) on whole Parquet files nothing is sorted or
written: a row's position in its file is known to the reader, and one count per
file gives the offsets. The same holds for text tables, whose lines are numbered within
the blocks they are read in (``placed``): one count per block. Project to the needed columns before indexing; the sorted
way writes what it is given.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablestats.functions.arrays import slice_bounds
from tablestats.session import checkpoint_root

_LOW_BITS = 33
#: Columns that say where a row of a text table lies: file, start of the block, number within the block.
POSITION = ("_file", "_block", "_line")
_PLACED = "_tablestats_placed"
MAX_BROADCAST_PARTITIONS = 1_000_000
MAX_FILES = 100_000


def _order_cols(df: DataFrame, order_by) -> list[Column]:
    """Sort columns; ``None`` means input order (``input_position``)."""
    if order_by is None:
        return input_position(df)
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def with_row_index(df: DataFrame, order_by, index_col: str = "row_index", total_col: str | None = None, within=None) -> DataFrame:
    """Add the 0-based position of each row in ``order_by`` order.

    ``order_by`` should be a total order (add key columns to break ties);
    rows that tie get positions in input order; ``None`` orders by input
    position, like a list index. That input position is also
    the last sort key, so the range partitioner can put boundaries inside a
    hot key value instead of sending all its rows to one task.
    ``total_col`` optionally adds the table's row count to every row. ``within``, a
    function of the row count, gives the indices (first, end) that are of interest: in input order
    whole Parquet files outside them are not read and their rows are left out.
    """
    if order_by is None:
        at = getattr(df, _PLACED, df)
        if set(POSITION) <= set(at.columns):
            return _by_block_position(at, index_col, total_col)
        if (found := _by_file_position(df, index_col, total_col, within)) is not None:
            return found
    checkpoint_root(df.sparkSession)
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    tagged = tie.orderBy(*_order_cols(df, order_by), "_tie").drop("_tie") \
        .withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), _LOW_BITS)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_cnt"))
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(prior), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy()).alias("_total"))
    if tagged.rdd.getNumPartitions() <= MAX_BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    joined = tagged.join(offsets, pid == F.col("_pid"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), _LOW_BITS)
    out = joined.withColumn(index_col, F.col("_off") + local)
    if total_col:
        out = out.withColumn(total_col, F.col("_total"))
    return out.drop("_mid", "_pid", "_off", "_total")


def placed(df: DataFrame, whole: DataFrame) -> DataFrame:
    """``df``, which remembers ``whole``, the same rows with the columns ``POSITION``, for ``order_by=None``."""
    setattr(df, _PLACED, whole)
    return df


def _by_block_position(df: DataFrame, index_col: str, total_col: str | None) -> DataFrame:
    """Input positions from the columns ``POSITION``, which are dropped.

    Blocks are counted in a pass of their own over the same files, one row per block is kept, and
    a row's index is its block's start plus its number there. Where rows have been left
    out, so that numbers have gaps, the rows are sorted by position.
    """
    file, block, line = POSITION
    checkpoint_root(df.sparkSession)
    blocks = df.groupBy(file, block).agg(F.count(F.lit(1)).alias("_n"), (F.max(line) + 1).alias("_end")).checkpoint()
    whole, total, count = blocks.agg(F.coalesce(F.bool_and(F.col("_n") == F.col("_end")), F.lit(True)), F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    if not whole:
        return with_row_index(df.withColumnsRenamed({file: "_f", block: "_b", line: "_l"}), ["_f", "_b", "_l"], index_col, total_col).drop("_f", "_b", "_l")
    if count <= MAX_FILES:
        held, at = [], 0
        for r in blocks.orderBy(file, block).collect():
            held.append((r[file], r[block], at))
            at += r["_n"]
        starts = F.broadcast(df.sparkSession.createDataFrame(held, "_f string, _b bigint, _off bigint"))
    else:  # one row per block still, in the order of the blocks
        before = F.sum("_n").over(Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1))
        starts = blocks.select(F.col(file).alias("_f"), F.col(block).alias("_b"), F.coalesce(before, F.lit(0)).alias("_off"))
    out = df.join(starts, (F.col(file) == F.col("_f")) & (F.col(block) == F.col("_b")), "left")
    # The files are split the same way in both passes, unless the split size was changed between them.
    off = F.coalesce("_off", F.raise_error(F.lit("the files were split differently when their lines were counted")).cast("bigint"))
    out = out.withColumn(index_col, off + F.col(line))
    if total_col:
        out = out.withColumn(total_col, F.lit(total).cast("long"))
    return out.drop(*POSITION, "_f", "_b", "_off")


def _by_file_position(df: DataFrame, index_col: str, total_col: str | None, within=None) -> DataFrame | None:
    """Input positions from the Parquet reader's own row numbers; None where ``df`` is not whole Parquet files."""
    own = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    try:
        placed = df.select("*", *own)
    except AnalysisException:  # not read from Parquet files
        return None
    per_file = df.select(*own).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), (F.max("_at") + 1).alias("_end"))
    per_file.persist()
    try:
        whole, files = per_file.agg(F.coalesce(F.bool_and(F.col("_n") == F.col("_end")), F.lit(True)), F.count(F.lit(1))).first()
        if not whole:  # rows were filtered out: positions have gaps
            return None
        rows = per_file.select("_file", "_n").orderBy("_file").collect() if files <= MAX_FILES else None
    finally:
        per_file.unpersist()
    if rows is None:
        return None
    starts, total = [], 0
    for r in rows:
        starts.append((r["_file"], total))
        total += r["_n"]
    if within is not None:
        first, end = within(total)
        stops = [at for _, at in starts[1:]] + [total]
        inside = [s for s, stop in zip(starts, stops) if s[1] < end and stop > first]
        if len(inside) < len(starts):
            # A condition on the path alone, which the scan applies to its list of files.
            starts = inside
            placed = df.where(F.col("_metadata.file_path").isin([f for f, _ in starts]) if starts else F.lit(False)).select("*", *own)
    offsets = df.sparkSession.createDataFrame(starts, "_file string, _off long")
    out = placed.join(F.broadcast(offsets), "_file").withColumn(index_col, F.col("_off") + F.col("_at"))
    if total_col:
        out = out.withColumn(total_col, F.lit(total).cast("long"))
    return out.drop("_file", "_at", "_off")


def chunk_size(n: Column, k: int) -> Column:
    """ceil(n / min(k, n)) - the reference's equal range length."""
    return F.ceil(n / F.least(F.lit(k), n)).cast("bigint")


def chunk_rows(df: DataFrame, k: int, order_by, chunk_col: str = "chunk_id", index_col: str = "row_index") -> DataFrame:
    """Split rows, in ``order_by`` order, into at most ``k`` half-open equal ranges.

    Range length is ceil(n / min(k, n)); the last range may be short and
    fewer than k ranges may result (n=10, k=6 gives 5 ranges of 2).
    """
    if k < 1:
        raise ValueError("k must be positive")
    indexed = with_row_index(df, order_by, index_col, total_col="_n")
    return indexed.withColumn(chunk_col, F.floor(F.col(index_col) / chunk_size(F.col("_n"), k)).cast("bigint")) \
        .drop("_n")


def chunk_ranges(chunked: DataFrame, chunk_col: str = "chunk_id", index_col: str = "row_index") -> DataFrame:
    """``(chunk_id, start_index, end_index)`` half-open ranges of a chunked table."""
    return chunked.groupBy(chunk_col).agg(F.min(index_col).alias("start_index"),
                                          (F.max(index_col) + 1).alias("end_index"))


def row_slice(df: DataFrame, order_by, lo=None, hi=None, step: int = 1, index_col: str = "row_index") -> DataFrame:
    """Rows ``[lo:hi:step]`` with Python slice semantics on the ordered table.

    Adds ``slice_pos``, the position in the sliced result (descending input
    order for a negative step). In input order of Parquet files only the files that
    hold rows of the slice are read.
    """
    if step == 0:
        raise ValueError("slice step cannot be zero")
    def within(n: int) -> tuple[int, int]:
        rows = range(n)[lo:hi:step]
        return (min(rows[0], rows[-1]), max(rows[0], rows[-1]) + 1) if rows else (0, 0)

    plain = all(x is None or isinstance(x, int) for x in (lo, hi))
    indexed = with_row_index(df, order_by, index_col, total_col="_n", within=within if plain else None)
    start, stop = slice_bounds(F.col("_n"), lo, hi, step)
    idx = F.col(index_col)
    if step > 0:
        keep = (idx >= start) & (idx < stop) & (F.pmod(idx - start, F.lit(step)) == 0)
        pos = F.floor((idx - start) / step)
    else:
        keep = (idx <= start) & (idx > stop) & (F.pmod(start - idx, F.lit(-step)) == 0)
        pos = F.floor((start - idx) / (-step))
    return indexed.where(keep).withColumn("slice_pos", pos.cast("bigint")).drop("_n")


def row_at(df: DataFrame, order_by, i: int, index_col: str = "row_index") -> DataFrame:
    """B9 with a single index: the row at Python position ``i`` (negative
    counts from the end); no row when out of range."""
    if i < 0:
        return row_slice(df, order_by, i, (i + 1) or None, 1, index_col)
    return row_slice(df, order_by, i, i + 1, 1, index_col)


def row_concat(*dfs: DataFrame, part_col: str = "part_id") -> DataFrame:
    """Concatenation in argument order (bag semantics, no dedup).

    ``part_col`` records which input a row came from; with a row index per
    input, ``(part_id, row_index)`` gives the concatenated order.
    """
    if not dfs:
        raise ValueError("nothing to concatenate")
    out = None
    for i, d in enumerate(dfs):
        d = d.withColumn(part_col, F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def input_position(df: DataFrame) -> list[Column]:
    """Columns giving each row's position in its input files.

    For file sources: ``(_metadata.file_path, _metadata.row_index)`` (row
    index exists for Parquet). Otherwise the row's position in the current
    partitioning, which is stable only for the same input splits.
    """
    for cols in (["_metadata.file_path", "_metadata.row_index"], ["_metadata.file_path"]):
        try:
            df.select(*cols).schema
            return [F.col(c) for c in cols]
        except AnalysisException:  # not a file source, or no row index for this format
            continue
    return [F.monotonically_increasing_id()]


def sort_top_k(df: DataFrame, by: str, k: int, tie_by=None, ascending: bool = True) -> DataFrame:
    """Stable ascending (or descending) sort by one field, first ``k`` rows.

    ``tie_by`` names the columns that decide ties; by default the input
    position (``input_position``), i.e. a stable sort. Planned as
    TakeOrderedAndProject: each task keeps only its best k.
    """
    if k < 0 or k != math.floor(k):
        raise ValueError("k must be a non-negative integer")
    first = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    ties = [F.asc(c) for c in tie_by] if tie_by is not None else [c.asc() for c in input_position(df)]
    return df.orderBy(first, *ties).limit(k)
