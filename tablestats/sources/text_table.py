"""Comma-separated text tables in and out.

Two read modes:

* ``read_table(..., exact=False)``: Spark's CSV reader (quotes honoured,
  blank lines dropped, short rows padded) - the fast default.
* ``exact=True``: the source programs' parser: every line is stripped and
  split on ``,`` with no quote handling; a blank line is a row with one
  empty cell; cells are typed per cell (``cells.infer_cell``) and the column
  type is chosen by ``cells.infer_schema_profile``.

In exact mode the first line of every file is its header. It is told by the
stream of lines itself: a task reads a file's splits in order, so the first line
that comes with the file's block at offset 0 is the header. One pass over the text
marks headers and gives the lines; with a declared schema that is all that is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablestats.operators.chunks import POSITION, placed
from tablestats.sources.cells import infer_cell, infer_schema_profile, py_strip, typed_columns

def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number in the block, and a flag on the first of each file."""
    last, lines = (None, None), 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        path, block = b.column("file_path"), b.column("block")
        new = np.ones(n, bool)
        if n > 1:
            same = pc.and_(pc.equal(path.slice(1), path.slice(0, n - 1)), pc.equal(block.slice(1), block.slice(0, n - 1)))
            new[1:] = ~same.to_numpy(zero_copy_only=False)
        new[0] = (path[0].as_py(), block[0].as_py()) != last
        # Numbers start anew with each block; those of a block that goes on, where it stopped.
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, -1))
        line = np.where(start < 0, at + lines, at - start)
        last, lines = (path[-1].as_py(), block[-1].as_py()), int(line[-1]) + 1
        header = (line == 0) & pc.equal(block, 0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([path, block, pa.array(line, pa.int64()), b.column("value"), pa.array(header)], ["file_path", "block", "line", "value", "is_header"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines with ``is_header`` (first line of its file), ``file_path``, ``block`` and ``line``; one pass."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), "value")
    return raw.mapInArrow(_mark, "file_path string, block bigint, line bigint, value string, is_header boolean")


def split_cells(line) -> F.Column:
    """``line.strip().split(',')`` - no quotes, empty cells kept."""
    return F.split(py_strip(line), ",", -1)


def header_cells(spark: SparkSession, path: str) -> list[str]:
    """A4: the header of the first file (in name order) that holds a line, stripped and split.

    Reads one line of one file; the body never reaches the driver. Empty files, as a
    writer's task without rows leaves them, have no header.
    """
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise FileNotFoundError(path)
    for file in files:
        first = spark.read.text(file).first()
        if first is not None:
            return [c.strip() for c in first.value.strip().split(",")]
    return []


def read_cells(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Body lines as ``cells array<string>`` plus ``file_path``.

    ``chunks.with_row_index`` and what rests on it take the result in file order without a sort.
    """
    lines = _body(spark, path, header)
    return placed(lines.select("file_path", "cells"), lines.select("file_path", "cells", *POSITION))


def _body(spark: SparkSession, path: str, header: bool) -> DataFrame:
    lines = read_lines(spark, path)
    if header:  # a file's first block counts from the line after it
        lines = lines.where(~F.col("is_header")).withColumn("line", F.col("line") - (F.col("block") == 0).cast("bigint"))
    return lines.select("file_path", split_cells(F.col("value")).alias("cells"), F.col("file_path").alias("_file"), F.col("block").alias("_block"), F.col("line").alias("_line"))


def read_table(spark: SparkSession, path: str, schema=None, exact: bool = False, header: bool = True,
               strict: bool = False, positions: bool = False) -> DataFrame:
    """A1: read a comma-separated table with a header row.

    ``schema`` (DDL string or StructType) is honoured in both modes and skips
    inference. In exact mode without a schema the column types come from one
    aggregate over the cells (a p-row result), so the text is read twice; with
    one, once. ``strict`` makes the fast mode fail on malformed lines, and the
    exact mode on rows of the wrong width and on cells that are not of their
    column's type. In exact mode rows know their place: chunks and slices in input
    order of the result need no sort. ``positions`` keeps the place as columns
    (``POSITION``), so that this also holds for a projection of the result.
    """
    if positions and not exact:
        raise ValueError("positions are known in exact mode only")
    if not exact:
        reader = spark.read.option("header", header).option("escape", '"').option("mode", "FAILFAST" if strict else "PERMISSIVE")
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    body = _body(spark, path, header)
    digits = None
    if schema is not None:
        st = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        names, types = [f.name for f in st.fields], [f.dataType.simpleString() for f in st.fields]
    else:
        names = header_cells(spark, path) if header else None
        found = infer_schema_profile(body).collect()
        prof, digits = {r.pos: r.col_type for r in found}, {r.pos: r.digits for r in found}
        if names is None:
            names = [f"c{k}" for k in range(len(prof))]
        types = [prof.get(k, "string") for k in range(len(names))]
    if strict:
        body = body.withColumn("cells", F.when(F.size("cells") == len(names), F.col("cells"))
                               .otherwise(F.raise_error(F.lit("row width differs from the header")).cast("array<string>")))
    whole = typed_columns(body, names, types, strict=strict, keep=POSITION, digits=digits)
    return whole if positions else placed(whole.drop(*POSITION), whole)


def matrix_layout(long: DataFrame, names: list[str], row: str = "col_i", col: str = "col_j", value: str = "corr") -> DataFrame:
    """A5: a long matrix as one row per ``row`` value in the order of ``names``, one column per name."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(row))
    cells = [F.max(F.when(F.col(col) == n, F.col(value))).alias(n) for n in names]
    return long.groupBy(at.alias("row")).agg(*cells)


def labelled_layout(vectors: dict[str, DataFrame]) -> DataFrame:
    """A5: one-row results as rows ``label, value per column``, e.g. min and max."""
    out = None
    for k, (label, df) in enumerate(vectors.items()):
        row = df.select(F.lit(k + 1).alias("row"), F.lit(label).alias("label"), *df.columns)
        out = row if out is None else out.unionByName(row)
    return out


def pixel_layout(df: DataFrame, px: str, size: int, keep=()) -> DataFrame:
    """A5: pixel arrays as columns ``p1..pN``, N = size * size."""
    return df.select(*keep, *[F.get(F.col(px), k).alias(f"p{k + 1}") for k in range(size * size)])


def write_table(df: DataFrame, path: str, header: bool = True, order_by=None, line_sep: str = "\r\n",
                mode: str = "overwrite", python_floats: bool = True) -> None:
    """A5: write rows as CSV the way Python's ``csv.writer`` does.

    CRLF line ends, minimal quoting with doubled quotes, empty strings and
    NULLs as empty fields, no whitespace trimming, and (``python_floats``)
    floats printed like Python's ``str`` (``1e+16``, ``0.0001``, ``nan``).
    ``order_by`` sorts first (range partitioning, so part files follow the
    order). Each part file carries its own header line, which ``read_table``
    expects.
    """
    if order_by is not None:
        df = df.orderBy(order_by)
    if python_floats:
        from tablestats.functions.scalar import with_python_float_text
        df = with_python_float_text(df, [f.name for f in df.schema.fields
                                         if isinstance(f.dataType, (T.DoubleType, T.FloatType))])
    (df.write.mode(mode)
       .option("header", header)
       .option("lineSep", line_sep)
       .option("quote", '"').option("escape", '"')
       .option("emptyValue", "").option("nullValue", "")
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def table_footprint(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(rows, bytes, columns)`` for a text dataset.

    ``rows`` counts lines, ``bytes`` sums the file sizes, ``columns`` is the
    comma-separated cell count of the first line of the first file.
    """
    files = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"),
                                         F.col("_metadata.file_size").alias("size"))
    stats = files.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")) \
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    cols = len(header_cells(spark, path))
    return stats.select("rows", "bytes", F.lit(cols).cast("bigint").alias("columns"))


__all__ = ["read_table", "read_lines", "read_cells", "header_cells", "write_table", "table_footprint",
           "split_cells", "infer_cell", "matrix_layout", "labelled_layout", "pixel_layout"]
