"""A2/A3: Python-style per-cell type inference, as column expressions.

The source programs parse every cell with ``int(x)``, else ``float(x)``,
else keep ``x.strip()``. Spark's casts accept a different language (``1d``
parses, ``1_000`` does not), so each cell is first matched against Python's
number grammar and only then cast. The grammar regexes below are written in
the common subset of Java and RE2 syntax, so the SQL oracle uses them as is.

A cell becomes ``struct(kind, i, d, s, n)``: ``kind`` is int/float/str; ``i``
the bigint value (NULL when an int does not fit 64 bits), ``d`` the double
value of int and float cells, ``s`` the stripped text of str cells, ``n`` the
exact value of an int cell of up to 38 digits (``decimal(38,0)``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestats.operators.bigints import canonical
from tablestats.operators.columns import BIG_INTEGER

# Python's ASCII whitespace and number grammar for int() / float().
WS = "[ \\t\\n\\x0B\\f\\r]"
DIGITS = "[0-9]+(_[0-9]+)*"
INT_RE = f"^{WS}*[+-]?{DIGITS}{WS}*$"
FLOAT_RE = (f"^{WS}*[+-]?(({DIGITS})?\\.{DIGITS}|{DIGITS}\\.?)([eE][+-]?{DIGITS})?{WS}*$")
SPECIAL_RE = f"^{WS}*[+-]?(?i:inf|infinity|nan){WS}*$"
STRIP_RE = f"^{WS}+|{WS}+$"


_WS_CHARS = " \t\n\x0b\f\r"
# Plain cells, told without the whole grammar; Spark's casts read them as Python does.
_PLAIN_INT, _PLAIN_DECIMAL = "^[+-]?[0-9]{1,18}$", "^[+-]?[0-9]{1,38}$"
_PLAIN_FLOAT = "^[+-]?[0-9]{1,17}([.][0-9]{1,17})?$"


def py_strip(c: Column) -> Column:
    """``str.strip()`` for ASCII whitespace (Spark's ``trim`` only removes spaces)."""
    return F.trim(c, F.lit(_WS_CHARS))


def _special(stripped: Column) -> Column:
    low = F.lower(stripped)
    return (F.when(low.endswith("nan"), F.lit(float("nan")))
            .when(low.startswith("-"), F.lit(float("-inf")))
            .otherwise(F.lit(float("inf"))))


#: Kinds of cells, as ``kind_code`` numbers them.
INT, FLOAT, SPECIAL, STR = 1, 2, 3, 4


def kind_code(c: Column) -> Column:
    """The kind of a cell, each grammar tried once: int, float, inf or nan, text; NULL for NULL."""
    return (F.when(c.isNull(), F.lit(None).cast("int")).when(c.rlike(INT_RE), INT).when(c.rlike(FLOAT_RE), FLOAT)
            .when(c.rlike(SPECIAL_RE), SPECIAL).otherwise(STR))


def infer_cell(c: Column) -> Column:
    """A2: the cell as ``struct(kind string, i bigint, d double, s string, n decimal(38,0))``."""
    stripped = py_strip(c)
    seen = F.struct(kind_code(c).alias("k"), stripped.alias("t"), F.replace(stripped, F.lit("_"), F.lit("")).alias("p"))

    def of(x: Column) -> Column:
        k, t, plain = x["k"], x["t"], x["p"]
        return F.struct(
            F.when(k == INT, F.lit("int")).when(k == STR, F.lit("str")).when(k.isNotNull(), F.lit("float")).alias("kind"),
            F.when(k == INT, plain.try_cast("bigint")).alias("i"),
            F.when(k == SPECIAL, _special(t)).when(k != STR, plain.try_cast("double")).alias("d"),
            F.when(k == STR, t).alias("s"),
            F.when(k == INT, plain.try_cast("decimal(38,0)")).alias("n"))

    # A list of one, so that kind and text are worked out once for all five fields.
    return F.transform(F.array(seen), of)[0]


def infer_cells(cells: Column) -> Column:
    """A2 over an ``array<string>`` of cells."""
    return F.transform(cells, infer_cell)


#: Sizes of an int cell: up to 64 bits, up to 38 digits, beyond.
_SMALL, _BIG, _HUGE = 1, 2, 3


def infer_schema_profile(df: DataFrame, cells_col: str = "cells") -> DataFrame:
    """A3: per column position, the number of int/float/str cells and the type to use.

    Widest rule: any str -> string, else any float -> double (string beside an int of
    more than 38 digits, so no cell is lost), else any int of more than 38 digits -> integer (text of
    ``digits`` digits, see ``bigints``), else any beyond 64 bits -> decimal(38,0), else bigint.
    ``n_big`` and ``n_huge`` count the two kinds of long ints. Each cell is classified once, nothing is
    cast but ints of 19 digits and more; one aggregate keyed by position and class.
    """
    long = df.select(F.posexplode_outer(cells_col).alias("pos", "cell")).where(F.col("pos").isNotNull())
    cell = F.col("cell")
    plain = F.replace(py_strip(cell), F.lit("_"), F.lit(""))
    size = F.when(F.length(cell) < 19, _SMALL).when(plain.try_cast("bigint").isNotNull(), _SMALL).when(plain.try_cast("decimal(38,0)").isNotNull(), _BIG).otherwise(_HUGE)
    coded = long.select("pos", "cell", F.when(cell.rlike(_PLAIN_INT), INT).otherwise(kind_code(cell)).alias("k"))
    coded = coded.select("pos", "k", F.when(F.col("k") == INT, F.struct(size.alias("size"), F.length(F.regexp_replace(cell, "[^0-9]", "")).alias("digits"))).alias("x"))
    counts = coded.groupBy("pos", "k", "x.size").agg(F.count(F.lit(1)).alias("n"), F.max("x.digits").alias("digits"))

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint").alias(name)

    k, size = F.col("k"), F.col("size")
    prof = counts.groupBy("pos").agg(
        total(k == INT, "n_int"), total(k.isin(FLOAT, SPECIAL), "n_float"), total(k == STR, "n_str"),
        total((k == INT) & (size == _BIG), "n_big"), total((k == INT) & (size == _HUGE), "n_huge"), F.max("digits").alias("digits"))
    huge = F.col("n_huge") > 0
    col_type = (F.when((F.col("n_str") > 0) | huge & (F.col("n_float") > 0), F.lit("string")).when(huge, F.lit("integer")).when(F.col("n_float") > 0, F.lit("double"))
                .when(F.col("n_big") > 0, F.lit("decimal(38,0)")).otherwise(F.lit("bigint")))
    return prof.withColumn("col_type", col_type)


def typed_cell(cell: Column, kind: str) -> Column:
    """A text cell as a value of a SQL type, or of ``integer``, canonical text of any length; NULL where it is not one."""
    if kind == "integer":
        return F.when(cell.rlike(INT_RE), canonical(cell))
    if kind == "string":
        return py_strip(cell)
    info = infer_cell(cell)
    if kind == "bigint":
        return F.when(cell.rlike(_PLAIN_INT), cell.try_cast("bigint")).otherwise(info["i"])
    if kind == "decimal(38,0)":
        return F.when(cell.rlike(_PLAIN_DECIMAL), cell.try_cast("decimal(38,0)")).otherwise(info["n"])
    if kind in ("int", "smallint", "tinyint"):
        return F.when(cell.rlike(_PLAIN_INT), cell.try_cast(kind)).otherwise(info["n"].try_cast(kind))
    if kind in ("double", "float"):
        return F.when(cell.rlike(_PLAIN_FLOAT), cell.try_cast("double")).otherwise(info["d"]).cast(kind)
    return py_strip(cell).try_cast(kind)


def typed_columns(df: DataFrame, names: list[str], types: list[str], cells_col: str = "cells",
                  keep=(), strict: bool = False, digits: dict | None = None) -> DataFrame:
    """Turn a cells array into typed, named columns (cell i -> ``names[i]``).

    ``digits``: of ``integer`` columns, the most digits of a value, by position.

    Missing cells of short rows and empty cells of columns that are not text are
    NULL, extra cells are ignored. A cell that is not of its column's type is NULL,
    or raises with ``strict``.
    """
    out = [F.col(c) for c in keep]
    for k, (name, kind) in enumerate(zip(names, types)):
        cell = F.get(F.col(cells_col), k)
        v = typed_cell(cell, kind)
        if strict and kind != "string":
            wrong = F.concat(F.lit(f"column {name}: not {kind}: "), cell)
            v = F.when(v.isNull() & (py_strip(cell) != ""), F.raise_error(wrong).cast(kind)).otherwise(v)
        out.append(v.alias(name, metadata={BIG_INTEGER: (digits or {})[k]}) if kind == "integer" else v.alias(name))
    return df.select(*out)
