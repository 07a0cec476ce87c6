"""Column selection and value normalisation shared by the aggregate operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
#: Column metadata: text that holds integers of up to this many digits.
BIG_INTEGER = "big_integer"
NUMERIC = INTEGRAL + FRACTIONAL + (T.DecimalType,)


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, in schema order (pandas ``numeric_only``)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def select_numeric(df: DataFrame) -> DataFrame:
    """Restrict a table to its numeric columns; a projection, so the scan reads only those."""
    return df.select(*numeric_columns(df))


def resolve(df: DataFrame, cols: list[str] | None = None, strict: bool = False,
            text_ok: bool = False, big_ok: bool = False) -> list[str]:
    """Columns an aggregate runs over.

    ``None`` means every numeric column. Non-numeric columns are skipped, or
    raise with ``strict=True`` (the source programs fail on text cells).
    ``text_ok`` keeps string columns named in ``cols`` (min, max and the
    constant test are defined on text; strings order by code point). ``big_ok`` takes
    text columns that are marked as integers of any length (``bigints``).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = list(types) if cols is None else list(cols)
    missing = [c for c in wanted if c not in types]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    ok = NUMERIC + ((T.StringType,) if text_ok and cols is not None else ())
    big = {f.name for f in df.schema.fields if big_ok and BIG_INTEGER in f.metadata}
    bad = [c for c in wanted if not isinstance(types[c], ok) and c not in big]
    if bad and strict:
        raise TypeError(f"non-numeric columns: {bad}")
    return [c for c in wanted if c not in bad]


def is_integral(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, INTEGRAL)


def value(df: DataFrame, c: str) -> Column:
    """The column as seen by the aggregates: NaN becomes NULL for floating columns.

    Spark orders NaN above every number (so ``NaN > 20`` holds and ``max``
    returns NaN); the reference's comparisons and pandas skip it.
    """
    dt = df.schema[c].dataType
    col = F.col(c)
    if isinstance(dt, FRACTIONAL):
        col = col.cast("double")
        return F.nanvl(col, F.lit(None).cast("double"))
    return col


def as_double(df: DataFrame, c: str) -> Column:
    return value(df, c).cast("double")


def quote(name: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def value_sql(df: DataFrame, c: str) -> str:
    """SQL text of ``value``: building many expressions as text costs one
    JVM call each instead of one per operator."""
    if isinstance(df.schema[c].dataType, FRACTIONAL):
        return f"nanvl(CAST({quote(c)} AS DOUBLE), CAST(NULL AS DOUBLE))"
    return quote(c)
