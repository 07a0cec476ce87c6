"""Access to the driver tables and result tidying shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Numeric lineitem columns used by the whole-table aggregates.
LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# A literal column added beside them gives the zero-variance cases.
CONST_COL = "k_const"
CONST_VALUE = 7.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_numeric(spark: SparkSession, sf_dir: str, with_const: bool = True) -> DataFrame:
    cols = [F.col(c) for c in LINEITEM_NUMERIC]
    if with_const:
        cols.append(F.lit(CONST_VALUE).alias(CONST_COL))
    return table(spark, sf_dir, "lineitem").select(*cols)


SIG_DIGITS = 10


def quote(name: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def sig_round_sql(x: str, digits: int = SIG_DIGITS) -> str:
    """Round a double to ``digits`` significant digits (SQL text).

    Sums of doubles depend on the order partitions are combined in, so
    results are compared at 10 significant digits. Scaling by an exact power
    of ten and rounding half away from zero is done the same way in the SQL
    twin (``registry.rnd``); ``+ 0.0`` turns -0.0 into 0.0.
    """
    x = f"CAST({x} AS DOUBLE)"
    e = f"({digits - 1} - floor(log10(abs({x}))))"
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} = 0 OR abs({x}) = double('infinity') THEN {x} + 0.0D "
            f"WHEN {e} >= 0 THEN round({x} * pow(10.0D, {e}), 0) / pow(10.0D, {e}) + 0.0D "
            f"ELSE round({x} / pow(10.0D, -{e}), 0) * pow(10.0D, -{e}) + 0.0D END")


def fixed_round_sql(x: str, decimals: int) -> str:
    """Round to ``decimals`` places by scaling with an exact power of ten.

    For values of bounded size (z-scores, correlations) whose relative error
    grows near zero. Same operations as ``registry.rnd_fixed``.
    """
    scale = float(10 ** decimals)
    return f"round(CAST({x} AS DOUBLE) * {scale!r}D, 0) / {scale!r}D + 0.0D"


def sig_round(c: str, digits: int = SIG_DIGITS) -> Column:
    return F.expr(sig_round_sql(quote(c), digits))


def tidy(df: DataFrame, digits: int = SIG_DIGITS, decimals: int | None = None) -> DataFrame:
    """Round every floating column for comparison: to ``digits`` significant
    digits, or to ``decimals`` places when given. One ``selectExpr``."""
    out = []
    for f in df.schema.fields:
        q = quote(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            r = fixed_round_sql(q, decimals) if decimals is not None else sig_round_sql(q, digits)
            out.append(f"{r} AS {q}")
        else:
            out.append(q)
    return df.selectExpr(*out)
