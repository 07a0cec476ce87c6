"""Integers of any number of digits, as text.

The source programs have unbounded integers; Spark's largest is 38 digits. A column of
longer ones stays text, in canonical form (``-`` or nothing, no leading zeros), and is
marked in its metadata with the most digits a value has. Aggregates then work on
integers all the same, in the table's one aggregate:

* A sum adds limbs of ``LIMB`` digits as ``decimal(38,0)``, one column of sums per limb,
  each for up to 10^20 rows; the carries run once over the few totals.
* The smallest and largest value are found by (sign, length, digits), digits turned
  round for negative numbers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablestats.operators.columns import BIG_INTEGER

LIMB = 18


def big_digits(df: DataFrame, c: str) -> int:
    """The most digits of a marked column's values; 0 for a column that is not marked."""
    return int(df.schema[c].metadata.get(BIG_INTEGER, 0))


def canonical(text: Column) -> Column:
    """An integer cell as ``-`` or nothing and digits without leading zeros (sign, spaces and underscores as Python's int() takes them)."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.concat(F.when(F.contains(text, F.lit("-")) & (short != "0"), F.lit("-")).otherwise(F.lit("")), short)


def mark_big(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mark text columns of integers, in canonical form, with the digits they need (one aggregate); other text raises."""
    def digits(c: str) -> Column:
        ok = F.col(c).isNull() | F.rlike(c, F.lit(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"))
        bad = F.raise_error(F.concat(F.lit(f"column {c}: not an integer: "), F.col(c))).cast("int")
        return F.coalesce(F.max(F.when(ok, F.length(F.regexp_replace(c, "[^0-9]", ""))).otherwise(bad)), F.lit(1)).alias(c)

    most = df.agg(*[digits(c) for c in cols]).first()
    return df.select(*[canonical(F.col(c)).alias(c, metadata={BIG_INTEGER: most[c]}) if c in cols else F.col(c) for c in df.columns])


def _limbs(c: Column, digits: int) -> list[Column]:
    """Signed limbs of a canonical integer, lowest first."""
    count = -(-digits // LIMB)
    padded = F.lpad(F.regexp_replace(c, "^-", ""), count * LIMB, "0")
    sign = F.when(c.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    return [(padded.substr((count - 1 - k) * LIMB + 1, LIMB).cast("decimal(18,0)") * sign).cast("decimal(38,0)") for k in range(count)]


@F.pandas_udf(T.StringType())
def _joined(rows: pd.Series) -> pd.Series:
    """Totals of limbs, lowest first, as one integer."""
    def one(limbs) -> str | None:
        if limbs is None or any(x is None for x in limbs):
            return None
        return str(sum(int(x) * 10 ** (LIMB * k) for k, x in enumerate(limbs)))

    return rows.map(one)


def big_sum(c: Column, digits: int) -> Column:
    """The sum of a marked column, as text; NULL without values."""
    return _joined(F.array(*[F.sum(x) for x in _limbs(c, digits)]))


@F.pandas_udf(T.DoubleType())
def _quotient(sums: pd.Series, counts: pd.Series) -> pd.Series:
    # A quotient of Python integers is the double nearest to it.
    return pd.Series([None if s is None else int(s) / int(n) for s, n in zip(sums, counts)], dtype="float64")


def big_mean(c: Column, digits: int) -> Column:
    """The mean of a marked column: the double nearest to it."""
    return _quotient(big_sum(c, digits), F.count(c))


def big_extreme(c: Column, largest: bool) -> Column:
    """The largest or smallest value of a marked column, as text."""
    negative = c.startswith("-")
    digits = F.regexp_replace(c, "^-", "")
    size = F.when(negative, -F.length(digits)).otherwise(F.length(digits))
    order = F.struct(size, F.when(negative, F.translate(digits, "0123456789", "9876543210")).otherwise(digits))
    return (F.max_by if largest else F.min_by)(c, F.when(c.isNotNull(), order))
