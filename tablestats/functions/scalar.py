"""Python scalar arithmetic as Spark column expressions.

Python's ``//`` floors and ``%`` takes the divisor's sign; Spark's ``div``
truncates and ``%`` takes the dividend's sign. ``round(x)`` is half-even and
returns an int. Division by zero raises, as in Python (ANSI mode).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _float_mod(a: Column, b: Column) -> Column:
    """Python's ``%`` on floats: the exact remainder with the divisor's sign."""
    a, b = a.cast("double"), b.cast("double")
    def fixed(m: Column) -> Column:
        # Zero takes the divisor's sign as well.
        return F.when(m == 0, F.when(b < 0, F.lit(-0.0)).otherwise(F.lit(0.0))).when((m < 0) != (b < 0), m + b).otherwise(m)

    return _once(a % b, fixed)


def _float_floordiv(a: Column, b: Column) -> Column:
    """Python's ``//`` on floats: the exact remainder taken off, divided, rounded to the nearest integer."""
    a, b = a.cast("double"), b.cast("double")

    def quotient(m: Column) -> Column:
        return (a - m) / b - F.when((m != 0) & ((m < 0) != (b < 0)), F.lit(1.0)).otherwise(F.lit(0.0))

    def whole(d: Column) -> Column:
        # From 2^52 on a double is whole (and may be too large for a long).
        return F.when(F.abs(d) >= 2.0**52, d).otherwise(F.floor(F.when(F.abs(d) < 2.0**52, d)).cast("double"))

    return _once(_once(a % b, quotient), lambda d: F.when(d - whole(d) > 0.5, whole(d) + 1).otherwise(whole(d)))


def py_floordiv(a, b, integral: bool = True) -> Column:
    """``a // b``. For integers exact at any size: truncating ``div`` minus one
    when the remainder is non-zero and the signs differ. For floats as Python
    does it, from the exact remainder (``1.0 // 0.1`` is 9.0)."""
    a, b = _c(a), _c(b)
    if not integral:
        return _float_floordiv(a, b)
    def floored(q: Column) -> Column:
        return F.when(((a < 0) != (b < 0)) & (q * b.cast("long") != a), q - 1).otherwise(q)

    return _once(_div(a, b), floored)


def _once(x: Column, use) -> Column:
    """``use(x)`` with ``x`` worked out once per row, however often it is used."""
    return F.transform(F.array(x), use)[0]


def _div(a: Column, b: Column) -> Column:
    """Truncating integer division (Spark's ``div``)."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def py_mod(a, b, integral: bool = True) -> Column:
    """``a % b`` with the divisor's sign, from one remainder.

    Not ``pmod``: that one stays non-negative for a negative divisor
    (``pmod(4, -5) = 4``, Python gives -1).
    """
    a, b = _c(a), _c(b)
    if not integral:
        return _float_mod(a, b)
    whole = b.cast("long")
    return _once(a.cast("long") % whole, lambda m: F.when((m != 0) & ((m < 0) != (whole < 0)), m + whole).otherwise(m))


def py_pow(a, b, integral: bool = False) -> Column:
    """``a ** b``. With ``integral`` (integer base, exponent 0 to 127) the result is
    exact, ``decimal(38,0)``, by repeated squaring; more than 38 digits raise under ANSI."""
    if not integral:
        return F.pow(_c(a), _c(b))
    kind, base = "decimal(38,0)", _c(a).cast("decimal(38,0)")
    if isinstance(b, int) and 1 <= b <= 8:
        out = base
        for _ in range(b - 1):
            out = (out * base).cast(kind)
        return out
    n = _c(b).cast("int")
    one = F.when(n < 0, F.raise_error(F.lit("integer power with a negative exponent")).cast(kind)).otherwise(F.lit(1).cast(kind))

    def step(s: Column, bit: Column) -> Column:
        # A square is only taken where the exponent needs it, so it cannot overflow for nothing.
        return F.struct(F.when(n.bitwiseAND(bit) != 0, (s["out"] * s["power"]).cast(kind)).otherwise(s["out"]).alias("out"),
                        F.when(n >= 2 * bit, (s["power"] * s["power"]).cast(kind)).alias("power"))

    bits = F.array(*[F.lit(1 << k) for k in range(7)])
    return F.aggregate(bits, F.struct(one.alias("out"), base.alias("power")), step)["out"]


def py_round(x) -> Column:
    """``round(x)`` without digits: half-even, integer result."""
    return F.rint(_c(x)).cast("long")


def py_int(x) -> Column:
    """``int(x)`` of a float: truncation toward zero."""
    return _c(x).cast("long")


def py_float(x) -> Column:
    return _c(x).cast("double")


def py_min(*xs) -> Column:
    return F.least(*[_c(x) for x in xs])


def py_max(*xs) -> Column:
    return F.greatest(*[_c(x) for x in xs])


def py_truediv(a, b) -> Column:
    return _c(a).cast("double") / _c(b).cast("double")


def py_sqrt(x) -> Column:
    """``x ** 0.5``."""
    return F.sqrt(_c(x))


def with_python_float_text(df, cols):
    """Replace double/float columns by their text as Python's ``str`` prints it
    (``0.0001``, ``1e+16``, ``-1.5e-07``, ``inf``, ``nan``); NULL stays NULL."""
    cols = list(cols)
    if not cols:
        return df
    return df.select(*[float_text(F.col(_quoted(f.name)).cast("double")).alias(f.name) if f.name in cols else F.col(_quoted(f.name))
                       for f in df.schema.fields])


def float_text(v: Column) -> Column:
    """A double as Python's ``repr`` prints it.

    The cast to string is no substitute: it writes ``1.0E16`` for ``1e+16`` and, on
    Java 17, digits that are not always the shortest. Arrow prints the shortest
    digits of a whole batch; only values whose text has an exponent in one of the
    two notations are formatted one by one.
    """
    return _float_text(v)


@F.arrow_udf(T.StringType())
def _float_text(v: pa.Array) -> pa.Array:  # pragma: no cover - runs in the Python workers
    x = v.to_numpy(zero_copy_only=False)
    text = pc.cast(v, pa.string())
    power = pc.fill_null(pc.match_substring(text, "e"), False).to_numpy(zero_copy_only=False)
    text = pc.if_else(pc.match_substring(text, "."), text, pc.binary_join_element_wise(text, ".0", ""))
    with np.errstate(invalid="ignore"):
        plain = ((x == 0) & ~np.signbit(x) | (np.abs(x) >= 1e-3) & (np.abs(x) < 1e15)) & ~power
    odd = np.flatnonzero(~plain & ~v.is_null().to_numpy(zero_copy_only=False))
    return pc.replace_with_mask(text, pa.array(np.isin(np.arange(len(x)), odd)), pa.array([repr(float(y)) for y in x[odd]], pa.string())) if len(odd) else text


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"
