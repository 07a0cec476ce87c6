"""List operations with Python's semantics, as Spark column expressions.

Spark's array functions differ from Python lists in indexing (1-based),
``array_remove`` (drops every match), ``array_insert`` (pads with NULL),
``sequence`` (inclusive, counts down on its own) and ``arrays_zip`` (pads
to the longest). These helpers restate the Python behaviour with built-in
functions only, so they stay inside code generation. Errors Python would
raise (IndexError, ValueError) raise here too via ``raise_error``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _norm_index(a: Column, i) -> Column:
    """Python index -> 0-based position (negative counts from the end)."""
    i = _c(i)
    return F.when(i < 0, i + F.size(a)).otherwise(i)


def slice_bounds(n: Column, lo, hi, step: int):
    """Normalised (start, stop) of Python ``[lo:hi:step]`` over ``n`` items."""
    def norm(x, default, low, high):
        if x is None:
            return default
        x = _c(x)
        v = F.when(x < 0, x + n).otherwise(x)
        return F.least(F.greatest(v, low), high)
    if step > 0:
        return norm(lo, F.lit(0), F.lit(0), n), norm(hi, n, F.lit(0), n)
    return norm(lo, n - 1, F.lit(-1), n - 1), norm(hi, F.lit(-1), F.lit(-1), n - 1)


# --- C6 mutators -----------------------------------------------------------

def py_append(a: Column, x) -> Column:
    return F.array_append(a, _c(x))


def py_extend(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def py_insert(a: Column, i, x) -> Column:
    """``a.insert(i, x)``: 0-based, negative from the end, clamped to [0, len]."""
    n = F.size(a)
    pos = F.least(F.greatest(_norm_index(a, i), F.lit(0)), n)
    return F.concat(F.slice(a, F.lit(1), pos), F.array(_c(x)), F.slice(a, pos + 1, F.greatest(n - pos, F.lit(0))))


def _checked_index(a: Column, i, what: str) -> Column:
    idx = _norm_index(a, i)
    ok = (idx >= 0) & (idx < F.size(a))
    return F.when(ok, idx).otherwise(F.raise_error(F.lit(f"IndexError: {what}")).cast("int"))


def py_pop_value(a: Column, i=-1) -> Column:
    """The value ``a.pop(i)`` returns; raises on an empty list or bad index."""
    return F.get(a, _checked_index(a, i, "pop index out of range"))


def py_pop_rest(a: Column, i=-1) -> Column:
    """The list left after ``a.pop(i)``."""
    idx = _checked_index(a, i, "pop index out of range")
    return F.filter(a, lambda x, j: j != idx)


def py_remove(a: Column, x) -> Column:
    """``a.remove(x)``: drops the first match only; raises when absent."""
    pos = F.array_position(a, _c(x))
    rest = F.concat(F.slice(a, F.lit(1), pos - 1), F.slice(a, pos + 1, F.greatest(F.size(a) - pos, F.lit(0))))
    return F.when(pos > 0, rest).otherwise(F.raise_error(F.lit("ValueError: list.remove(x): x not in list")))


def py_clear(a: Column) -> Column:
    return F.slice(a, 1, 0)


def py_sort(a: Column, reverse: bool = False) -> Column:
    return F.sort_array(a, asc=not reverse)


def py_reverse(a: Column) -> Column:
    return F.reverse(a)


# --- C7 access ---------------------------------------------------------------

def py_len(a: Column) -> Column:
    return F.size(a)


def py_getitem(a: Column, i) -> Column:
    """``a[i]``; raises IndexError out of range."""
    return F.get(a, _checked_index(a, i, "list index out of range"))


def py_slice(a: Column, lo=None, hi=None, step: int = 1) -> Column:
    """``a[lo:hi:step]`` with Python's clamping and negative indices."""
    if step == 0:
        raise ValueError("slice step cannot be zero")
    start, stop = slice_bounds(F.size(a), lo, hi, step)
    if step > 0:
        return F.filter(a, lambda x, j: (j >= start) & (j < stop) & (F.pmod(j - start, F.lit(step)) == 0))
    kept = F.filter(a, lambda x, j: (j <= start) & (j > stop) & (F.pmod(start - j, F.lit(-step)) == 0))
    return F.reverse(kept)


def py_count(a: Column, x) -> Column:
    return F.size(F.filter(a, lambda y: y == _c(x)))


def py_index(a: Column, x) -> Column:
    """``a.index(x)``: first 0-based position; raises when absent."""
    pos = F.array_position(a, _c(x))
    return F.when(pos > 0, pos - 1).otherwise(F.raise_error(F.lit("ValueError: x is not in list")).cast("long"))


def py_del_item(a: Column, i) -> Column:
    """``del a[i]``."""
    idx = _checked_index(a, i, "list assignment index out of range")
    return F.filter(a, lambda x, j: j != idx)


def py_del_slice(a: Column, lo=None, hi=None) -> Column:
    """``del a[lo:hi]``."""
    start, stop = slice_bounds(F.size(a), lo, hi, 1)
    return F.filter(a, lambda x, j: (j < start) | (j >= stop))


# --- C8 composition ------------------------------------------------------------

def py_concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def py_repeat(a: Column, n) -> Column:
    """``a * n``; n <= 0 gives an empty list."""
    return F.flatten(F.array_repeat(a, F.greatest(_c(n), F.lit(0))))


def py_comprehension(a: Column, fn=None, cond=None) -> Column:
    """``[fn(x) for x in a if cond(x)]``."""
    out = F.filter(a, cond) if cond is not None else a
    return F.transform(out, fn) if fn is not None else out


# --- C9 iteration ----------------------------------------------------------------

def py_range(start, stop=None, step: int = 1) -> Column:
    """``list(range(...))`` - exclusive stop, empty when the range is empty."""
    if stop is None:
        start, stop = 0, start
    if step == 0:
        raise ValueError("range() arg 3 must not be zero")
    start, stop = _c(start).cast("long"), _c(stop).cast("long")
    st = F.lit(step).cast("long")
    if step > 0:
        empty = start >= stop
        last = start + F.floor((stop - start - 1) / st).cast("long") * st
    else:
        empty = start <= stop
        last = start - F.floor((start - stop - 1) / (-st)).cast("long") * (-st)
    return F.when(empty, F.array().cast("array<bigint>")).otherwise(F.sequence(start, last, st))


def py_enumerate(a: Column) -> Column:
    """``list(enumerate(a))`` as an array of ``struct(index, value)``."""
    return F.transform(a, lambda x, i: F.struct(i.alias("index"), x.alias("value")))


def py_zip(a: Column, b: Column) -> Column:
    """``list(zip(a, b))`` as ``struct(_1, _2)`` pairs; stops at the shorter
    list (``arrays_zip`` would pad with NULL)."""
    n = F.least(F.size(a), F.size(b))
    return F.transform(F.slice(a, 1, n), lambda x, i: F.struct(x.alias("_1"), F.get(b, i).alias("_2")))
