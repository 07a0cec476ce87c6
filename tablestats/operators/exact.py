"""Sums of doubles that do not depend on the order of their terms.

A double is an integer times a power of two. Its bits are dealt to integer limbs: limb
k counts multiples of 2^(32 k). Limbs of equal number are added as integers, which
is exact in any order, so partial sums merge exactly whatever the partitions, files or
nodes; a batch hands on its limbs with carries done, each below 2^32, so that 2^31
batches can meet in a 64-bit sum (beyond it Spark raises). Only the last step
rounds, once: a sum is the double nearest to the true sum of the values, as Python's
``math.fsum`` gives it. Products, for variances and correlations, are dealt out in
the same way from the parts of both mantissas.

Within a task numpy does this on whole Arrow batches. What leaves a batch is one
short row per column and limb that is not zero; Spark adds them up by limb.

A mean is the rounded sum over the count, as ``fsum(x) / len(x)``. A standard
deviation and a correlation are computed from the exact sums as fractions and rounded once,
so they have no cancellation and a constant column has a variance of exactly zero.

NaN and NULL are skipped; an infinity makes the sum infinite, both signs make it
NaN; sums beyond the range of doubles are infinite; without values the sum is NULL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablestats.operators.columns import quote, resolve, value_sql
from tablestats.session import checkpoint_root

LIMB_BITS = 32
#: Rows added up at once: limb sums then stay below 2^53 and numpy's float histogram is exact.
ROWS = 1 << 18
#: Limb numbers of what is no limb: values counted, infinities of either sign.
COUNT, PLUS, MINUS = 1_000_000, 1_000_001, 1_000_002
LIMBS_DDL = "array<struct<limb:int,s:bigint>>"


def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Finite doubles as whole numbers of up to 53 bits and powers of two."""
    m, e = np.frexp(x)
    return (m * 2.0**53).astype(np.int64), e.astype(np.int64) - 53


def _deal(m: np.ndarray, e: np.ndarray, group: np.ndarray, groups: int) -> tuple[int, np.ndarray]:
    """Sums of m * 2^e by group as limbs: the number of the first, and one row per group."""
    sign = np.sign(m).astype(np.float64)
    a = np.abs(m).astype(np.uint64)
    limb, shift = e >> 5, (e & 31).astype(np.uint64)
    mask, up = np.uint64(2**32 - 1), np.uint64(32)
    low, high = (a & mask) << shift, (a >> up) << shift
    first = int(limb.min())
    width = int(limb.max()) - first + 3
    out = np.zeros(groups * width)
    at = group * width + (limb - first)
    for k, part in enumerate((low & mask, (low >> up) + (high & mask), high >> up)):
        out += np.bincount(at + k, sign * part.astype(np.float64), groups * width)
    return first, out.reshape(groups, width).astype(np.int64)


def _carried(first: int, sums: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(groups, limb, values) of the limbs that are not zero, all but the last of a group from 0 to 2^32."""
    carry = np.zeros(len(sums), np.int64)
    for k in range(sums.shape[1] + 1):
        total = carry if k == sums.shape[1] else sums[:, k] + carry
        if k < sums.shape[1]:
            total, carry = total & (2**32 - 1), total >> LIMB_BITS
        held = np.flatnonzero(total)
        if len(held):
            yield held, first + k, total[held]


def _product(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers and powers of two that add up to the products, and which product each belongs to."""
    (m, e), (n, f) = x, y
    bits = (1 << 27) - 1
    sign = np.sign(m) * np.sign(n)
    m, n = np.abs(m), np.abs(n)
    a, b, c, d = m >> 27, m & bits, n >> 27, n & bits
    rows = np.arange(len(m))
    whole = np.concatenate([sign * a * c, sign * (a * d + b * c), sign * b * d])
    return whole, np.concatenate([e + f + 54, e + f + 27, e + f]), np.concatenate([rows] * 3)


def limb_rows(df: DataFrame, columns: list[str], terms: list[tuple[int, int]], key: str | None = None) -> DataFrame:
    """(key, i, j, limb, s) summed over ``df``: the limbs of column i's sum (j = -1) or of the products of columns i and j.

    ``columns`` are SQL expressions of doubles. A product counts where both values are finite;
    infinities are counted for plain sums.
    """
    ddl = "i int, j int, limb int, s bigint"
    row = f"array({', '.join(f'CAST({c} AS DOUBLE)' for c in columns)}) AS v"
    rows = df.selectExpr(*([f"{quote(key)} AS key"] if key else []), row)
    if key:
        ddl = f"key {rows.schema['key'].dataType.simpleString()}, " + ddl
    p = len(columns)

    def of(x: np.ndarray, group: np.ndarray, groups: int) -> Iterator[tuple]:
        finite = np.isfinite(x)
        whole = {i: parts(np.where(finite[:, i], x[:, i], 0.0)) for i in {k for t in terms for k in t if k >= 0}}
        for i, j in terms:
            there = finite[:, i] if j < 0 else finite[:, i] & finite[:, j]
            if j < 0:
                m, e, at = *whole[i], np.arange(len(x))
                for limb, mark in ((PLUS, x[:, i] == np.inf), (MINUS, x[:, i] == -np.inf)):
                    if mark.any():
                        n = np.bincount(group[mark], minlength=groups)
                        yield i, j, np.flatnonzero(n), limb, n[n > 0]
            else:
                m, e, at = _product(whole[i], whole[j])
            n = np.bincount(group[there], minlength=groups)
            yield i, j, np.flatnonzero(n), COUNT, n[n > 0]
            some = there[at] & (m != 0)
            if some.any():
                for held, limb, s in _carried(*_deal(m[some], e[some], group[at[some]], groups)):
                    yield i, j, held, limb, s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                if key:
                    coded = b.column("key").dictionary_encode("encode")
                    group, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                else:
                    group, names = np.zeros(len(x), np.int64), [None]
                out = list(of(x, group, len(names)))
                if not out:
                    continue
                sizes = [len(o[2]) for o in out]
                cols = [pa.array(np.repeat(np.array([o[k] for o in out]), sizes), pa.int32()) for k in (0, 1, 3)] + [pa.array(np.concatenate([o[4] for o in out]), pa.int64())]
                if key:
                    cols.insert(0, names.take(pa.array(np.concatenate([o[2] for o in out]))))
                yield pa.RecordBatch.from_arrays(cols, (["key"] if key else []) + ["i", "j", "limb", "s"])

    return rows.mapInArrow(run, ddl).groupBy(*(["key"] if key else []), "i", "j", "limb").agg(F.sum("s").alias("s"))


def total(limbs) -> tuple[int, Fraction | float | None]:
    """How many values, and their exact sum: a fraction, an infinity or NaN, or None for no value."""
    n = plus = minus = 0
    whole, least = 0, 0
    held = [(int(limb), int(s)) for limb, s in limbs]
    finite = [(k, s) for k, s in held if k < COUNT]
    if finite:
        least = min(k for k, _ in finite)
        whole = sum(s << LIMB_BITS * (k - least) for k, s in finite)
    for k, s in held:
        n += s * (k >= COUNT)
        plus += s * (k == PLUS)
        minus += s * (k == MINUS)
    if plus or minus:
        return n, math.nan if plus and minus else math.inf if plus else -math.inf
    return n, whole * Fraction(2) ** (LIMB_BITS * least) if n else None


def nearest(x: Fraction | float | None) -> float | None:
    """The double nearest to a sum."""
    try:
        return None if x is None else float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def nearest_root(x: Fraction) -> float:
    """The double nearest to the square root."""
    if x <= 0:
        return 0.0
    n, d = x.numerator, x.denominator
    k = max(0, (112 - n.bit_length() + d.bit_length()) // 2)
    root = math.isqrt((n << 2 * k) // d)
    inexact = root * root * d != n << 2 * k
    return float(Fraction(2 * root + inexact, 2 << k))  # the last bit says whether anything follows


def _one_per_group(sums: DataFrame, by: list[str]) -> DataFrame:
    """``sums`` with the limbs of each of ``by`` in one row: a few per term."""
    return sums.groupBy(*by).agg(F.collect_list(F.struct("j", "limb", "s")).alias("limbs"))


def exact_statistics(df: DataFrame, cols=None, strict: bool = False) -> DataFrame:
    """D1, D2 and D5, one row per column: (col_name, n, sum, mean, std_pop), the same for any partitioning."""
    cols = resolve(df, cols, strict)
    if not cols:
        raise ValueError("no columns of a suitable type to aggregate")
    names = list(cols)
    sums = limb_rows(df, [value_sql(df, c) for c in cols], [t for i in range(len(cols)) for t in ((i, -1), (i, i))])
    every = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, limbs in zip(b.column("i").to_pylist(), b.column("limbs").to_pylist()):
                by = {k: total((x["limb"], x["s"]) for x in limbs or () if x["j"] == k) for k in (-1, i)}
                (n, s), (_, ss) = by[-1], by[i]
                value = nearest(s)
                spread = None if not n else math.nan if isinstance(s, float) else nearest_root((ss - s * s / n) / n)
                out.append((names[i], n, value, None if value is None else value / n, spread))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))],
                                             ["col_name", "n", "sum", "mean", "std_pop"])

    return every.join(_one_per_group(sums, ["i"]), "i", "left").mapInArrow(run, "col_name string, n bigint, sum double, mean double, std_pop double")


def exact_partials(df: DataFrame, value_col: str, node_col: str) -> DataFrame:
    """(node, limbs): the mergeable sum of one column per node; see ``merged_sum``."""
    sums = limb_rows(df, [value_sql(df, value_col)], [(0, -1)], node_col)
    return sums.groupBy(F.col("key").alias(node_col)).agg(F.collect_list(F.struct("limb", "s")).cast(LIMBS_DDL).alias("limbs"))


def merged_sum(partials: DataFrame, limbs_col: str = "limbs") -> DataFrame:
    """One row (sum): the exact total of any number of partial sums, rounded once; 0 without values."""
    sums = partials.select(F.explode(limbs_col).alias("x")).groupBy("x.limb").agg(F.sum("x.s").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [nearest(total((x["limb"], x["s"]) for x in row or ())[1]) for row in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x or 0.0 for x in got], pa.float64())], ["sum"])

    return sums.agg(F.collect_list(F.struct("limb", "s")).alias("limbs")).mapInArrow(run, "sum double")


def exact_correlation(df: DataFrame, cols=None, strict: bool = False) -> DataFrame:
    """D9 from exact sums, of the rows without a missing or infinite value: (col_i, col_j, corr), rounded once.

    Every task adds up p (p + 1) / 2 products, so this is for some dozens of columns;
    ``correlation_matrix`` takes any number.
    """
    cols = resolve(df, cols, strict)
    if not cols:
        raise ValueError("no numeric columns to correlate")
    values = [f"CAST({value_sql(df, c)} AS DOUBLE)" for c in cols]
    whole = df.where(" AND ".join(f"abs({v}) < double('infinity')" for v in values))
    p, names = len(cols), list(cols)
    checkpoint_root(df.sparkSession)
    sums = limb_rows(whole, values, [(i, -1) for i in range(p)] + [(i, j) for i in range(p) for j in range(i, p)]).checkpoint()
    own: dict[tuple[int, int], list] = {}
    for r in sums.where("j = -1 OR i = j").collect():  # some limbs per column
        own.setdefault((r["i"], r["j"]), []).append((r["limb"], r["s"]))
    single = {t: total(limbs) for t, limbs in own.items()}
    n = single.get((0, -1), (0, None))[0]
    sum_of = {i: single[i, -1][1] for i in range(p) if n}
    spread = {i: n * single[i, i][1] - sum_of[i] ** 2 for i in range(p) if n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, j, limbs in zip(b.column("i").to_pylist(), b.column("k").to_pylist(), b.column("limbs").to_pylist()):
                r = 0.0
                if n and spread[i] and spread[j]:
                    both = n * total((x["limb"], x["s"]) for x in limbs)[1] - sum_of[i] * sum_of[j]
                    r = math.copysign(nearest_root(both * both / (spread[i] * spread[j])), both) if both else 0.0
                out += [(names[i], names[j], r)] + ([(names[j], names[i], r)] if i != j else [])
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["col_i", "col_j", "corr"])

    pairs = df.sparkSession.range(p * p).selectExpr(f"CAST(id DIV {p} AS INT) AS i", f"CAST(id % {p} AS INT) AS k").where("i <= k")
    limbs = _one_per_group(sums.where("j >= 0").withColumn("k", F.col("j")), ["i", "k"])
    return pairs.join(limbs, ["i", "k"], "left").mapInArrow(run, "col_i string, col_j string, corr double")


def exact_columns(df: DataFrame, cols: list[str], field: str) -> DataFrame:
    """One row with ``field`` of ``exact_statistics`` for each of ``cols``, named like the column."""
    long = exact_statistics(df, cols)
    return long.agg(*[F.max(F.when(F.col("col_name") == c, F.col(field))).alias(c) for c in cols])
