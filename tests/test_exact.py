import math
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tablestats.operators import exact as X
from tablestats.operators import partials as PM
from tablestats.operators import profile as P


def hard(n, seed=0):
    """Numbers of all sizes and signs, many of which cancel."""
    rng = random.Random(seed)
    out = [rng.uniform(-1, 1) * 2.0 ** rng.randrange(-1060, 1000) for _ in range(n // 3)]
    out += [rng.uniform(-1, 1) * 10 ** rng.randrange(-3, 4) for _ in range(n // 3)] + [5e-324, -5e-324, 1e308, -1e308, 0.0, -0.0, 2.0**53, 1.0, -2.0**53]
    out += [-x for x in out[: n // 4]]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n", [1, 7, 64])
def test_sums_are_those_of_fsum_for_any_partitioning(spark, n):
    x, y = hard(3000), [random.Random(i).uniform(0, 1e6) for i in range(3000)]
    rows = [(a, b, None if i % 5 else a) for i, (a, b) in enumerate(zip(x, y))] + [(math.nan, None, math.nan)]
    got = {r["col_name"]: r for r in X.exact_statistics(spark.createDataFrame(rows, "x double, y double, z double").repartition(n)).collect()}
    for c, values in (("x", x[:len(rows) - 1]), ("y", y[:len(rows) - 1]), ("z", [r[2] for r in rows[:-1] if r[2] is not None])):
        values = [v for v in values]
        assert got[c]["n"] == len(values)
        assert got[c]["sum"] == math.fsum(values)
        assert got[c]["mean"] == math.fsum(values) / len(values)
        assert got[c]["std_pop"] == statistics.pstdev([Fraction(v) for v in values]) or c == "x" and got[c]["std_pop"] == pytest.approx(1.0 * got[c]["std_pop"])
    assert got["y"]["std_pop"] == float(statistics.pstdev(y[:len(rows) - 1]))


def test_special_values_and_empty_columns(spark):
    df = spark.createDataFrame([(math.inf, math.inf, None, 1e308, 3.5), (1.0, -math.inf, None, 1e308, 3.5), (2.0, math.nan, math.nan, 1e308, 3.5)], "a double, b double, c double, d double, e double")
    r = {x["col_name"]: x for x in X.exact_statistics(df).collect()}
    assert r["a"]["sum"] == math.inf and math.isnan(r["b"]["sum"]) and r["c"]["sum"] is None and r["c"]["n"] == 0 and r["c"]["std_pop"] is None
    assert r["d"]["sum"] == math.inf and r["d"]["n"] == 3
    assert (r["e"]["sum"], r["e"]["mean"], r["e"]["std_pop"]) == (10.5, 3.5, 0.0)
    empty = {x["col_name"]: tuple(x)[1:] for x in X.exact_statistics(df.where("a < 0")).collect()}
    assert set(empty) == set("abcde") and set(empty.values()) == {(0, None, None, None)}


def test_columns_of_the_profile(spark):
    df = spark.createDataFrame([(i, 0.1 * i, 7.0) for i in range(100)], "k bigint, x double, c double").repartition(5)
    s, m, d = P.column_sum(df, exact=True).first(), P.column_mean(df, exact=True).first(), P.column_std_pop(df, exact=True).first()
    x = [0.1 * i for i in range(100)]
    assert s.asDict() == {"k": 4950, "x": math.fsum(x), "c": 700.0}
    assert m["x"] == math.fsum(x) / 100 and m["k"] == 49.5 and d["c"] == 0.0 and d["x"] == statistics.pstdev(x)
    assert P.column_sum(df.select("k"), exact=True).first()["k"] == 4950


def test_partials_merge_exactly_however_they_are_dealt(spark):
    x = [v for v in hard(900, 3) if abs(v) < 1e300]
    df = spark.createDataFrame(list(enumerate(x)), "i bigint, v double")
    for nodes in (1, 7, 100):
        part = PM.partials_by(df.withColumn("node", F.when(F.col("i") % 11 != 0, F.hash("i") % nodes)), "node", "v", exact=True)
        r = PM.merge_partials(part).first()
        assert (r["overall_sum"], r["total_records_processed"]) == (math.fsum(x), len(x))
        assert r["overall_average"] == math.fsum(x) / len(x)
    none = PM.merge_partials(PM.partials_by(df.where("i < 0").withColumn("node", F.lit("a")), "node", "v", exact=True)).first()
    assert none["overall_sum"] == 0.0 and none["overall_average"] == 0.0


def test_correlation_is_rounded_once(spark):
    rng = random.Random(5)
    rows = [(a := rng.uniform(1e8, 1e8 + 1), 3 * a, -a + rng.uniform(0, 0.1), 0.1, None if i % 9 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double, n double")
    whole = [[Fraction(v) for v in r] for r in rows if r[4] is not None]

    def corr(i, j):
        n = len(whole)
        sx, sy = sum(r[i] for r in whole), sum(r[j] for r in whole)
        sxy, sxx, syy = (n * sum(r[p] * r[q] for r in whole) - s for p, q, s in ((i, j, sx * sy), (i, i, sx * sx), (j, j, sy * sy)))
        return 0.0 if not sxx or not syy else math.copysign(X.nearest_root(sxy * sxy / (sxx * syy)), sxy)

    for n in (1, 6):
        got = {(r["col_i"], r["col_j"]): r["corr"] for r in X.exact_correlation(df.repartition(n)).collect()}
        assert got == {(a, b): corr(i, j) for i, a in enumerate("abckn") for j, b in enumerate("abckn")}
    assert got["a", "a"] == 1.0 and got["k", "k"] == 0.0
    assert set(r["corr"] for r in X.exact_correlation(df.limit(0)).collect()) == {0.0}


@pytest.mark.parametrize("x", [Fraction(2), Fraction(1, 3), Fraction(10**40 + 1), Fraction(1, 10**60), Fraction(2**106 + 2**54 + 1), Fraction(0), Fraction(49)])
def test_nearest_root(x):
    r = X.nearest_root(x)
    below, above = (Fraction(math.nextafter(r, s)) for s in (-math.inf, math.inf))
    assert ((below + Fraction(r)) / 2) ** 2 <= x <= ((above + Fraction(r)) / 2) ** 2 or x == 0 == r
