import math

import pytest

from tablestats.operators import profile as P


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_std_pop_golden(spark):
    df = spark.range(1, 11).selectExpr("cast(id as double) as x")
    assert one(P.column_std_pop(df)).x == pytest.approx(2.8722813232690143, abs=1e-15)


def test_std_single_row_is_zero(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    assert one(P.column_std_pop(df)).x == 0.0


def test_mean_above_strict_and_zero(spark):
    a = spark.createDataFrame([(1,), (2,), (20,)], "x int")
    b = spark.createDataFrame([(20,), (21,), (23,)], "x int")
    assert one(P.mean_above(a)).x == 0
    assert one(P.mean_above(b)).x == 22.0
    assert one(P.count_above(b)).x == 2


def test_constant_columns(spark):
    df = spark.createDataFrame([(5, 5, 1.0), (5, None, 1.0), (5, 5, float("nan"))], "a int, b int, c double")
    r = one(P.constant_columns(df))
    assert (r.a, r.b) == (1, 0)
    single = spark.createDataFrame([(5,)], "a int")
    assert one(P.constant_columns(single)).a == 1


def test_nan_and_null_are_skipped(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (30.0,)], "x double")
    r = one(P.column_profile(df))
    assert r.n == 2 and r["sum"] == 31.0 and r["max"] == 30.0 and r["min"] == 1.0
    assert r.count_above == 1 and r.mean_above == 30.0


def test_integer_sum_is_exact(spark):
    big = 2 ** 62
    df = spark.createDataFrame([(big,), (big,), (big,)], "x bigint")
    assert int(one(P.column_sum(df)).x) == 3 * big


def test_text_columns_skipped_or_strict(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, s string")
    assert one(P.column_sum(df)).asDict() == {"x": 3}
    with pytest.raises(TypeError):
        P.column_sum(df, ["x", "s"], strict=True)


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double")
    r = one(P.column_profile(df))
    assert r.n == 0 and r["sum"] is None and r.is_const is None and r.mean_above == 0.0


def test_profile_matches_single_metrics(spark):
    from tests.conftest import SF
    from tablestats.plans.tables import lineitem_numeric
    df = lineitem_numeric(spark, SF)
    prof = {r.col_name: r for r in P.column_profile(df).collect()}
    sums = one(P.column_sum(df)).asDict()
    for c, v in sums.items():
        assert math.isclose(prof[c]["sum"], v, rel_tol=1e-12)
    assert prof["k_const"].is_const == 1 and prof["l_quantity"].is_const == 0


def test_profile_is_one_scan(spark):
    from tests.conftest import SF
    from tablestats.plans.tables import lineitem_numeric
    plan = P.column_profile(lineitem_numeric(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "l_orderkey" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_text_columns_for_min_max_const(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("é", "x")], "s string, t string")
    assert one(P.column_min(df, ["s"])).s == "a" and one(P.column_max(df, ["s"])).s == "é"
    assert one(P.constant_columns(df, ["s", "t"])).asDict() == {"s": 0, "t": 1}


@pytest.mark.parametrize("fields", ["100", "1000"])
@pytest.mark.parametrize("p", [5, 8, 9, 40, 100, 200])
def test_profile_at_any_width(spark, p, fields):
    before = spark.conf.get("spark.sql.codegen.maxFields")
    spark.conf.set("spark.sql.codegen.maxFields", fields)
    try:
        df = spark.range(50).selectExpr(*[f"id * {k % 7} + {k} AS c{k}" for k in range(p)])
        got = {r.col_name: r for r in P.column_profile(df).collect()}
    finally:
        spark.conf.set("spark.sql.codegen.maxFields", before)
    assert set(got) == {f"c{k}" for k in range(p)}
    for k in range(p):
        v = [i * (k % 7) + k for i in range(50)]
        r = got[f"c{k}"]
        assert (r.n, r.sum, r.min, r.max, r.count_above, r.is_const) == (50, sum(v), min(v), max(v), sum(x > 20 for x in v), int(k % 7 == 0))


def test_profile_tells_large_integers_apart(spark):
    df = spark.createDataFrame([(2**53, 2**53), (2**53 + 1, 2**53)], "a long, b long")
    got = {r.col_name: r.is_const for r in P.column_profile(df).collect()}
    assert got == {"a": 0, "b": 1}
    empty = P.column_profile(df.selectExpr(*[f"a AS x{k}" for k in range(20)]).where("false")).collect()
    assert len(empty) == 20 and all(r.n == 0 and r.is_const is None for r in empty)


def test_aggregates_without_numeric_columns_say_so(spark):
    df = spark.createDataFrame([("a",)], "t string")
    for f in (P.column_sum, P.column_mean, P.count_above, P.constant_columns):
        with pytest.raises(ValueError):
            f(df)
