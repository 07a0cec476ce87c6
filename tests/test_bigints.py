import random

import pytest

from tablestats.operators import bigints as B
from tablestats.operators import profile as P
from tablestats.sources import cells as CE
from tablestats.sources import text_table as TT
from tests.test_sources import _write


def numbers(n, seed=0):
    rng = random.Random(seed)
    return [rng.randrange(-10**60, 10**60) if i % 4 else rng.randrange(-10**3, 10**3) for i in range(n)] + [0, -0, 10**59, -10**59, 10**60 - 1]


def text(v, i):
    t = f"{v:_}" if i % 7 == 0 else f"{v:+}" if i % 7 == 1 else f" {v} " if i % 7 == 2 else f"-000{-v}" if v < 0 and i % 7 == 3 else str(v)
    return t


def test_sixty_digit_column_of_a_csv(spark):
    x = numbers(500)
    d = _write("a,b,c\n" + "".join(f"{text(v, i)},{i},{v if i < 9 else i}\n" for i, v in enumerate(x)))
    df = TT.read_table(spark, d, exact=True).repartition(5)
    assert dict(df.dtypes) == {"a": "string", "b": "bigint", "c": "string"} and B.big_digits(df, "a") >= 60
    assert sorted(int(r["a"]) for r in df.collect()) == sorted(x)
    assert all(r["a"] == str(int(r["a"])) for r in df.collect())
    s, lo, hi, mean = (f(df).first() for f in (P.column_sum, P.column_min, P.column_max, P.column_mean))
    c = [v if i < 9 else i for i, v in enumerate(x)]
    assert int(s["a"]) == sum(x) and int(s["c"]) == sum(c) and s["b"] == sum(range(len(x)))
    assert (int(lo["a"]), int(hi["a"])) == (min(x), max(x)) and (int(lo["c"]), int(hi["c"])) == (min(c), max(c))
    assert mean["a"] == sum(x) / len(x)


def test_marked_text_nulls_and_empty_tables(spark):
    df = B.mark_big(spark.createDataFrame([("9" * 50, 1), (None, 2), ("-" + "9" * 50, 3), (" +0_7 ", 4)], "x string, k int"), ["x"])
    assert sorted(r["x"] or "" for r in df.collect()) == ["", "-" + "9" * 50, "7", "9" * 50]
    assert P.column_sum(df).first().asDict() == {"x": "7", "k": 10}
    assert P.column_mean(df).first()["x"] == 7 / 3
    none = df.where("k > 9")
    assert [f(none).first()["x"] for f in (P.column_sum, P.column_min, P.column_max, P.column_mean)] == [None] * 4
    with pytest.raises(Exception, match="not an integer"):
        B.mark_big(spark.createDataFrame([("1x",)], "x string"), ["x"])


def test_only_negative_values(spark):
    df = B.mark_big(spark.createDataFrame([("-12",), ("-100",), ("-99",)], "x string"), ["x"])
    assert (P.column_min(df).first()["x"], P.column_max(df).first()["x"], P.column_sum(df).first()["x"]) == ("-100", "-12", "-211")


def test_other_cells_beside_long_ints_stay_text(spark):
    long = "1" * 50
    df = spark.createDataFrame([([long, long, "9" * 30, "9" * 19], ), (["x", "1.5", "1", " 12_3 "],)], "cells array<string>")
    got = {r["pos"]: (r["col_type"], r["n_big"], r["n_huge"]) for r in CE.infer_schema_profile(df).collect()}
    assert got == {0: ("string", 0, 1), 1: ("string", 0, 1), 2: ("decimal(38,0)", 1, 0), 3: ("decimal(38,0)", 1, 0)}
