import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablestats.functions import arrays as A
from tablestats.functions import scalar as S
from tablestats.operators import grid as G
from tablestats.operators import rows as R


def _px(spark, values):
    return spark.createDataFrame([(list(map(float, values)),)], "px array<double>")


def test_mean3x3_golden(spark):
    df = _px(spark, range(1, 10))
    flat = df.select(G.mean3x3(F.col("px"), 3).alias("o")).first().o
    assert flat == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    grid = df.select(G.grid_flatten(G.grid_mean3x3(G.grid_reshape(F.col("px"), 3), 3)).alias("o")).first().o
    assert grid == flat


def test_sobel_golden(spark):
    df = _px(spark, range(1, 10))
    assert df.select(G.sobel(F.col("px"), 3).alias("o")).first().o == [0, 0, 0, 0, 25, 0, 0, 0, 0]
    clip = _px(spark, [0, 255, 255] * 3)
    assert clip.select(G.sobel(F.col("px"), 3).alias("o")).first().o[4] == 255


def test_mean_half_even(spark):
    # block sum 22.5 * 9 / 9: centre (sum 202.5/9 = 22.5) rounds to 22, not 23
    vals = [22.5] * 9
    assert _px(spark, vals).select(G.mean3x3(F.col("px"), 3).alias("o")).first().o[4] == 22.0


def test_reshape_flatten_roundtrip(spark):
    df = _px(spark, range(16))
    r = df.select(G.grid_reshape(F.col("px"), 4).alias("g")).first().g
    assert r[1] == [4.0, 5.0, 6.0, 7.0]
    assert df.select(G.grid_flatten(G.grid_reshape(F.col("px"), 4)).alias("f")).first().f == list(map(float, range(16)))


def test_image_chain_drops_short_rows_and_raises_on_text(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(9)]), (2, ["1", "2"])], "id int, cells array<string>")
    out = G.smooth_images(df, "cells", 3).collect()
    assert [r.id for r in out] == [1] and out[0].cells[4] == 4.0
    bad = spark.createDataFrame([(1, ["x"] * 9)], "id int, cells array<string>")
    with pytest.raises(Exception):
        G.smooth_images(bad, "cells", 3).collect()


def test_wrong_lengths_are_no_images(spark):
    df = spark.createDataFrame([(1, [1.0] * 9), (2, [1.0] * 7), (3, [1.0] * 12), (4, None), (5, [])], "id int, px array<double>")
    for op in (G.mean3x3, G.sobel, G.grid_reshape):
        assert {r.id for r in df.select("id", op(F.col("px"), 3).alias("o")).where("o IS NOT NULL").collect()} == {1}
    cells = df.select("id", F.col("px").cast("array<string>").alias("cells"))
    assert [r.id for r in G.sobel_images(cells, "cells", 3).collect()] == [1]


def test_filters_equal_loops(spark):
    rng = random.Random(6)
    n = 7
    imgs = [[float(rng.randint(0, 255)) for _ in range(n * n)] for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(imgs)), "id int, px array<double>").repartition(3)
    out = {r.id: r for r in df.select("id", G.mean3x3(F.col("px"), n).alias("m"), G.sobel(F.col("px"), n).alias("s")).collect()}
    for k, px in enumerate(imgs):
        g = [px[i * n:(i + 1) * n] for i in range(n)]
        for i in range(n):
            for j in range(n):
                if i in (0, n - 1) or j in (0, n - 1):
                    mean, edge = g[i][j], 0.0
                else:
                    block = [[g[i + a][j + b] for b in (-1, 0, 1)] for a in (-1, 0, 1)]
                    mean = round(sum(map(sum, block)) / 9)
                    gx = sum(block[a][b] * G.SOBEL_GX[a][b] for a in range(3) for b in range(3))
                    gy = sum(block[a][b] * G.SOBEL_GY[a][b] for a in range(3) for b in range(3))
                    edge = round(min((gx * gx + gy * gy) ** 0.5, 255))
                assert out[k].m[i * n + j] == mean and out[k].s[i * n + j] == edge


def test_list_mutators(spark):
    df = spark.createDataFrame([([1, 2, 1],)], "a array<int>")
    a = F.col("a")
    r = df.select(A.py_remove(a, 1).alias("rm"), A.py_insert(a, 1, 9).alias("ins"),
                  A.py_insert(a, -1, 9).alias("ins_neg"), A.py_insert(a, 50, 9).alias("ins_big"),
                  A.py_pop_value(a).alias("pv"), A.py_pop_rest(a, 0).alias("pr"), A.py_index(a, 2).alias("ix"),
                  A.py_count(a, 1).alias("cnt"), A.py_repeat(a, 2).alias("rep"), A.py_clear(a).alias("clr")).first()
    assert r.rm == [2, 1] and r.ins == [1, 9, 2, 1] and r.ins_neg == [1, 2, 9, 1] and r.ins_big == [1, 2, 1, 9]
    assert (r.pv, r.pr, r.ix, r.cnt) == (1, [2, 1], 1, 2) and r.rep == [1, 2, 1] * 2 and r.clr == []
    with pytest.raises(Exception):
        df.select(A.py_remove(a, 7)).collect()
    with pytest.raises(Exception):
        spark.createDataFrame([([],)], "a array<int>").select(A.py_pop_value(a)).collect()


def test_slices_and_ranges_match_python(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.randint(-5, 5) for _ in range(rnd.randint(0, 12))], rnd.randint(-15, 15), rnd.randint(-15, 15))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a array<int>, lo int, hi int")
    a, lo, hi = F.col("a"), F.col("lo"), F.col("hi")
    steps = [1, 2, 3, -1, -2, -4]
    sel = [F.col("id")] + [A.py_slice(a, lo, hi, st).alias(f"s{k}") for k, st in enumerate(steps)]
    sel += [A.py_range(lo, hi, st).alias(f"r{k}") for k, st in enumerate(steps)]
    sel += [A.py_del_slice(a, lo, hi).alias("d"), F.transform(A.py_zip(a, F.reverse(a)), lambda s: s["_1"] - s["_2"])
            .alias("z")]
    got = {r.id: r for r in df.select(*sel).collect()}
    for i, lst, l, h in rows:
        r = got[i]
        for k, st in enumerate(steps):
            assert r[f"s{k}"] == lst[l:h:st], (lst, l, h, st)
            assert r[f"r{k}"] == list(range(l, h, st)), (l, h, st)
        cp = list(lst)
        del cp[l:h]
        assert r.d == cp
        assert r.z == [x - y for x, y in zip(lst, reversed(lst))]


def test_python_arithmetic(spark):
    df = spark.createDataFrame([(-7, 2), (-7, -2), (7, -2), (7, 2), (6, -4), (0, 3)], "a bigint, b bigint")
    out = df.select("a", "b", S.py_floordiv(F.col("a"), F.col("b")).alias("q"),
                    S.py_mod(F.col("a"), F.col("b")).alias("m")).collect()
    for r in out:
        assert (r.q, r.m) == (r.a // r.b, r.a % r.b)
    rd = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (0.4,)], "x double").select(S.py_round(F.col("x")).alias("r"))
    assert [r.r for r in rd.collect()] == [2, 4, -2, 0]


def test_row_fanout_golden(spark):
    df = spark.createDataFrame([("1", "a")], "c0 string, c1 string")
    out = [tuple(r) for r in R.row_fanout(df, ["c0", "c1"]).orderBy("seq").collect()]
    assert out == [(0, "2", None), (1, "1", "a")]


def test_filter_above_strict_and_nan(spark):
    df = spark.createDataFrame([(1, 20.0, 21.0), (2, float("nan"), 30.0)], "id int, x double, y double")
    got = sorted((r.id, r.col_name, r.v) for r in R.filter_above(df, ["x", "y"], 20, ids=["id"]).collect())
    assert got == [(1, "y", 21.0), (2, "y", 30.0)]


def test_coerce_drop(spark):
    df = spark.createDataFrame([("1", "2"), ("x", "3"), ("4", " 5 ")], "a string, b string")
    assert [tuple(r) for r in R.cast_numeric_coerce_drop(df).collect()] == [(1.0, 2.0), (4.0, 5.0)]
    with pytest.raises(Exception):
        R.cast_numeric_strict(df).collect()


def test_a_kernel_holds_a_bounded_number_of_pixels(monkeypatch):
    """Batches of any size go through in pieces, with the same pixels as all at once."""
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 255, 16).astype(float).tolist() if k % 7 else [1.0] * (k % 5) for k in range(200)]
    rows = pa.array([*images, None], pa.list_(pa.float64()))
    whole = {f: G._filtered(rows, 4, f) for f in (G.mean_pixels, G.sobel_pixels)}
    held = []
    monkeypatch.setattr(G, "PIXELS", 100)
    for f, want in whole.items():
        def seen(img, f=f):
            held.append(img.size)
            return f(img)
        assert G._filtered(rows, 4, seen).equals(want)
    assert max(held) <= 100 and len(held) > 20
