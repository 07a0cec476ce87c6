"""Edge inputs for every aggregate: NULL, NaN, single row, empty table, text column, ragged row."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tablestats.operators import profile as P
from tablestats.operators.correlation import correlation_matrix
from tablestats.operators.zscore import zscore
from tablestats.sources import text_table as TT


def test_zscore_null_nan_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 3.0)], "id int, x double")
    got = {r.id: r.x for r in zscore(df, ["x"], keep=["id"]).collect()}
    assert got[2] is None and got[3] is None and got[1] == pytest.approx(-1.0) and got[4] == pytest.approx(1.0)
    empty = spark.createDataFrame([], "id int, x double")
    assert zscore(empty, ["x"], keep=["id"]).collect() == []


def test_zscore_single_row(spark):
    df = spark.createDataFrame([(5.0,)], "x double")
    assert [r.x for r in zscore(df).collect()] == [0.0]


def test_correlation_with_nulls_and_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.0), (None, 1.0), (4.0, 8.0)], "x double, y double")
    m = {(r.col_i, r.col_j): r.corr for r in correlation_matrix(df).collect()}
    assert m[("x", "y")] == pytest.approx(1.0)  # pairwise deletion
    empty = spark.createDataFrame([], "x double, y double")
    assert {r.corr for r in correlation_matrix(empty).collect()} == {0.0}


def test_profile_single_row_and_all_null(spark):
    df = spark.createDataFrame([(7.0, None)], "x double, y double")
    rows = {r.col_name: r for r in P.column_profile(df).collect()}
    assert rows["x"].std_pop == 0.0 and rows["x"].is_const == 1 and rows["x"].mean_above == 0.0
    assert rows["y"].n == 0 and rows["y"].is_const == 1 and rows["y"]["sum"] is None


def test_profile_rejects_all_text(spark):
    df = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(ValueError):
        P.column_profile(df)


def test_ragged_rows_in_exact_csv(spark):
    d = tempfile.mkdtemp(prefix="ts-edge-")
    with open(os.path.join(d, "r.csv"), "w") as f:
        f.write("a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    df = TT.read_table(spark, d, exact=True)
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2, 3), (4, 5, None), (6, 7, 8)]
    with pytest.raises(Exception):
        TT.read_table(spark, d, exact=True, strict=True).collect()


def test_fast_csv_read(spark):
    d = tempfile.mkdtemp(prefix="ts-edge-")
    with open(os.path.join(d, "q.csv"), "w") as f:
        f.write('a,b\n1,"x,y"\n2,z\n')
    df = TT.read_table(spark, d)
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x,y"), (2, "z")]


def test_missing_file_raises(spark):
    with pytest.raises(Exception):
        TT.read_table(spark, "/nonexistent/path/x.csv", exact=True).collect()


def test_constant_column_has_exactly_zero_variance_across_partitions(spark):
    df = spark.range(100000).repartition(7).select(F.col("id").cast("double").alias("x"), F.lit(0.1).alias("c"))
    m = {(r.col_i, r.col_j): r.corr for r in correlation_matrix(df).collect()}
    assert m[("c", "c")] == 0.0 and m[("x", "c")] == 0.0 and m[("x", "x")] == 1.0
