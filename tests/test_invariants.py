"""Invariants from the test strategy: results do not depend on partitioning,
chunked = unchunked, z-scores have mean 0 and std 1."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF

QUERIES = ["column_profile", "correlation_matrix", "partials_merge", "frequency_top5", "chunk_rows", "merge_by_tag",
           "last_writer_edges", "group_by_dependency", "best_fit_lookup", "grid_sobel", "infer_schema_profile",
           "udf_grouped", "row_slice", "peak_step_usage"]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_same_result_for_1_and_8_partitions(spark, name):
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = _rows(q(spark, SF))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # many input splits
        eight = _rows(q(spark, SF))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert one == eight


def test_zscore_mean_zero_std_one(spark):
    from tablestats.operators.zscore import zscore
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_quantity", "l_extendedprice")
    r = zscore(li).agg(F.avg("l_quantity"), F.stddev_pop("l_quantity"), F.avg("l_extendedprice")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9 and abs(r[2]) < 1e-9
