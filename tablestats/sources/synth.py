"""The load-test table - n rows of c uniform integer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synth_ints(spark: SparkSession, n: int = 10_000_000, c: int = 20, low: int = 1000, high: int = 10000,
               seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Columns ``Product_1..Product_c`` with integers in ``[low, high)``.

    Generated on the executors from ``range``; each column uses its own
    seeded ``rand`` so the table is reproducible for a fixed partitioning.
    """
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    span = high - low
    return base.select(*[(F.floor(F.rand(seed + j) * span) + low).cast("int").alias(f"Product_{j + 1}")
                         for j in range(c)])
