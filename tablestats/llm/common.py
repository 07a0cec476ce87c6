"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablestats.session import checkpoint_root, work_dir

#: Words are runs of anything but space and the five ASCII controls 9-13
#: (``bytes.split`` splits on exactly these six).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD_PATTERN", "table", "saved", "written", "checkpoint_root", "work_dir", "column", "free_names", "small_batches",
           "shuffles_released", "shuffle_partitions", "broadcast_if_small"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder (survives lost executors)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, **options: str) -> DataFrame:
    """The rows written once as a compressed table in the shared checkpoint folder, and read back; ``options`` are the writer's."""
    path = work_dir(df.sparkSession, "table") + "/rows"
    df.write.options(**options).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of texts in an Arrow batch: with texts of up to 100 KB a batch stays near 100 MB.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size for texts, unless it is lower already.

    Python and the JVM hold a few batches each; at Spark's 10,000 rows those of long
    texts are most of a task's memory.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the query that made them ends, not when the driver next collects garbage.

    For steps that are saved or written each: later ones read the saved rows.
    Before Spark 4.1 the setting is unknown and does nothing.
    """
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows and bytes of text that a join's side may have to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def broadcast_if_small(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` marked for broadcast where ``like``, of the same rows and texts, is small as counted; else as it is, for a shuffled join."""
    texts = [F.coalesce(F.sum(F.octet_length(f"`{f.name}`")), F.lit(0)) for f in like.schema.fields if f.dataType.typeName() in ("string", "binary")]
    rows, size = like.agg(F.count(F.lit(1)), sum(texts, F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def column(df: DataFrame, name: str):
    """Column ``name`` of ``df``, whatever characters it holds."""
    return df["`" + re.sub("`", "``", name) + "`"]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out
