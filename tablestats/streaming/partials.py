"""The partial-aggregate merge as a Structured Streaming job.

Partials arrive as parquet files in a folder, with their frequency maps. A
streaming aggregate by frequency key keeps the running fold in the state store
(sum of counts per key; the four numbers under a key of their own), and every
trigger writes the complete state as a new version, ``epoch=N``: readers of an
earlier version are never disturbed, and a restarted trigger rewrites its own.
Versions before the last two are deleted. No watermark: the fold has no event
time and no late-data rule. With ``availableNow`` the query processes what is in
the folder and stops; with a processing-time trigger it keeps folding new files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablestats.operators.partials import PARTIAL_DDL, merge_partials

STATE_DDL = "key string, count bigint, total_sum double, item_count bigint, min_value double, max_value double"


def running_fold(stream: DataFrame) -> DataFrame:
    """State rows: one per frequency key, and one (NULL key) with the four numbers."""
    number = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("bigint").alias("count"), "total_sum", "item_count", "min_value", "max_value")
    gone = {c: F.lit(None).cast(t).alias(c) for c, t in (("total_sum", "double"), ("item_count", "bigint"), ("min_value", "double"), ("max_value", "double"))}
    counts = F.transform(F.coalesce(F.map_entries("frequency_map"), F.array()), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("count"), *gone.values()))
    rows = stream.select(F.explode(F.concat(F.array(number), counts)).alias("r")).select("r.*")
    return rows.groupBy("key").agg(F.sum("count").alias("count"), F.sum("total_sum").alias("total_sum"), F.sum("item_count").alias("item_count"),
                                   F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def current_report(spark: SparkSession, out_path: str, k: int = 5) -> DataFrame:
    """The report of the last complete version; the empty report if there is none."""
    try:
        state = spark.read.parquet(out_path)
        last = state.agg(F.max("epoch")).first()[0]
        state = state.where(F.col("epoch") == last)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        state = spark.createDataFrame([], STATE_DDL)
    return merge_partials(state.where("key IS NULL"), state.where("key IS NOT NULL").select("key", "count"), k)


def _start(state: DataFrame, out_path: str, checkpoint_path: str, available_now: bool):
    """The running query that writes the complete state at every trigger, the last two versions kept."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/epoch={epoch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    writer = state.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_path).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def stream_partials_merge(spark: SparkSession, source_dir: str, out_path: str, checkpoint_path: str,
                          available_now: bool = True, max_files_per_trigger: int | None = None, k: int = 5):
    """Fold every partial file in ``source_dir`` and return the merged report.

    ``checkpoint_path`` (in the shared checkpoint folder) lets a restarted query
    resume without refolding. With ``available_now=False`` the query keeps running
    on new files and its ``StreamingQuery`` handle is returned instead (use
    ``current_report``).
    """
    reader = spark.readStream.schema(PARTIAL_DDL)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    folded = running_fold(reader.parquet(source_dir))

    query = _start(folded, out_path, checkpoint_path, available_now)
    if not available_now:
        return query
    query.awaitTermination()
    return current_report(spark, out_path, k)


#: Partials that may be sent again: ``version`` orders those of a node, the highest counts.
VERSIONED_DDL = "node string, version bigint, " + PARTIAL_DDL
_FIELDS = ["total_sum", "item_count", "min_value", "max_value", "frequency_map"]


def latest_by_node(stream: DataFrame) -> DataFrame:
    """State rows: of every node the partial with the highest version, whatever order they came in.

    Of several with one version the largest by its numbers counts, so that the state does not depend on arrival.
    """
    maps = F.array_sort(F.map_entries("frequency_map"))
    order = F.struct("version", *_FIELDS[:-1], maps.alias("entries"))
    return stream.groupBy("node").agg(F.max("version").alias("version"), F.max_by(F.struct(*_FIELDS), order).alias("p")).select("node", "version", "p.*")


def corrected_report(spark: SparkSession, out_path: str, k: int = 5) -> DataFrame:
    """The merged report of every node's last partial, as of the last complete version of the state."""
    try:
        state = spark.read.parquet(out_path)
        state = state.where(F.col("epoch") == state.agg(F.max("epoch")).first()[0])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        state = spark.createDataFrame([], VERSIONED_DDL)
    counts = state.select(F.explode("frequency_map").alias("key", "count"))
    return merge_partials(state.drop("frequency_map"), counts, k)


def stream_corrected_partials(spark: SparkSession, source_dir: str, out_path: str, checkpoint_path: str,
                              available_now: bool = True, max_files_per_trigger: int | None = None, k: int = 5):
    """Fold partials that nodes may correct: one sent again replaces the node's earlier one.

    The state, kept by Spark's state store, is one row per node, so a correction
    needs no memory of what was added before; late files with an older version change
    nothing. Every trigger writes the state as a new version (see ``stream_partials_merge``), and a query that is started again with the same
    ``checkpoint_path`` goes on from it. Returns the report, or the running query with ``available_now=False``.
    """
    reader = spark.readStream.schema(VERSIONED_DDL)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    query = _start(latest_by_node(reader.parquet(source_dir)), out_path, checkpoint_path, available_now)
    if not available_now:
        return query
    query.awaitTermination()
    return corrected_report(spark, out_path, k)
