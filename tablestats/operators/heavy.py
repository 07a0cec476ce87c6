"""Mergeable heavy hitters (D11): the exact most common keys without shuffling every key.

Each task keeps a summary of at most ``counters`` keys: when a batch would make it
more, the size of the first count that does not fit is taken off all counts and what falls to
zero goes. A key's count in a summary is too low by at most what was taken off there;
summaries merge by adding counts, and what was taken off adds up to the error E, at
most the number of rows over the number of counters.

The candidates are the keys whose count plus E reaches the k-th largest count. They are
counted exactly in a second pass. A key that is no candidate has fewer than the k-th
largest count of rows, so it can neither be among the first k nor tie with them, provided
that keys in no summary cannot either: E is below the k-th largest count. Where that
proof fails (no key is frequent enough), all keys are counted as ``merge_frequencies`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablestats.operators.partials import merge_frequencies
from tablestats.session import checkpoint_root

COUNTERS = 2000
#: Most candidates that are broadcast; more are joined by a shuffle of the candidates' rows.
MAX_BROADCAST = 100_000


def reduced(counts: dict, counters: int) -> tuple[dict, int]:
    """At most ``counters`` of the counts, lowered by what the next one had; that number."""
    if len(counts) <= counters:
        return counts, 0
    off = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - counters - 1)[len(counts) - counters - 1])
    return {k: c - off for k, c in counts.items() if c > off}, off


def summaries(df: DataFrame, key_col: str, counters: int = COUNTERS) -> DataFrame:
    """(key, count, error): per task its summary, and one row without a key for the rows of the null key and the task's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        error = nulls = 0
        for b in batches:
            found = pc.value_counts(b.column(0))
            for key, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                if key is None:
                    nulls += n
                else:
                    held[key] = held.get(key, 0) + n
            held, off = reduced(held, counters)
            error += off
        rows = [*held.items(), (None, nulls)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64()), pa.array([0] * len(held) + [error], pa.int64())], ["key", "count", "error"])

    return df.select(F.col(key_col).cast("string").alias("key")).mapInArrow(run, "key string, count bigint, error bigint")


def heavy_hitters(df: DataFrame, key_col: str, k: int = 5, counters: int = COUNTERS) -> DataFrame:
    """(item, frequency) of the ``k`` most common keys, ties by key, null first; exact in any case."""
    checkpoint_root(df.sparkSession)
    merged = summaries(df, key_col, counters).groupBy("key").agg(F.sum("count").alias("count"), F.sum("error").alias("error")).checkpoint()
    error = merged.agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]
    merged = merged.where("count > 0")
    first = merged.orderBy(F.desc("count")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).first()
    rows = df.select(F.col(key_col).cast("string").alias("key"))
    if first["n"] < k or error >= first["least"]:
        if error:  # no proof: every key counts
            return merge_frequencies(rows.groupBy("key").agg(F.count(F.lit(1)).alias("count")), k)
        return merge_frequencies(merged, k)  # nothing was taken off anywhere
    chosen = merged.where(F.col("count") + error >= first["least"]).select("key").checkpoint()
    if chosen.count() <= MAX_BROADCAST:
        chosen = F.broadcast(chosen)
    own = rows.join(chosen.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    return merge_frequencies(own.groupBy("key").agg(F.count(F.lit(1)).alias("count")), k)
