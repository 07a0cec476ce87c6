"""User functions on slices of rows, on groups, on sorted groups as a stream, and as aggregates.

The built-in column functions stay the fast path; these are for logic that
has no built-in form. Data crosses to Python in Arrow batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablestats.session import checkpoint_root

def udf_rowwise(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """apply a row-local pandas function to every Arrow batch (tag ``c``:
    the outputs of the slices concatenate). ``fn`` must not depend on which
    rows share a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def udf_grouped(df: DataFrame, keys, fn: Callable[[pd.DataFrame], pd.DataFrame], schema,
                max_group_rows: int | None = None, buckets: int | None = None,
                per_group: bool = True, allow_keyless: bool = False) -> DataFrame:
    """run an order- or group-dependent pandas function on whole groups.

    A group is one pandas frame in one task, by the nature of such a function; a
    key that outgrows a task's memory needs logic that takes it piece by piece
    (``udf_grouped_stream``) or split into partial + merge (``udaf_tree``). ``max_group_rows`` is the caller's own limit (default
    none): a larger frame raises in its task.

    Small groups are packed: rows are hashed on the keys into ``buckets`` (by
    default the shuffle partition setting) and each bucket is one pandas frame
    holding whole groups - one Python call per bucket instead of per group
    (thousands of tiny groups otherwise cost milliseconds each). With
    ``per_group=False`` ``fn`` receives that frame (several complete groups) and
    can work vectorised, e.g. with ``groupby().cumsum()``; otherwise pandas splits
    it and calls ``fn`` per group. The input is read once, with one shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys and not allow_keyless:
        raise ValueError("udf_grouped without keys runs the whole table as one group; pass allow_keyless=True")
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_bucket")
        if max_group_rows is not None and len(pdf) > max_group_rows:
            biggest = int(pdf.groupby(keys, sort=False, dropna=False).size().max()) if keys else len(pdf)
            if biggest > max_group_rows:
                raise ValueError(f"a group has {biggest} rows (> {max_group_rows}); use a partial + merge aggregate")
        if not per_group:
            return fn(pdf)
        parts = [fn(g) for _, g in pdf.groupby(keys, sort=False, dropna=False)] if keys else [fn(pdf)]
        return pd.concat(parts, ignore_index=True) if parts else pdf.iloc[0:0]

    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)) if keys else F.lit(0)
    return df.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(run, schema)


def udf_grouped_stream(df: DataFrame, keys, order_by, start: Callable[[], object],
                       step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame | None]], schema,
                       finish: Callable[[object, dict], pd.DataFrame | None] | None = None) -> DataFrame:
    """F3 for groups of any size: a group's rows, in order, pass through the function in pieces.

    Rows are dealt out by ``keys`` and sorted by keys and ``order_by`` (Spark's
    sort spills), then stream through in Arrow batches. For every group ``start()`` makes a
    state; ``step(state, rows)`` gets the group's next rows, at most a batch, and
    returns the state to go on with and rows of the result (or None);
    ``finish(state, key)``, after the group's last rows, may return more rows. A task holds one
    batch, one state and ``HELD_ROWS`` of the result, however large a group is: the rows of many small
    groups leave as one frame. Rows that tie in ``order_by`` come in no fixed order.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_by = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    if not keys:
        raise ValueError("a stream of groups needs keys")

    def results(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
        state, key = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            head = pdf[keys]
            same = (head.eq(head.shift()) | head.isna() & head.shift().isna()).all(axis=1).to_numpy()
            starts = [0, *(np.flatnonzero(~same[1:]) + 1)]
            owners = zip(*[pdf[k].iloc[starts].tolist() for k in keys])
            for own, lo, hi in zip(owners, starts, [*starts[1:], len(pdf)]):
                own = tuple(None if pd.isna(x) else x for x in own)
                if own != key:
                    if key is not None and finish:
                        yield finish(state, dict(zip(keys, key)))
                    state, key = start(), own
                state, out = step(state, pdf.iloc[lo:hi].reset_index(drop=True))
                yield out
        if key is not None and finish:
            yield finish(state, dict(zip(keys, key)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        kind, size = None, 0
        for out in results(batches):
            if out is None or not len(out):
                continue
            # Only frames of the same types join: no value changes its type on the way.
            own = (*out.columns, *out.dtypes)
            if held and (own != kind or size + len(out) > HELD_ROWS):
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held, size = [], 0
            held.append(out)
            kind, size = own, size + len(out)
        if held:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]

    # A stated number of partitions, which adaptive execution leaves as it is: the work is in the function, not in the bytes.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order_by).mapInPandas(run, schema)


#: Rows of a stream of groups' result that a task sends at once.
HELD_ROWS = 10_000


class Aggregate(Protocol):
    """A user aggregate whose state only its own code understands. States are pickled; merging must be associative."""

    def init(self) -> object: ...

    def update(self, state: object, rows: pd.DataFrame) -> object: ...

    def merge(self, a: object, b: object) -> object: ...

    def finish(self, state: object) -> pd.DataFrame: ...


#: States merged by one call, and groups whose states a task holds before it passes them on.
FAN, HELD_GROUPS = 16, 10_000


def udaf_tree(df: DataFrame, aggregate: Aggregate, schema, keys=(), fan: int = FAN) -> DataFrame:
    """F4 with an opaque state: init, update, merge and finish are the user's code.

    Every task folds its rows into one state per group of ``keys`` (``update``, an Arrow
    batch at a time). The states then merge as a tree, ``fan`` tasks' at a time: a round is a
    grouped merge of neighbouring tasks' states, written to the checkpoint folder, until each
    group has one; no task ever holds more than two states and the one that comes in. ``finish`` turns the last
    state into rows of ``schema``, the keys first. Without keys there is one group, also on
    an empty table.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    checkpoint_root(df.sparkSession)
    kinds = [df.schema[k] for k in keys]
    ddl = T.StructType([*[T.StructField(f.name, f.dataType) for f in kinds], T.StructField("_part", T.LongType()), T.StructField("_state", T.BinaryType())])

    def rows_of(held: dict, part: int) -> pd.DataFrame:
        return pd.DataFrame([(*k, part, pickle.dumps(s)) for k, s in held.items()], columns=[*keys, "_part", "_state"]).astype({k: object for k in keys})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        part = TaskContext.get().partitionId()
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, rows in groups:
                key = tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,)))
                held[key] = aggregate.update(held[key] if key in held else aggregate.init(), rows)
            if len(held) > HELD_GROUPS:
                yield rows_of(held, part)
                held = {}
        if held:
            yield rows_of(held, part)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, part = None, None, 0
        for pdf in batches:
            for *key, at, dumped in pdf[[*keys, "_part", "_state"]].itertuples(index=False, name=None):
                key = (*(None if pd.isna(x) else x for x in key), at // fan)
                other = pickle.loads(dumped)
                if now == key:
                    state = aggregate.merge(state, other)
                    continue
                if now is not None:
                    yield rows_of({now[:-1]: state}, part)
                now, state, part = key, other, at // fan
        if now is not None:
            yield rows_of({now[:-1]: state}, part)

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *key, dumped in pdf[[*keys, "_state"]].itertuples(index=False, name=None):
                out = aggregate.finish(pickle.loads(dumped))
                for i, (name, value) in enumerate(zip(keys, key)):
                    out.insert(i, name, [value] * len(out))
                yield out

    parts = df.mapInPandas(fold, ddl).checkpoint()
    most = parts.agg(F.max("_part")).first()[0]
    if most is None:
        if keys:
            return df.sparkSession.createDataFrame([], schema)
        return df.sparkSession.createDataFrame(aggregate.finish(aggregate.init()), schema)
    while True:
        # Neighbours come to one task, in order; a task's several states of a group as well.
        dealt = parts.repartition(*keys, F.floor(F.col("_part") / fan)).sortWithinPartitions(*keys, "_part")
        parts = dealt.mapInPandas(merge, ddl).checkpoint()
        if most < fan:
            return parts.mapInPandas(end, schema)
        most //= fan


def udaf_partial(df: DataFrame, partial: Callable[[pd.DataFrame], pd.DataFrame], partial_schema,
                 merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """user partial aggregate per Arrow batch, merged with built-in aggregates.

    ``partial`` turns a batch into a few rows of partial state; ``merge``
    folds the (small) partial table with ordinary ``agg`` expressions. The
    partial table is written once (reliable checkpoint), so a merge that reads it
    twice does not run the Python stage over the input twice, and nothing stays
    cached.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = partial(pdf)
            if len(out):
                yield out
    checkpoint_root(df.sparkSession)
    return merge(df.mapInPandas(run, partial_schema).checkpoint())


MOMENTS_SCHEMA = "n long, s double, m2 double, lo double, hi double"


def _moments_partial(col: str):
    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[col].to_numpy(dtype=np.float64)
        v = v[~np.isnan(v)]
        if v.size == 0:
            return pd.DataFrame({"n": [], "s": [], "m2": [], "lo": [], "hi": []})
        mean = v.mean()
        return pd.DataFrame({"n": [v.size], "s": [v.sum()], "m2": [float(((v - mean) ** 2).sum())],
                             "lo": [v.min()], "hi": [v.max()]})
    return partial


def _moments_merge(parts: DataFrame) -> DataFrame:
    """Chan's merge: M2 = sum(m2_k) + sum(n_k * (mean_k - mean)^2), in two
    passes over the partial table (global mean first, as a scalar subquery)."""
    total = parts.agg(F.struct(F.sum("n").alias("n"), F.sum("s").alias("s")).alias("t")).scalar()
    mean = total["s"] / total["n"]
    dev = F.col("s") / F.col("n") - mean
    out = parts.agg(F.sum("n").alias("n"), F.first(mean).alias("mean"),
                     F.sum(F.col("m2") + F.col("n") * dev * dev).alias("_m2"),
                     F.min("lo").alias("min"), F.max("hi").alias("max"))
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), "mean",
                      F.when(F.col("n") > 0, F.sqrt(F.col("_m2") / F.col("n"))).alias("std_pop"), "min", "max")


def moments(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, population std, min and max of one column via ``udaf_partial``."""
    return udaf_partial(df.select(col), _moments_partial(col), MOMENTS_SCHEMA, _moments_merge)
