"""Aggregates, groups, heavy hitters, lists, intervals and streams whose memory has a bound."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablestats.functions import udf as U
from tablestats.functions.quantiles import QuantileDigest
from tablestats.operators import heavy as H
from tablestats.operators import lookup as L
from tablestats.operators import rows as R
from tablestats.session import work_dir
from tablestats.streaming.partials import VERSIONED_DDL, corrected_report, stream_corrected_partials

DIGEST_DDL = "q double, value double, n bigint, error bigint"


def ranks_hold(rows, values):
    values = np.sort(values)
    for r in rows:
        below, upto = np.searchsorted(values, r["value"], "left"), np.searchsorted(values, r["value"], "right")
        assert r["n"] == len(values) and below <= r["q"] * r["n"] + r["error"] and upto >= r["q"] * r["n"] - r["error"]


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_quantile_digest_as_a_tree_of_states(spark, parts):
    rng = np.random.default_rng(parts)
    x = np.concatenate([rng.normal(size=20_000), np.full(5000, 0.25), rng.exponential(size=5000) * 1e6])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(parts)
    rows = U.udaf_tree(df, QuantileDigest("x", [0, 0.01, 0.3, 0.5, 0.9, 1.0], 64), DIGEST_DDL, fan=3).collect()
    ranks_hold(rows, x)
    assert 0 < rows[0]["error"] < 0.15 * len(x)
    small = U.udaf_tree(df.limit(50).repartition(parts), QuantileDigest("x", [0.5], 64), DIGEST_DDL, fan=3).first()
    assert small["n"] == 50 and small["error"] <= 1


def test_tree_by_key_nulls_and_empty_tables(spark):
    rows = [(k, float(v)) for k in ("a", "b", None) for v in range(300)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    got = U.udaf_tree(df, QuantileDigest("x", [0.5], 4096), "k string, " + DIGEST_DDL, keys="k", fan=2).collect()
    assert {(r["k"], r["n"], r["value"]) for r in got} == {("a", 300, 149.0), ("b", 300, 149.0), (None, 300, 149.0), ("c", 0, None)}
    none = df.limit(0)
    assert U.udaf_tree(none, QuantileDigest("x", [0.5]), "k string, " + DIGEST_DDL, keys="k").collect() == []
    assert U.udaf_tree(none, QuantileDigest("x", [0.5]), DIGEST_DDL).first()["n"] == 0


def test_merge_order_does_not_break_the_bound():
    rng = random.Random(4)
    digest, parts, values = QuantileDigest("x", [i / 20 for i in range(21)], 16), [], []
    for _ in range(60):
        x = [rng.expovariate(1) for _ in range(rng.randrange(0, 200))]
        values += x
        parts.append(digest.update(digest.init(), pd.DataFrame({"x": pd.Series(x, dtype="float64")})))
    while len(parts) > 1:
        a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
        parts.append(digest.merge(a, b))
    ranks_hold(digest.finish(parts[0]).to_dict("records"), values)


def test_streamed_groups_see_their_rows_in_order_and_in_pieces(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = [(i % 3 == 0 and "hot" or (None if i % 5 == 0 else f"k{i % 11}"), i) for i in range(3000)]
        df = spark.createDataFrame(rows, "k string, v bigint").repartition(6)

        def step(state, pdf):
            assert len(pdf) <= 100 and pdf["v"].is_monotonic_increasing and (state[0] is None or pdf["v"].iloc[0] > state[0])
            return (pdf["v"].iloc[-1], state[1] + len(pdf), state[2] + 1), pdf.assign(before=state[1] + np.arange(len(pdf)))

        def finish(state, key):
            return pd.DataFrame({"k": [key["k"]], "v": [-state[2]], "before": [state[1]]})

        got = U.udf_grouped_stream(df, "k", "v", lambda: (None, 0, 0), step, "k string, v bigint, before bigint", finish).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, count = [], Counter()
    for k, v in rows:
        want.append((k, v, count[k]))
        count[k] += 1
    assert sorted(((r["k"], r["v"], r["before"]) for r in got if r["v"] >= 0), key=str) == sorted(want, key=str)
    ends = {r["k"]: (r["before"], -r["v"]) for r in got if r["v"] < 0}
    assert {k: n for k, (n, _) in ends.items()} == dict(count) and ends["hot"][1] >= 10


def test_results_of_small_groups_leave_together(spark):
    """Thousands of groups of one row: one frame, and so one Arrow batch, for all but those of another type."""
    class Dealt:
        sparkSession = spark

        def repartition(self, *args):
            return self

        sortWithinPartitions = repartition

        def mapInPandas(self, run, schema):
            return run

    def step(state, pdf):
        # The group 777 answers in floats, which must not touch the others' 54-bit integers.
        return state, pdf.assign(v=[0.5]) if pdf["k"].iloc[0] == 777 else pdf

    rows = pd.DataFrame({"k": np.arange(3000), "v": 2**53 + 1})
    run = U.udf_grouped_stream(Dealt(), "k", "v", lambda: None, step, "k bigint, v bigint", lambda state, key: pd.DataFrame({"k": [key["k"]], "v": [-1]}))
    out = list(run(iter([rows[:1000], rows[:0], rows[1000:]])))
    assert [len(x) for x in out] == [2 * 777, 1, 2 * 3000 - 2 * 777 - 1]
    v = pd.concat([out[0], out[2]])["v"]
    assert v.dtype == np.int64 and sorted(set(v)) == [-1, 2**53 + 1] and out[1]["v"].tolist() == [0.5]


def brute_top(keys, k):
    return sorted(Counter(keys).items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k]


@pytest.mark.parametrize("keys,proven", [
    ([f"h{i % 4}" if i % 2 else f"r{i}" for i in range(6000)] + [None] * 900, True),
    ([f"r{i}" for i in range(500)], False),
    ([f"r{i % 700}" for i in range(6000)], False),
    ([], True), (["a"], True), ([None, None, "b"], True),
])
def test_heavy_hitters_are_exact(spark, keys, proven):
    df = spark.createDataFrame([(x,) for x in keys], "key string").repartition(5)
    for k in (3, 5):
        got = [(r["item"], r["frequency"]) for r in H.heavy_hitters(df, "key", k, counters=50).collect()]
        assert got == brute_top(keys, k)


def test_frequent_keys_are_counted_without_a_shuffle_of_all(spark):
    df = spark.createDataFrame([(f"h{i % 5}" if i % 2 else f"r{i}",) for i in range(8000)], "key string").repartition(4)
    rows = H.summaries(df, "key", 50).collect()
    assert len(rows) <= 4 * 51 and sum(r["error"] for r in rows) < 8000 / 50 + 4
    plan = H.heavy_hitters(df, "key", 5, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_reduced_is_low_by_what_it_says():
    counts = {f"k{i}": i % 17 + 1 for i in range(300)}
    kept, off = H.reduced(dict(counts), 40)
    assert len(kept) <= 40 and all(counts[k] == c + off for k, c in kept.items()) and all(counts[k] <= off for k in counts if k not in kept)
    assert H.reduced({"a": 1}, 1) == ({"a": 1}, 0)


@pytest.mark.parametrize("block", [None, 3, 1000])
def test_filtered_lists_in_row_order(spark, block):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, float("nan"), rng.uniform(0, 40)]), rng.randrange(40), 7.0) for i in range(500)]
    df = spark.createDataFrame(rows, "i bigint, a double, b int, c double").repartition(6)
    got = R.filter_above_lists(df, ["a", "b", "c"], 20, "i", block_rows=block).collect()
    want = {c: [float(r[k]) for r in rows if r[k] is not None and r[k] > 20] for k, c in ((1, "a"), (2, "b"), (3, "c"))}
    lists = {c: [] for c in want}
    for r in sorted(got, key=lambda r: r["pos"]):
        assert r["pos"] == len(lists[r["col_name"]])
        lists[r["col_name"]].append(r["v"])
    assert lists == want
    assert R.filter_above_lists(df.limit(0), ["a"], 20, "i").collect() == []


def test_filtered_lists_in_input_order(spark):
    d = work_dir(spark, "lists")
    spark.range(0, 1000, 1, 4).selectExpr("id", "cast(id % 50 as double) x").write.mode("overwrite").parquet(d + "/t")
    got = R.filter_above_lists(spark.read.parquet(d + "/t"), ["x"], 20, None, ids=["id"]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["pos"])] == [i for i in range(1000) if i % 50 > 20]


def test_peak_over_intervals_equals_the_exploded_form(spark):
    rng = random.Random(6)
    rows = [(s := rng.randrange(100), s + rng.randrange(-3, 30), rng.randrange(1, 50)) for _ in range(400)] + [(None, 5, 3), (5, None, 3), (5, 9, None), (10, 10, 1000)]
    use = Counter()
    for s, e, z in rows:
        if None not in (s, e, z):
            for t in range(s, e + 1):
                use[t] += z
    for n in (1, 9):
        df = spark.createDataFrame(rows, "s int, e int, z bigint").repartition(n)
        r = L.peak_interval_usage(df, "s", "e", "z").first()
        assert (r["peak"], r["at"]) == (max(use.values()), min(t for t in use if use[t] == max(use.values())))
        swept = {(x["at"], x["after"]): x["usage"] for x in L.interval_usage(df, "s", "e", "z").collect()}
        assert all(use[at] == u for (at, after), u in swept.items() if after == 0)
    assert tuple(L.peak_interval_usage(df.limit(0), "s", "e", "z").first()) == (0, None)


def _sent(spark, base, rows):
    spark.createDataFrame([(n, v, float(t), c, float(lo), float(hi), f) for n, v, t, c, lo, hi, f in rows], VERSIONED_DDL).coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_corrections_replace_whatever_the_order_and_over_restarts(spark):
    first = [("a", 1, 10, 2, 1, 9, {"x": 2}), ("b", 1, 100, 1, 100, 100, {"y": 1})]
    second = [("a", 3, 6, 3, 1, 3, {"x": 1, "z": 2}), ("c", 7, 5, 1, 5, 5, None)]
    late = [("a", 2, 999, 9, -5, 500, {"w": 50}), ("b", 1, 100, 1, 100, 100, {"y": 1})]
    want = (5, 111.0, 111.0 / 5, 1.0, 100.0, [("z", 2), ("x", 1), ("y", 1)])

    def report(r):
        return (*tuple(r)[:5], [tuple(x) for x in r["most_common"]])

    for order in ([first, second, late], [late, second, first]):
        base = work_dir(spark, "corrected")
        for k, rows in enumerate(order):
            _sent(spark, base, rows)
            if k != 1:  # the query ends and is started again in between
                got = stream_corrected_partials(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
        assert report(got.first()) == want
        assert report(corrected_report(spark, f"{base}/out").first()) == want
    assert tuple(corrected_report(spark, f"{base}/nothing").first())[:3] == (0, 0.0, 0.0)
