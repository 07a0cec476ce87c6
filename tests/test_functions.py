import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablestats.functions import udf as U
from tablestats.operators.partials import merge_partials
from tablestats.plans.steps import NamedSteps
from tablestats.session import work_dir
from tablestats.streaming.partials import stream_partials_merge


def test_named_steps_order_and_reuse(spark):
    steps = (NamedSteps()
             .add("doubled", lambda d: d.select((F.col("id") * 2).alias("id")), "src")
             .add("big", lambda d: d.where("id > 10"), "doubled")
             .add("small", lambda d: d.where("id <= 10"), "doubled"))
    out = steps.run(src=spark.range(10))
    assert out["big"].count() + out["small"].count() == 10
    assert out["doubled"].storageLevel.useMemory  # used twice -> persisted
    with pytest.raises(KeyError):
        NamedSteps().add("x", lambda d: d, "missing").run()


def test_udf_rowwise(spark):
    df = spark.range(100).selectExpr("id", "cast(id as double) v").repartition(3)
    out = U.udf_rowwise(df, lambda p: pd.DataFrame({"id": p["id"], "w": p["v"] * 2}), "id long, w double")
    assert sorted(r.w for r in out.collect()) == [2.0 * i for i in range(100)]


def test_udf_grouped_guard(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "k long, v double")
    fn = lambda p: pd.DataFrame({"k": p["k"].iloc[:1], "s": [p["v"].sum()]})
    got = {r.k: r.s for r in U.udf_grouped(df, "k", fn, "k long, s double").collect()}
    assert got == {1: 3.0, 2: 5.0}
    with pytest.raises(Exception, match="a group has 2 rows"):
        U.udf_grouped(df, "k", fn, "k long, s double", max_group_rows=1).collect()
    plan = U.udf_grouped(df, "k", fn, "k long, s double")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # one pass over the input


def test_moments_match_builtin(spark):
    df = spark.range(1, 5001).selectExpr("cast(id * 1.5 + 1000000 as double) v").repartition(4)
    m = U.moments(df, "v").first()
    ref = df.agg(F.count("v"), F.avg("v"), F.stddev_pop("v"), F.min("v"), F.max("v")).first()
    assert m.n == ref[0] and math.isclose(m.mean, ref[1], rel_tol=1e-12)
    assert math.isclose(m.std_pop, ref[2], rel_tol=1e-9) and (m.min, m.max) == (ref[3], ref[4])


def test_stream_partials_merge(spark):
    from tablestats.operators.partials import PARTIAL_DDL
    base = work_dir(spark, "test-stream")
    rows = [(500.0, 100, 1.0, 25.0, {"apple": 10, "banana": 15}), (750.0, 150, -5.0, 30.0, {"apple": 5, "orange": 20}),
            (300.0, 50, 2.0, 15.0, {"banana": 10, "orange": 10}), (1200.0, 200, 0.0, 50.0, {"apple": 20, "grape": 30})]
    parts = spark.createDataFrame(rows, PARTIAL_DDL)
    parts.repartition(4).write.parquet(f"{base}/in")
    r = stream_partials_merge(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1).first()
    assert tuple(r) == tuple(merge_partials(parts).first())
    assert tuple(r)[:5] == (500, 2750.0, 5.5, -5.0, 50.0)
    assert [tuple(x) for x in r.most_common] == [("apple", 35), ("grape", 30), ("orange", 30), ("banana", 25)]


def test_stream_of_an_empty_folder(spark):
    import os
    base = work_dir(spark, "test-stream")
    os.makedirs(f"{base.replace('file:', '')}/in")
    r = stream_partials_merge(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt").first()
    assert tuple(r) == (0, 0.0, 0.0, None, None, [])


def test_udf_grouped_vectorised_equals_per_group(spark):
    import random
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 30), float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, v double")

    def per_group(p):
        p = p.sort_values("v")
        return pd.DataFrame({"k": p["k"], "v": p["v"], "c": p["v"].cumsum()})

    def vectorised(p):
        p = p.sort_values(["k", "v"])
        return pd.DataFrame({"k": p["k"], "v": p["v"], "c": p.groupby("k")["v"].cumsum()})
    schema = "k long, v double, c double"
    a = sorted(tuple(r) for r in U.udf_grouped(df, "k", per_group, schema, buckets=3).collect())
    b = sorted(tuple(r) for r in U.udf_grouped(df, "k", vectorised, schema, buckets=3, per_group=False).collect())
    assert a == b and len(a) == 2000


def test_udf_grouped_keyless_needs_opt_in(spark):
    df = spark.range(5).selectExpr("cast(id as double) v")
    fn = lambda p: pd.DataFrame({"s": [p["v"].sum()]})
    with pytest.raises(ValueError):
        U.udf_grouped(df, [], fn, "s double")
    assert U.udf_grouped(df, [], fn, "s double", allow_keyless=True, per_group=False).first().s == 10.0


def test_sizing_conf():
    from tablestats.session import sizing_conf
    conf = sizing_conf(100 << 40, cores=8000)  # 100 TB on 8000 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert int(sizing_conf(1 << 20, cores=8)["spark.sql.shuffle.partitions"]) == 16


def test_checkpoint_root_rules():
    from tablestats.session import checkpoint_root

    class Conf:
        def __init__(self, value=None):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" and self.value else default

    class SC:
        def __init__(self, master, configured=None):
            self.master, self._dir, self._conf = master, None, Conf(configured)

        def getCheckpointDir(self):
            return self._dir

        def getConf(self):
            return self._conf

        def setCheckpointDir(self, d):
            self._dir = d

    class Session:
        def __init__(self, sc):
            self.sparkContext, self.conf = sc, Conf()

    with pytest.raises(RuntimeError):
        checkpoint_root(Session(SC("yarn")))
    assert checkpoint_root(Session(SC("yarn", "hdfs:///shared/ckpt"))) == "hdfs:///shared/ckpt"
    assert checkpoint_root(Session(SC("local[2]"))).startswith("/")


def test_stream_partials_merge_continuous(spark):
    base = work_dir(spark, "test-stream-cont")
    rows = [(10.0, 2, 1.0, 9.0), (5.0, 1, 5.0, 5.0)]
    schema = "total_sum double, item_count bigint, min_value double, max_value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{base}/in/a")
    q = stream_partials_merge(spark, f"{base}/in/*", f"{base}/out", f"{base}/ckpt", available_now=False)
    try:
        q.processAllAvailable()
        r = merge_partials(spark.read.parquet(f"{base}/out")).first()
        assert tuple(r) == (3, 15.0, 5.0, 1.0, 9.0)
    finally:
        q.stop()


def _floats():
    import random
    import struct
    rng = random.Random(2)
    special = [0.0, -0.0, 1e16, 1e-5, 1e-4, 1e7, 1e22, 1.5e300, 5e-324, float("inf"), float("-inf"), float("nan"), None, 9999999999999998.0, 0.00012345,
               1.234e15, -1e-7, 100.0, 12345678.9, 3.191142564539115e17, 2e-3, 999999999999999.9]
    return (special + [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(1500)]
            + [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 20) for _ in range(1500)])


def test_float_text_is_python_repr(spark):
    from tablestats.functions.scalar import float_text
    df = spark.createDataFrame([(v,) for v in _floats()], "v double")
    assert [(r.v, r.t) for r in df.select("v", float_text(F.col("v")).alias("t")).collect() if r.t != (None if r.v is None else repr(r.v))] == []


def test_float_division_is_pythons(spark):
    from tablestats.functions import scalar as S
    pairs = [(a, b) for a in [1.0, 1e300, -1.0, 0.3, *_floats()[30:330]] if a is not None and math.isfinite(a) for b in (0.1, -0.1, 7.0, -0.75, 1e-300, 3e200)]
    df = spark.createDataFrame(pairs, "a double, b double")
    for r in df.select("a", "b", S.py_floordiv(F.col("a"), F.col("b"), False).alias("q"), S.py_mod(F.col("a"), F.col("b"), False).alias("m")).collect():
        try:
            q, m = r.a // r.b, r.a % r.b
        except OverflowError:
            continue
        assert (r.q == q or math.isnan(r.q) and math.isnan(q)) and (r.m == m or math.isnan(r.m) and math.isnan(m)), (r, q, m)


def test_integer_power_is_exact(spark):
    from tablestats.functions import scalar as S
    rows = [(b, e) for b in (-7, -1, 0, 1, 2, 3, 10) for e in (0, 1, 2, 7, 31, 35) if abs(b) ** e < 10 ** 38]
    df = spark.createDataFrame(rows, "b long, e int")
    assert [int(r.p) for r in df.select(S.py_pow(F.col("b"), F.col("e"), integral=True).alias("p")).collect()] == [b ** e for b, e in rows]
    with pytest.raises(Exception):
        df.limit(1).select(S.py_pow(F.lit(10), F.lit(39), integral=True)).collect()
