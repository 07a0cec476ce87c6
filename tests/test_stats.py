import pytest
from pyspark.sql import functions as F

from tablestats.operators import chunks as C
from tablestats.operators import partials as PM
from tablestats.operators.correlation import correlation_matrix
from tablestats.operators.zscore import zscore


def test_correlation_goldens(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, 6.0, 7.0)], "x double, y double, c double")
    for rule in ("complete", "pairwise"):
        m = {(r.col_i, r.col_j): r.corr for r in correlation_matrix(df, missing=rule).collect()}
        assert m[("x", "y")] == pytest.approx(1.0)
        assert m[("x", "x")] == pytest.approx(1.0)
        assert m[("x", "c")] == 0.0 and m[("c", "x")] == 0.0 and m[("c", "c")] == 0.0
        assert len(m) == 9


def test_zscore_goldens(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0), (2, 2.0, 7.0), (3, 3.0, 7.0)], "id int, x double, c double")
    rows = {r.id: r for r in zscore(df, ["x", "c"], keep=["id"]).collect()}
    assert [round(rows[i].x, 6) for i in (1, 2, 3)] == [-1.224745, 0.0, 1.224745]
    assert [rows[i].c for i in (1, 2, 3)] == [0.0, 0.0, 0.0]


def test_zscore_has_no_single_partition_window(spark):
    df = spark.range(100).selectExpr("cast(id as double) x")
    plan = zscore(df, ["x"])._jdf.queryExecution().executedPlan().toString()
    # Statistics are fitted by one aggregate; the rows pass through one projection.
    assert "Join" not in plan and "Window" not in plan and "Exchange" not in plan and "Subquery" not in plan


PARTIALS = [(500.0, 100, 1.0, 25.0, {"apple": 10, "banana": 15}),
            (750.0, 150, -5.0, 30.0, {"apple": 5, "orange": 20}),
            (300.0, 50, 2.0, 15.0, {"banana": 10, "orange": 10}),
            (1200.0, 200, 0.0, 50.0, {"apple": 20, "grape": 30})]


def test_partials_merge_golden(spark):
    p = spark.createDataFrame(PARTIALS, PM.PARTIAL_DDL)
    r = PM.merge_partials(p).first()
    assert (r.total_records_processed, r.overall_sum, r.overall_average) == (500, 2750.0, 5.5)
    assert (r.overall_minimum, r.overall_maximum) == (-5.0, 50.0)
    assert [tuple(x) for x in r.most_common] == [("apple", 35), ("grape", 30), ("orange", 30), ("banana", 25)]
    top = [(x.item, x.frequency) for x in PM.merge_frequencies(p).collect()]
    assert top == [("apple", 35), ("grape", 30), ("orange", 30), ("banana", 25)]


def test_partials_merge_nothing(spark):
    r = PM.merge_partials(spark.createDataFrame([], PM.PARTIAL_DDL)).first()
    assert (r.total_records_processed, r.overall_average, r.overall_minimum, r.overall_maximum) == (0, 0.0, None, None)


def _chunks(spark, n, k, parts=3):
    df = spark.range(n).repartition(parts)
    return sorted((r.chunk_id, r.row_index, r.id) for r in C.chunk_rows(df, k, "id").collect())


@pytest.mark.parametrize("n,k,expected", [(10, 6, [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]),
                                          (10, 3, [(0, 4), (4, 8), (8, 10)]),
                                          (3, 7, [(0, 1), (1, 2), (2, 3)])])
def test_chunk_ranges(spark, n, k, expected):
    df = spark.range(n).repartition(3)
    ranges = C.chunk_ranges(C.chunk_rows(df, k, "id")).orderBy("chunk_id").collect()
    assert [(r.start_index, r.end_index) for r in ranges] == expected


def test_row_index_equals_position_for_any_partitioning(spark):
    for parts in (1, 5):
        rows = _chunks(spark, 1000, 7, parts)
        assert [r[1] for r in sorted(rows, key=lambda r: r[2])] == list(range(1000))


@pytest.mark.parametrize("lo,hi,step", [(None, None, 1), (2, 8, 3), (-3, None, 1), (None, None, -2), (8, 1, -3),
                                        (-100, 100, 4), (5, 2, 1)])
def test_row_slice_python_semantics(spark, lo, hi, step):
    df = spark.range(10).repartition(3)
    got = [r.id for r in C.row_slice(df, "id", lo, hi, step).orderBy("slice_pos").collect()]
    assert got == list(range(10))[lo:hi:step]


def test_chunked_partials_equal_unchunked(spark):
    df = spark.range(1, 1001).selectExpr("id", "cast(id * 1.5 as double) v")
    chunked = C.chunk_rows(df, 6, "id")
    merged = PM.merge_partials(PM.partials_by(chunked, "chunk_id", "v")).first()
    whole = df.agg(F.sum("v"), F.count("v"), F.min("v"), F.max("v")).first()
    assert (merged.overall_sum, merged.total_records_processed, merged.overall_minimum, merged.overall_maximum) == \
        tuple(whole)


def test_merge_by_tag(spark):
    p = spark.createDataFrame([(0, [1.0, 5.0], 2), (1, [3.0, 1.0], 6)], "chunk_id int, partial array<double>, w long")
    def get(tag, **kw):
        return [r.value for r in PM.merge_by_tag(p, tag, **kw).orderBy("pos").collect()]
    assert get("s") == [4.0, 6.0]
    assert get("m") == [3.0, 5.0] and get("n") == [1.0, 1.0] and get("i") == [3.0, 5.0]
    assert get("a", weight_col="w") == [2.5, 2.0]
    assert get("c") == [1.0, 5.0, 3.0, 1.0]
    with pytest.raises(ValueError):
        PM.merge_by_tag(p, "x")
    with pytest.raises(ValueError):
        PM.merge_by_tag(p, "")


def test_sort_top_k_stable(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 1.0), (0, 5.0)], "pos int, v double")
    assert [r.pos for r in C.sort_top_k(df, "v", 3, tie_by=["pos"]).collect()] == [2, 3, 1]


def test_parse_aggregation_tag():
    assert PM.parse_aggregation_tag("s:result") == ("s", "result")
    assert PM.parse_aggregation_tag(":data") == ("", "data")
    for bad in ("q:x", "s", "s:", "x"):
        with pytest.raises(ValueError):
            PM.parse_aggregation_tag(bad)


def test_row_at(spark):
    df = spark.range(10).repartition(3)
    assert [r.id for r in C.row_at(df, "id", 3).collect()] == [3]
    assert [r.id for r in C.row_at(df, "id", -1).collect()] == [9]
    assert C.row_at(df, "id", 10).collect() == []


@pytest.mark.parametrize("p", [2, 9, 10, 24, 64])
def test_correlation_equals_numpy_at_any_width(spark, p):
    import numpy as np
    rng = np.random.default_rng(p)
    x = rng.normal(size=(400, p)) + 1000 * rng.normal(size=p)
    x[:, -1] = 0.1  # a constant that sums to a rounded value
    hole = x.copy()
    hole[rng.random(x.shape) < 0.01] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in hole], ", ".join(f"c{k} double" for k in range(p))).repartition(3)
    for rule in ("complete", "pairwise"):
        got = {(int(r.col_i[1:]), int(r.col_j[1:])): r.corr for r in correlation_matrix(df, missing=rule).collect()}
        assert len(got) == p * p
        whole = hole[~np.isnan(hole).any(1)]
        for i in range(p):
            for j in range(p):
                y = whole[:, [i, j]] if rule == "complete" else hole[~np.isnan(hole[:, [i, j]]).any(1)][:, [i, j]]
                want = 0.0 if p - 1 in (i, j) else 1.0 if i == j else np.corrcoef(y.T)[0, 1]
                assert got[i, j] == pytest.approx(want, abs=1e-9)


def test_a_column_more_changes_no_other_pair(spark):
    df = spark.range(200).selectExpr("cast(id % 17 as double) a", "cast(id % 5 as double) b", "if(id % 3 = 0, null, cast(id as double)) c")
    for rule, cols in (("pairwise", ["a", "b", "c"]), ("complete", ["a", "b"])):
        base = correlation_matrix(df, ["a", "b"], missing=rule).where("col_i = 'a' AND col_j = 'b'").first().corr
        more = correlation_matrix(df, cols, missing=rule).where("col_i = 'a' AND col_j = 'b'").first().corr
        assert more == pytest.approx(base, abs=1e-12)
    with pytest.raises(ValueError):
        correlation_matrix(df, missing="other")


def test_zscore_complete_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, None, 6.0), (3, 3.0, float("nan")), (4, 2.0, 7.0)], "id int, x double, y double")
    rows = {r.id: (r.x, r.y) for r in zscore(df, ["x", "y"], keep=["id"], missing="complete").collect()}
    assert rows == {1: (-1.0, -1.0), 4: (1.0, 1.0)}


def test_sort_top_k_default_is_input_order(spark):
    import os
    import tempfile
    d = tempfile.mkdtemp(prefix="ts-topk-")
    rows = [(i, float(i % 3)) for i in range(30)]
    spark.createDataFrame(rows, "pos int, v double").coalesce(1).write.parquet(os.path.join(d, "t"))
    df = spark.read.parquet(os.path.join(d, "t"))
    got = [r.pos for r in C.sort_top_k(df, "v", 5).collect()]
    assert got == [0, 3, 6, 9, 12]


def test_chunks_default_to_input_order(spark):
    import os
    import tempfile
    d = tempfile.mkdtemp(prefix="ts-chunk-")
    spark.createDataFrame([(i, 100 - i) for i in range(10)], "pos int, v int").coalesce(1) \
        .write.parquet(os.path.join(d, "t"))
    df = spark.read.parquet(os.path.join(d, "t"))
    got = sorted((r.row_index, r.pos, r.chunk_id) for r in C.chunk_rows(df, 3, None).collect())
    assert [g[1] for g in got] == list(range(10)) and [g[2] for g in got] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_merge_tagged_equals_merge_by_tag(spark):
    p = spark.createDataFrame([(0, [1.0, 5.0], [2.0], 2), (1, [3.0, 1.0], [4.0], 6)],
                              "chunk_id int, a1 array<double>, a2 array<double>, w long")
    got = {(r.name, r.pos): r.value for r in PM.merge_tagged(p, {"a1": "a", "a2": "i"}, weight_col="w").collect()}
    assert got == {("a1", 0): 2.5, ("a1", 1): 2.0, ("a2", 0): 8.0}
    with pytest.raises(ValueError):
        PM.merge_tagged(p, {"a1": "c"})


def test_merge_tagged_keeps_integers_exact(spark):
    p = spark.createDataFrame([(0, [2**53, 1], [1.5]), (1, [1, 2**62], [2.0])], "chunk_id int, s array<long>, d array<double>")
    got = {(r.name, r.pos): r.exact for r in PM.merge_tagged(p, {"s": "s", "d": "s"}).collect()}
    assert got == {("s", 0): 2**53 + 1, ("s", 1): 2**62 + 1, ("d", 0): None}


def test_input_order_index_without_sort(spark):
    from tablestats.session import work_dir
    path = work_dir(spark, "test") + "/t"
    spark.range(1000).selectExpr("id * 7 % 1000 AS v", "id", "'x' AS wide").coalesce(3).write.parquet(path)
    df = spark.read.parquet(path).select("v")
    out = C.chunk_rows(df, 4, None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange hashpartitioning" not in plan and "wide" not in plan
    files = sorted(r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect())
    want = [r.v for f in files for r in spark.read.parquet(f).select("v", "_metadata.row_index").orderBy("row_index").collect()]
    assert [r.v for r in out.orderBy("row_index").collect()] == want and out.agg(F.max("chunk_id")).first()[0] == 3
    part = C.with_row_index(df.where("v % 2 = 0"), None)
    assert sorted(r.row_index for r in part.collect()) == list(range(500))
