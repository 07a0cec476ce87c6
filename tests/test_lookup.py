import random

from pyspark.sql import functions as F

from tablestats.operators import lookup as L


def _brute_edges(stmts):
    last, edges = {}, {}
    for line, reads, writes in sorted(stmts):
        for n in reads:
            if n in last:
                edges.setdefault((last[n], line), []).append(n)
        for n in writes:
            last[n] = line
    return {k: sorted(v) for k, v in edges.items()}


def test_last_writer_edges_vs_brute_force(spark):
    rnd = random.Random(3)
    names = ["a", "b", "c", "hot"]
    stmts = []
    for line in range(400):
        reads = sorted({rnd.choice(names) for _ in range(rnd.randint(0, 3))} | ({"hot"} if line % 2 else set()))
        writes = sorted({rnd.choice(names) for _ in range(rnd.randint(0, 2))})
        stmts.append((line, reads, writes))
    df = spark.createDataFrame(stmts, "line long, reads array<string>, writes array<string>").repartition(4)
    for width in (7, 1 << 20):
        got = {(r.src, r.dest): r.names for r in L.last_writer_edges(df, "line", "reads", "writes", width).collect()}
        assert got == _brute_edges(stmts)


def test_self_read_sees_only_earlier_writer(spark):
    df = spark.createDataFrame([(1, ["x"], ["x"]), (2, ["x"], ["x"])], "line long, reads array<string>, writes array<string>")
    assert [(r.src, r.dest) for r in L.last_writer_edges(df, "line", "reads", "writes").collect()] == [(1, 2)]


def test_group_by_dependency(spark):
    stmts = spark.createDataFrame([(1, [], ["x"]), (2, ["x"], []), (3, ["x"], []), (4, [], [])],
                                  "line long, reads array<string>, writes array<string>")
    edges = L.last_writer_edges(stmts, "line", "reads", "writes")
    got = {r.line: (r.signature, r.group_size) for r in L.group_by_dependency(edges, stmts, "line").collect()}
    assert {k: ([tuple(x) for x in s], n) for k, (s, n) in got.items()} == {1: ([], 2), 4: ([], 2), 2: ([("x", 1)], 2), 3: ([("x", 1)], 2)}


def test_signatures_do_not_collide(spark):
    edges = spark.createDataFrame([(1, 10, ["a"]), (2, 10, ["b"]), (2, 11, ["a:1;b"]), (3, 12, ["a"])], "src long, dest long, names array<string>")
    stmts = spark.createDataFrame([(10,), (11,), (12,), (13,)], "line long")
    assert [r.group_size for r in L.group_by_dependency(edges, stmts, "line").collect()] == [1, 1, 1, 1]


def test_sparse_ids_with_a_hot_name(spark):
    stmts = [(k * 3_000_000, ["hot"] if k % 3 else ["x"], ["hot"] if k % 4 == 0 else []) for k in range(3000)]
    df = spark.createDataFrame(stmts, "line long, reads array<string>, writes array<string>").repartition(4)
    got = {(r.src, r.dest): r.names for r in L.last_writer_edges(df, "line", "reads", "writes", 500).collect()}
    assert got == _brute_edges(stmts)
    from tablestats.operators.asof import quantile_bucket
    assert df.select(quantile_bucket(df, "line", 500).alias("b")).distinct().count() == 6


def test_best_fit_is_exact_beyond_2_53_for_any_list_length(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(1, big), (2, 5), (3, None)], "id int, need long")
    for n in (3, 4096, 4097):
        rows = [("n0", 2**53, 0), ("n1", big, 1), ("n2", big + 10, 2)] + [(f"m{k}", 10 + k, k) for k in range(3, n)]
        nodes = spark.createDataFrame(rows, "name string, memory long, pos int")
        got = {r.id: r.node and r.node.name for r in L.best_fit_lookup(df, F.col("need"), nodes).collect()}
        assert got == {1: "n1", 2: "m3" if n > 3 else "n0", 3: None}


def test_best_fit(spark):
    nodes = spark.createDataFrame([("n1", 10.0, 0), ("n2", 25.0, 1), ("n3", 40.0, 2), ("n4", 40.0, 3)],
                                  "name string, memory double, pos int")
    rnd = random.Random(5)
    needs = [(i, float(rnd.randint(0, 50))) for i in range(200)] + [(999, None)]
    df = spark.createDataFrame(needs, "id int, need double")

    def expect(need):
        if need is None:
            return None
        fits = [(m, p, n) for n, m, p in [("n1", 10.0, 0), ("n2", 25.0, 1), ("n3", 40.0, 2), ("n4", 40.0, 3)] if m >= need]
        return min(fits)[2] if fits else None
    fast = {r.id: (r.node.name if r.node else None) for r in L.best_fit_lookup(df, F.col("need"), nodes).collect()}
    assert fast == {i: expect(n) for i, n in needs}
    for rows in (3, 20):
        slow = {r.id: (r.node.name if r.node else None)
                for r in L.best_fit_lookup(df, F.col("need"), nodes, rows_per_bucket=rows).collect()}
        assert slow == fast


def test_peak_step_usage_golden(spark):
    live = spark.createDataFrame([("main", "data", 576), ("mean", "data", 576), ("mean", "m", 2256), ("tail", "r", 5088)],
                                 "step string, item string, size long")
    cost = spark.createDataFrame([("main", 15053764, 1), ("mean", 15000000, 1), ("mean", 15056020, 2)],
                                 "step string, bytes long, seq int")
    out = {r.step: (r.usage, r.peak) for r in L.peak_step_usage(live, cost, cost_order_col="seq").collect()}
    assert out == {"main": (576 + 15053764, 15058852), "mean": (15058852, 15058852), "tail": (5088, 15058852)}
