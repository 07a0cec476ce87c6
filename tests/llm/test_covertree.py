import numpy as np
import pytest

from tablestats.llm import covertree


def brute(rows, threshold):
    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if sound(rows[a]) and sound(rows[b]) and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                u, v = np.float64(rows[a][1]), np.float64(rows[b][1])
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted([(rows[i][0], links[i], least.get(find(i)), rows[i][0] is not None and rows[i][0] == least.get(find(i))) for i in range(n)], key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    return sorted(map(tuple, covertree.near_duplicates(df, **kw).collect()), key=str)


@pytest.mark.parametrize("leaf,block", [(2048, 1024), (40, 16)])
def test_against_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(covertree, "LEAF", leaf)
    monkeypatch.setattr(covertree, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        base = rng.normal(size=8)
        for _ in range(14):
            rows.append((len(rows) * 7 % 503, [float(np.float32(x)) for x in base + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.5])], int(k % 3)))
    rows += [(900, rows[0][1], rows[0][2]), (901, [2 * x for x in rows[0][1]], rows[0][2]), (902, rows[0][1], None), (903, None, 1), (904, [0.0] * 8, 1), (905, [float("nan")] * 8, 1),
             (906, [1.0, None] * 4, 1), (None, rows[0][1], rows[0][2]), (907, [1.0, 0.0], 0), (908, [1.0, 0.1], 0), (909, [], 0), (910, [float("inf")] + [1.0] * 7, 1), (911, [1e30] * 8, 2), (912, [1e-30] * 8, 2)]
    assert run(spark, rows) == brute(rows, 0.98)


def clustered(n, clusters, dims=32, spread=0.02, seed=1):
    rng = np.random.default_rng(seed)
    centres = covertree.unit(rng.normal(size=(clusters, dims)))
    return covertree.unit(centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * spread / np.sqrt(dims))


@pytest.mark.parametrize("clusters", [5, 40, 300])
def test_most_pairs_of_clustered_rows_are_never_compared(clusters):
    x, y = clustered(1500, clusters), clustered(1200, clusters)[::-1].copy()
    for z in (x, y):
        seen = []
        i, j = covertree.links(x, z, 0.98, compared=seen)
        assert sum(seen) < 0.5 * len(x) * len(z)
        assert len(i) == (x @ z.T >= 0.98).sum() and (x[i] * z[j]).sum(1).min() >= 0.98 - 1e-12


def test_rows_that_are_all_apart_are_compared_in_few_products():
    x = covertree.unit(np.random.default_rng(2).normal(size=(1500, 64)))
    seen = []
    i, j = covertree.links(x, x, 0.98, compared=seen)
    assert (i == j).all() and len(i) == 1500 and len(seen) < 30


@pytest.mark.parametrize("leaf,block", [(60, 200), (30, 10)])
def test_clustered_nodes_meet_in_few_blocks(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(covertree, "LEAF", leaf)
    monkeypatch.setattr(covertree, "BLOCK", block)
    x = clustered(700, 14, dims=8, spread=0.05)
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(np.float32(x))]
    assert run(spark, rows) == brute(rows, 0.98)


def test_node_pairs_of_clustered_rows_are_ruled_out_in_spark(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(covertree, "LEAF", 60)
    x = clustered(2000, 20, dims=16)
    points = spark.createDataFrame([(i, 1, [float(v) for v in r], "16|l|6C") for i, r in enumerate(x)], "pid long, count long, vec array<double>, node string")
    placed, pairs = covertree._leaf_pairs(points, 0.98)
    nodes = placed.select("node").distinct().count()
    assert nodes > 15 and pairs.count() < 0.5 * nodes * (nodes + 1) / 2
    assert pairs.where(F.col("a") == F.col("b")).count() == nodes


def test_identical_and_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(50)]
    assert run(spark, rows) == sorted([(i, 49, 0, i == 0) for i in range(50)], key=str)
    assert run(spark, []) == []


def test_local_trees_find_all_links():
    rng = np.random.default_rng(5)
    x = covertree.unit(np.concatenate([rng.normal(size=(150, 6)), rng.normal(size=(1, 6)) + rng.normal(size=(200, 6)) * 0.05]))
    y = covertree.unit(np.concatenate([x[:90] + rng.normal(size=(90, 6)) * 0.02, rng.normal(size=(60, 6))]))
    i, j = covertree.links(x, y, 0.98)
    assert sorted(zip(i.tolist(), j.tolist())) == [tuple(p) for p in np.argwhere(x @ y.T >= 0.98).tolist()]
