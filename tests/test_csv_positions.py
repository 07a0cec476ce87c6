import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tablestats.operators import chunks as C
from tablestats.sources import text_table as TT


@pytest.fixture
def folder(spark):
    """Three files, some with more blocks than one, one with only a header."""
    d = tempfile.mkdtemp(prefix="ts-pos-")
    rows = []
    for k, n in enumerate((700, 0, 1, 2500)):
        lines = [f"{k},{i},{'x' * (i % 50)}" for i in range(n)]
        rows += [(k, i) for i in range(n)]
        with open(os.path.join(d, f"p{k}.csv"), "w") as f:
            f.write("a,b,c\n" + "".join(x + "\n" for x in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    yield d, rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_input_order_without_a_sort(spark, folder):
    d, rows = folder
    df = TT.read_table(spark, d, exact=True)
    assert df.columns == ["a", "b", "c"] and df.rdd.getNumPartitions() > 3
    out = C.chunk_rows(df, 7, None)
    assert out.columns == ["a", "b", "c", "row_index", "chunk_id"]
    assert "Sort" not in plan(out.drop("c")).replace("SortAggregate", "") and "Window" not in plan(df)
    got = sorted((r["row_index"], r["a"], r["b"], r["chunk_id"]) for r in out.collect())
    size = -(-len(rows) // 7)
    assert got == [(i, a, b, i // size) for i, (a, b) in enumerate(rows)]


def test_slices_and_declared_schemas(spark, folder):
    d, rows = folder
    df = TT.read_table(spark, d, "a int, b int, c string", exact=True)
    got = C.row_slice(df, None, 650, 3000, 7).collect()
    assert sorted((r["slice_pos"], r["a"], r["b"]) for r in got) == [(i, *x) for i, x in enumerate(rows[650:3000:7])]
    got = C.row_slice(df, None, -5, None).collect()
    assert sorted((r["slice_pos"], r["a"], r["b"]) for r in got) == [(i, *x) for i, x in enumerate(rows[-5:])]


def test_cells_without_a_header(spark, folder):
    d, rows = folder
    cells = C.with_row_index(TT.read_cells(spark, d, header=False), None)
    got = [r["cells"][:2] for r in sorted(cells.collect(), key=lambda r: r["row_index"])]
    want = []
    for k in range(4):
        want += [["a", "b"]] + [[str(a), str(b)] for a, b in rows if a == k]
    assert got == want


def test_kept_positions_of_projections_and_filters(spark, folder):
    d, rows = folder
    df = TT.read_table(spark, d, exact=True, positions=True)
    out = C.with_row_index(df.select("b", *C.POSITION), None, total_col="n")
    assert out.columns == ["b", "row_index", "n"] and "Sort" not in plan(out).replace("SortAggregate", "")
    assert sorted((r["row_index"], r["b"], r["n"]) for r in out.collect()) == [(i, b, len(rows)) for i, (_, b) in enumerate(rows)]
    some = C.with_row_index(df.where(F.col("b") % 3 == 1), None)
    assert sorted((r["row_index"], r["a"], r["b"]) for r in some.collect()) == [(i, *x) for i, x in enumerate(x for x in rows if x[1] % 3 == 1)]


def test_splits_that_changed_are_told(spark, folder):
    d, _ = folder
    out = C.with_row_index(TT.read_table(spark, d, exact=True), None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    with pytest.raises(Exception, match="split differently"):
        out.collect()


def test_fast_mode_has_no_positions(spark, folder):
    with pytest.raises(ValueError):
        TT.read_table(spark, folder[0], positions=True)


@pytest.mark.parametrize("cut", [(5, 105, 1), (-30, None, 7), (590, 410, -3), (350, 350, 1), (None, None, 250)])
def test_slices_read_only_their_files(spark, cut):
    d = tempfile.mkdtemp(prefix="ts-files-") + "/t"
    for k in range(10):
        spark.range(100 * k, 100 * k + 100, 1, 1).write.mode("append").parquet(d)
    before = [r["id"] for r in sorted(C.with_row_index(spark.read.parquet(d), None).collect(), key=lambda r: r["row_index"])]
    want = before[slice(*cut)]
    out = C.row_slice(spark.read.parquet(d), None, *cut)
    names = sorted(f for f in os.listdir(d) if f.endswith(".parquet"))
    rows = range(len(before))[slice(*cut)]
    for k, f in enumerate(names):  # files outside the slice can no longer be read
        if not rows or 100 * k + 100 <= min(rows) or 100 * k > max(rows):
            with open(os.path.join(d, f), "r+b") as g:
                g.write(b"broken!!" * 20)
                g.truncate(os.path.getsize(os.path.join(d, f)))
    assert [r["id"] for r in sorted(out.collect(), key=lambda r: r["slice_pos"])] == want
