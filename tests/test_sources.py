import os
import struct
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablestats.sources import cells as CE
from tablestats.sources import text_table as TT
from tablestats.sources.images import grey_resize, image_pixels, pixel_row_check
from tablestats.sources.synth import synth_ints


def py_infer(v):
    try:
        return ("int", int(v))
    except ValueError:
        try:
            return ("float", float(v))
        except ValueError:
            return ("str", v.strip())


CELLS = ["1", " 5 ", "1e5", "5.", "nan", "1_000", "1d", "0x10", "", "-inf", "+Infinity", " .5", "1_0.2_5",
         "1__0", "_1", "abc ", "\t7\n", "3e", "-0", "1e-3", "99999999999999999999"]


def test_infer_cell_matches_python(spark):
    df = spark.createDataFrame([(c,) for c in CELLS], "c string")
    got = df.select("c", CE.infer_cell(F.col("c")).alias("x")).collect()
    for r in got:
        kind, val = py_infer(r.c)
        assert r.x.kind == kind, r.c
        if kind == "int":
            assert r.x.d == float(val) and (r.x.i == val or abs(val) >= 2 ** 63)
        elif kind == "float":
            assert (np.isnan(val) and np.isnan(r.x.d)) or r.x.d == val, r.c
        else:
            assert r.x.s == val


def _write(text, name="t.csv"):
    d = tempfile.mkdtemp(prefix="ts-src-")
    with open(os.path.join(d, name), "w", newline="") as f:
        f.write(text)
    return d


def test_exact_read_no_quotes_blank_line_and_types(spark):
    d = _write('a,b,c\r\n1, 2.5 ,x\r\n\r\n3,"4",y\n')
    df = TT.read_table(spark, d, exact=True)
    assert df.columns == ["a", "b", "c"]
    # column a has an empty cell (blank line) -> string; b has '"4"' -> string
    assert dict(df.dtypes)["a"] == "string" and dict(df.dtypes)["b"] == "string"
    rows = sorted((tuple(r) for r in df.collect()), key=str)
    assert rows == sorted([("1", "2.5", "x"), ("", None, None), ("3", '"4"', "y")], key=str)


def test_exact_read_numeric_table(spark):
    d = _write("x,y\n1,2.0\n3,4\n")
    df = TT.read_table(spark, d, exact=True)
    assert dict(df.dtypes) == {"x": "bigint", "y": "double"}
    assert [tuple(r) for r in df.collect()] == [(1, 2.0), (3, 4.0)]


def test_header_of_each_file_is_dropped(spark):
    d = tempfile.mkdtemp(prefix="ts-src-")
    for k in range(3):
        with open(os.path.join(d, f"p{k}.csv"), "w") as f:
            f.write("x\n" + "".join(f"{k * 10 + i}\n" for i in range(4)))
    df = TT.read_table(spark, d, exact=True)
    assert sorted(r.x for r in df.collect()) == sorted(k * 10 + i for k in range(3) for i in range(4))


def test_sink_roundtrip_and_python_csv_format(spark):
    d = tempfile.mkdtemp(prefix="ts-sink-")
    df = spark.createDataFrame([(2, "b,c", ' q"x '), (1, "", None)], "id int, s string, t string")
    TT.write_table(df.coalesce(1), d + "/out", order_by="id")
    text = "".join(open(os.path.join(d, "out", f), newline="").read()
                   for f in sorted(os.listdir(d + "/out")) if f.endswith(".csv"))
    assert text == 'id,s,t\r\n1,,\r\n2,"b,c"," q""x "\r\n'


def test_sink_python_float_text(spark):
    d = tempfile.mkdtemp(prefix="ts-sink-")
    df = spark.createDataFrame([(1, 1e16, 0.0001), (2, 2.5, float("nan")), (3, -1.5e-7, 100.0)], "id int, a double, b double")
    TT.write_table(df.coalesce(1), d + "/out", order_by="id")
    text = "".join(open(os.path.join(d, "out", f), newline="").read()
                   for f in sorted(os.listdir(d + "/out")) if f.endswith(".csv"))
    assert text == "id,a,b\r\n1,1e+16,0.0001\r\n2,2.5,nan\r\n3,-1.5e-07,100.0\r\n"
    back = TT.read_table(spark, d + "/out", exact=True).orderBy("id").collect()
    assert back[0].a == 1e16 and back[2].a == -1.5e-07


def test_footprint(spark):
    d = _write("a,b\n1,2\n")
    r = TT.table_footprint(spark, d).first()
    assert (r.rows, r.bytes, r.columns) == (2, 8, 2)


def _png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_of_several_sizes_in_one_batch(spark):
    from tablestats.sources.images import resized_pixels
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        h, w, c = [(8, 8, 3), (16, 8, 1), (10, 7, 4), (5, 5, 3)][i % 4]
        rows.append((i, rng.integers(0, 256, h * w * c, dtype=np.uint8).tobytes() if i % 11 else None, h, w, c))
    df = spark.createDataFrame(rows, "i int, data binary, h int, w int, c int").coalesce(1)
    got = df.select("i", resized_pixels("data", "h", "w", "c", 4).alias("px")).collect()

    def slow(data, h, w, c):  # cell by cell
        img = np.frombuffer(data, np.uint8).reshape(h, w, c)
        grey = [[int(p[0]) if c == 1 else (int(p[0]) * 1868 + int(p[1]) * 9617 + int(p[2]) * 4899 + 8192) >> 14 for p in row] for row in img]
        out = []
        for y in range(4):
            for x in range(4):
                total = 0.0
                for i in range(h):
                    for j in range(w):
                        part = max(0.0, min((y + 1) * h / 4, i + 1) - max(y * h / 4, i)) * max(0.0, min((x + 1) * w / 4, j + 1) - max(x * w / 4, j))
                        total += part * grey[i][j]
                total /= h * w / 16
                out.append(float((int(round(total * h * w / 16)) + h * w // 32) // (h * w // 16)) if h % 4 == 0 == w % 4 else float(np.rint(total)))
        return out

    for r in got:
        want = rows[r["i"]]
        assert r["px"] == (None if want[1] is None else slow(*want[1:])), r["i"]


def test_image_pixels(spark):
    d = tempfile.mkdtemp(prefix="ts-img-")
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, size=(8, 8, 3))
    _png(os.path.join(d, "a.png"), img)
    with open(os.path.join(d, "broken.png"), "wb") as f:
        f.write(b"not a png")
    rows = image_pixels(spark, d, size=4).collect()
    assert len(rows) == 1 and len(rows[0].px) == 16
    r, g, b = img[..., 0], img[..., 1], img[..., 2]
    grey = (b * 1868 + g * 9617 + r * 4899 + 8192) >> 14
    block = grey.reshape(4, 2, 4, 2).sum(axis=(1, 3))
    assert rows[0].px == [float(v) for v in ((block + 2) // 4).reshape(-1)]


def test_grey_resize_non_multiple_keeps_constant():
    data = bytes([10, 20, 30] * 25)
    out = grey_resize(data, 5, 5, 3, 2)
    assert len(out) == 4 and len(set(out)) == 1


def test_pixel_row_check(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(4)]), (2, ["1", "2"]), (3, ["1", "x", "2", "3"])],
                               "id int, cells array<string>")
    got = {r.id: (r.ok, r.reason) for r in pixel_row_check(df, "cells", 2).collect()}
    assert got == {1: (True, None), 2: (False, "length"), 3: (False, "non-numeric")}


def test_synth_ints(spark):
    df = synth_ints(spark, n=1000, c=3, seed=5)
    r = df.agg(F.min("Product_1"), F.max("Product_3"), F.count(F.lit(1))).first()
    assert r[0] >= 1000 and r[1] < 10000 and r[2] == 1000 and df.columns == ["Product_1", "Product_2", "Product_3"]


def _text_file(spark, files):
    import os

    from tablestats.session import work_dir
    base = work_dir(spark, "test-text").replace("file:", "")
    for k, text in enumerate(files):
        with open(os.path.join(base, f"f{k}.csv"), "w") as f:
            f.write(text)
    return base


def test_exact_mode_loses_no_cell(spark):
    from decimal import Decimal

    from tablestats.sources import text_table as TT
    path = _text_file(spark, ["id,big,huge,x\n1,123456789012345678901," + "9" * 40 + ",1\n\n2,7,8,2.5\n", "id,big,huge,x\n3,-5,0,\"q\n"])
    rows = TT.read_table(spark, path, exact=True).collect()
    assert sorted((r.id, r.big, r.huge, r.x) for r in rows if r.id) == [
        ("1", Decimal(123456789012345678901), "9" * 40, "1"), ("2", Decimal(7), "8", "2.5"), ("3", Decimal(-5), "0", '"q')]
    assert [tuple(r) for r in rows if not r.id] == [("", None, None, None)]


def test_declared_schema_is_honoured_and_checked(spark):
    import datetime

    import pytest

    from tablestats.sources import text_table as TT
    path = _text_file(spark, ["id,v,d\n1,2,2024-01-02\n2,1.5,x\n3,text,\n"])
    df = TT.read_table(spark, path, "id int, v int, d date", exact=True)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["int", "int", "date"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2, datetime.date(2024, 1, 2)), (2, None, None), (3, None, None)]
    with pytest.raises(Exception, match="not int"):
        TT.read_table(spark, path, "id int, v int, d string", exact=True, strict=True).collect()


def test_one_pass_to_read_and_one_to_infer(spark):
    from tablestats.sources import text_table as TT
    path = _text_file(spark, ["a,b\n1,2\n", "a,b\n3,4\n"])
    df = TT.read_table(spark, path, exact=True)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2), (3, 4)]


def test_headers_are_found_in_any_split(spark):
    from tablestats.sources import text_table as TT
    files = ["h,k\n" + "".join(f"{f},{i}\n" for i in range(400)) + "h,k\n" for f in range(6)]
    path = _text_file(spark, files)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "5kb", "128mb"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = TT.read_lines(spark, path)
            assert lines.where("is_header").count() == 6 and lines.where("NOT is_header").count() == 6 * 401
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_layouts(spark):
    from tablestats.sources import text_table as TT
    long = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)], "col_i string, col_j string, corr double")
    assert sorted(tuple(r) for r in TT.matrix_layout(long, ["b", "a"]).collect()) == [(1, 1.0, 0.5), (2, 0.5, 1.0)]
    px = spark.createDataFrame([(7, [1.0, 2.0, 3.0, 4.0])], "id int, px array<double>")
    assert TT.pixel_layout(px, "px", 2, keep=["id"]).first().asDict() == {"id": 7, "p1": 1.0, "p2": 2.0, "p3": 3.0, "p4": 4.0}


def test_empty_files_have_no_header(spark, tmp_path):
    for k, text in enumerate(["", "", "a,b\n1,x\n", "", "a,b\n2,\n"]):
        (tmp_path / f"part-{k}.txt").write_text(text)
    path = str(tmp_path)
    assert TT.header_cells(spark, path) == ["a", "b"]
    got = TT.read_table(spark, path, exact=True)
    assert got.dtypes == [("a", "bigint"), ("b", "string")]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x"), (2, "")]
    assert TT.table_footprint(spark, path).first().columns == 2


def test_scan_of_orders_whose_first_task_has_no_rows(spark, tmp_path):
    """One row group read in several splits: only the split with its middle has rows."""
    from tablestats.plans import QUERIES
    n = 60_000
    rows = spark.range(n, numPartitions=1).select(F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), (F.rand(1) * 1000).alias("o_totalprice"))
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = QUERIES["csv_scan"](spark, str(tmp_path))
        assert got.columns == ["k", "label", "big", "x"]
        assert got.agg(F.count("*"), F.count("big"), F.count("x")).first() == (n, n * 8 // 10, n * 8 // 10)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
