"""Property test: per-cell inference agrees with Python's int() -> float() -> str.strip()."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablestats.sources.cells import infer_cell

PIECES = ["0", "1", "7", "42", "_", ".", "e", "E", "+", "-", " ", "\t", "inf", "nan", "Infinity", "x", "d", "0x"]
cell = st.lists(st.sampled_from(PIECES), min_size=0, max_size=6).map("".join)


def python_kind(v):
    try:
        return "int", int(v)
    except ValueError:
        try:
            return "float", float(v)
        except ValueError:
            return "str", v.strip()


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cell, min_size=200, max_size=400))
def test_inference_matches_python(spark, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = {r.i: r.x for r in df.select("i", infer_cell(F.col("c")).alias("x")).collect()}
    for i, c in enumerate(cells):
        kind, val = python_kind(c)
        x = got[i]
        assert x.kind == kind, (c, x)
        if kind == "int" and abs(val) < 2 ** 63:
            assert x.i == val, (c, x)
        elif kind == "float":
            assert (math.isnan(val) and math.isnan(x.d)) or x.d == val, (c, x)
        elif kind == "str":
            assert x.s == val, (c, x)
