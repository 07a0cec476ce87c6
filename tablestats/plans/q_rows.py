"""Queries for the row operators (B1-B12) on part, customer, pages, documents and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablestats.functions import scalar as S
from tablestats.operators import rows as R
from tablestats.operators.columns import select_numeric
from tablestats.plans.registry import register, rnd
from tablestats.plans.tables import LINEITEM_NUMERIC, table, tidy


@register("cast_numeric_strict", "SELECT p_partkey, p_size::double AS s_size, p_retailprice::double AS s_price FROM part")
def q_cast_numeric_strict(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("s_size"),
                                            F.col("p_retailprice").cast("string").alias("s_price"))
    return R.cast_numeric_strict(p, ["s_size", "s_price"])


# The last path segment of a page URL is a number ("825") or not ("25#top", "825?page=2").
_SEGMENT = "/([^/]*)$"


@register("cast_numeric_coerce_drop", "SELECT * FROM (SELECT page_id, TRY_CAST(page_id::VARCHAR AS DOUBLE) AS c_id, "
          f"TRY_CAST(regexp_extract(url, '{_SEGMENT}', 1) AS DOUBLE) AS c_segment FROM pages) "
          "WHERE c_id IS NOT NULL AND c_segment IS NOT NULL")
def q_cast_numeric_coerce_drop(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.col("page_id").cast("string").alias("c_id"),
        F.regexp_extract("url", _SEGMENT, 1).alias("c_segment"))
    return R.cast_numeric_coerce_drop(p, ["c_id", "c_segment"])


@register("filter_above", " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{c}' AS col_name, {c}::double AS v FROM lineitem "
    f"WHERE NOT isnan({c}) AND {c} > 20" for c in LINEITEM_NUMERIC))
def q_filter_above(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return R.filter_above(li, LINEITEM_NUMERIC, 20, ids=["l_orderkey", "l_linenumber"])


@register("filter_above_lists", " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, {c}) - 1 AS pos, {c}::double AS v FROM lineitem "
    f"WHERE NOT isnan({c}) AND {c} > 20" for c in LINEITEM_NUMERIC))
def q_filter_above_lists(spark, sf_dir):
    """B4 as lists: every passing value with its place in its column's filtered list."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *LINEITEM_NUMERIC)
    return R.filter_above_lists(li, LINEITEM_NUMERIC, 20, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@register("numeric_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                             "l_discount, l_tax FROM lineitem")
def q_numeric_columns(spark, sf_dir):
    return select_numeric(table(spark, sf_dir, "lineitem"))


@register("row_length_filter", "SELECT doc_id, lang FROM documents WHERE len(string_split(text, chr(10))) = 4")
def q_row_length_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.split("text", "\n").alias("lines"))
    return R.row_length_filter(d, "lines", 4).select("doc_id", "lang")


@register("cell_arith", "SELECT c_custkey, (c_custkey + 1)::VARCHAR AS next_key FROM customer")
def q_cell_arith(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", R.cell_arith(F.col("c_custkey").cast("string")).alias("next_key"))


@register("row_fanout", "SELECT c_custkey, 0 AS seq, (c_custkey + 1)::VARCHAR AS c0, NULL::VARCHAR AS c1, "
                        "NULL::VARCHAR AS c2 FROM customer UNION ALL SELECT c_custkey, 1, c_custkey::VARCHAR, c_name, "
                        "c_mktsegment FROM customer")
def q_row_fanout(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_custkey").cast("string").alias("c0"), F.col("c_name").alias("c1"),
        F.col("c_mktsegment").alias("c2"))
    return R.row_fanout(c, ["c0", "c1", "c2"])


@register("project_case", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'high' "
                          "WHEN l_quantity > 20 THEN 'mid' ELSE 'low' END AS band FROM lineitem")
def q_project_case(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return li.select("l_orderkey", "l_linenumber", R.project_case([(q > 40, "high"), (q > 20, "mid")], "low")
                     .alias("band"))


_X = "(l_partkey - 1000)"
_Y = "(2 * l_linenumber - 7)::BIGINT"


@register("scalar_arith", f"SELECT l_orderkey, l_linenumber, CAST(floor({_X}::double / {_Y}) AS BIGINT) AS fdiv, "
          f"(({_X} % {_Y}) + {_Y}) % {_Y} AS fmod, CAST({_Y}::HUGEINT * {_Y} * {_Y} AS DECIMAL(38,0)) AS cube, "
          # Floats: the divisors are exact, so the quotient's floor and the remainder are too.
          "floor(l_quantity / -0.75) AS ffdiv, l_quantity - floor(l_quantity / -0.75) * -0.75 AS ffmod, "
          "CAST(round_even(l_extendedprice / 7.0, 0) AS BIGINT) AS rounded, "
          "CAST(trunc(l_extendedprice / -3.0) AS BIGINT) AS truncated, "
          f"least({_X}, {_Y}) AS smaller, {rnd(f'{_X}::double / {_Y}')} AS quotient, "
          f"{rnd('sqrt(l_quantity)')} AS root FROM lineitem")
def q_scalar_arith(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x = F.col("l_partkey") - 1000
    y = (F.col("l_linenumber") * 2 - 7).cast("long")
    return tidy(li.select(
        "l_orderkey", "l_linenumber",
        S.py_floordiv(x, y).alias("fdiv"),
        S.py_mod(x, y).alias("fmod"),
        S.py_pow(y, 3, integral=True).alias("cube"),
        (S.py_floordiv(F.col("l_quantity"), F.lit(-0.75), integral=False) + 0.0).alias("ffdiv"),
        (S.py_mod(F.col("l_quantity"), F.lit(-0.75), integral=False) + 0.0).alias("ffmod"),
        S.py_round(F.col("l_extendedprice") / 7.0).alias("rounded"),
        S.py_int(F.col("l_extendedprice") / -3.0).alias("truncated"),
        S.py_min(x, y).alias("smaller"),
        S.py_truediv(x, y).alias("quotient"),
        S.py_sqrt(F.col("l_quantity")).alias("root"),
    ))
