"""Queries for the grid filters (C1-C5) and list functions (C6-C9) on ``embeddings``.

Each 64-float embedding is an 8x8 image; pixels are scaled to integers with
round(x * 100). Results are exploded to ``(vec_id, pos, value)`` rows or
lists rendered as comma-joined text, so both engines compare plain values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablestats.functions import arrays as A
from tablestats.operators import grid as G
from tablestats.operators.rows import row_length_filter
from tablestats.plans.registry import register
from tablestats.plans.tables import table

S = 8


def _pixels(spark, sf_dir):
    e = row_length_filter(table(spark, sf_dir, "embeddings"), "embedding", S * S)
    return e.select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 100.0, 0)).alias("px"))


def _ipx(spark, sf_dir):
    return _pixels(spark, sf_dir).select("vec_id", "label", F.transform("px", lambda x: x.cast("long")).alias("px"))


def _explode(df, arr: Column):
    # posexplode_outer: plain posexplode makes Catalyst infer a size(arr) > 0
    # filter and push it below the projection, re-evaluating the whole array
    # expression there. Empty arrays give a NULL pos, dropped right after.
    return df.select("vec_id", F.posexplode_outer(arr).alias("pos", "value")).where(F.col("pos").isNotNull()) \
        .select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("bigint").alias("value"))


_G = ("g AS (SELECT vec_id, p, p // 8 AS i, p % 8 AS j, v FROM (SELECT vec_id, "
      "unnest(range(0, len(embedding))) AS p, unnest(list_transform(embedding, lambda x: round(x::double * 100.0))) AS v "
      "FROM embeddings WHERE len(embedding) = 64))")
_BORDER = "(a.i = 0 OR a.j = 0 OR a.i = 7 OR a.j = 7)"
_MEAN_SQL = (f"WITH {_G} SELECT a.vec_id, a.p AS pos, CAST(CASE WHEN {_BORDER} THEN a.v "
             "ELSE round_even(sum(b.v) / 9.0, 0) END AS BIGINT) AS value FROM g a JOIN g b ON a.vec_id = b.vec_id "
             "AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.vec_id, a.p, a.i, a.j, a.v")
_GX = "sum(b.v * (b.j - a.j) * CASE WHEN b.i = a.i THEN 2 ELSE 1 END)"
_GY = "sum(b.v * (b.i - a.i) * CASE WHEN b.j = a.j THEN 2 ELSE 1 END)"
_SOBEL_SQL = (f"WITH {_G} SELECT a.vec_id, a.p AS pos, CAST(CASE WHEN {_BORDER} THEN 0 "
              f"ELSE round_even(least(sqrt({_GX} * {_GX} + {_GY} * {_GY}), 255.0), 0) END AS BIGINT) AS value "
              "FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 "
              "GROUP BY a.vec_id, a.p, a.i, a.j, a.v")


@register("grid_reshape", f"WITH {_G} SELECT vec_id, i, j, CAST(v AS BIGINT) AS value FROM g")
def q_grid_reshape(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    rows = px.select("vec_id", F.posexplode(G.grid_reshape(F.col("px"), S)).alias("i", "r"))
    return rows.select("vec_id", F.col("i").cast("bigint").alias("i"), F.posexplode("r").alias("j", "value")) \
        .select("vec_id", "i", F.col("j").cast("bigint").alias("j"), F.col("value").cast("bigint").alias("value"))


@register("grid_flatten", f"WITH {_G} SELECT vec_id, p AS pos, CAST(v AS BIGINT) AS value FROM g")
def q_grid_flatten(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    return _explode(px, G.grid_flatten(G.grid_reshape(F.col("px"), S)))


@register("grid_mean3x3", _MEAN_SQL)
def q_grid_mean3x3(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    return _explode(px, G.mean3x3(F.col("px"), S))


@register("grid_sobel", _SOBEL_SQL)
def q_grid_sobel(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    return _explode(px, G.sobel(F.col("px"), S))


def _text_cells(spark, sf_dir):
    """The pixel rows as text cells, as a pixel CSV would give them."""
    return _ipx(spark, sf_dir).select("vec_id", F.transform("px", lambda x: x.cast("string")).alias("cells"))


@register("smooth_images", _MEAN_SQL)
def q_smooth_images(spark, sf_dir):
    out = G.smooth_images(_text_cells(spark, sf_dir), "cells", S)
    return _explode(out, F.col("cells"))


@register("sobel_images", _SOBEL_SQL)
def q_sobel_images(spark, sf_dir):
    out = G.sobel_images(_text_cells(spark, sf_dir), "cells", S)
    return _explode(out, F.col("cells"))


# 16 copies of the 64 pixels make a 32 x 32 image, the source programs' own size; the label picks a brightness.
_BIG = (_G.replace("p // 8 AS i, p % 8 AS j", "p // 32 AS i, p % 32 AS j").replace("range(0, len(embedding))", "range(0, 1024)")
        .replace("unnest(list_transform(embedding, lambda x: round(x::double * 100.0)))",
                 "unnest(list_transform(range(0, 1024), lambda k: round(embedding[k % 64 + 1]::double * 100.0) * (k // 64 + 1)))"))


@register("sobel_images_32", f"WITH {_BIG} " + _SOBEL_SQL.split(") SELECT a.vec_id", 1)[1].join(["SELECT a.vec_id", ""]).replace("a.i = 7", "a.i = 31").replace("a.j = 7", "a.j = 31"))
def q_sobel_images_32(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    tiled = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.transform("px", lambda x: (x * k).cast("string"))))
    return _explode(G.sobel_images(px.select("vec_id", tiled.alias("cells")), "cells", 32), F.col("cells"))


def _s(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


_P = ("p AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(x::double * 100.0) AS BIGINT)) AS px "
      "FROM embeddings)")


@register("arr_mutators", f"WITH {_P} SELECT vec_id, "
          "array_to_string(list_append(px, label::BIGINT), ',') AS appended, "
          "array_to_string(list_concat(px, list_reverse(px)), ',') AS extended, "
          "array_to_string(list_concat(px[1:3], [-1::BIGINT], px[4:]), ',') AS inserted, "
          "px[-1] AS popped, array_to_string(px[1:len(px) - 1], ',') AS rest, "
          "array_to_string(list_concat(px[1:list_position(px, px[6]) - 1], px[list_position(px, px[6]) + 1:]), ',') "
          "AS removed, array_to_string(list_sort(px), ',') AS sorted, array_to_string(list_reverse(px), ',') AS reversed, "
          "0::BIGINT AS cleared_len FROM p")
def q_arr_mutators(spark, sf_dir):
    p = _ipx(spark, sf_dir)
    px = F.col("px")
    return p.select(
        "vec_id",
        _s(A.py_append(px, F.col("label").cast("long"))).alias("appended"),
        _s(A.py_extend(px, A.py_reverse(px))).alias("extended"),
        _s(A.py_insert(px, 3, F.lit(-1).cast("long"))).alias("inserted"),
        A.py_pop_value(px).alias("popped"),
        _s(A.py_pop_rest(px)).alias("rest"),
        _s(A.py_remove(px, F.get(px, 5))).alias("removed"),
        _s(A.py_sort(px)).alias("sorted"),
        _s(A.py_reverse(px)).alias("reversed"),
        F.size(A.py_clear(px)).cast("bigint").alias("cleared_len"),
    )


@register("arr_access", f"WITH {_P} SELECT vec_id, len(px) AS n, px[-1] AS last, "
          "array_to_string(list_slice(px, 3, 50, 3), ',') AS sliced, "
          "array_to_string(list_slice(list_reverse(px), 1, len(px), 5), ',') AS rev_sliced, "
          "len(list_filter(px, lambda x: x = 0)) AS zeros, (list_position(px, list_max(px)) - 1)::BIGINT AS argmax, "
          "array_to_string(list_concat(px[1:3], px[5:]), ',') AS del_item, "
          "array_to_string(list_concat(px[1:10], px[21:]), ',') AS del_slice FROM p")
def q_arr_access(spark, sf_dir):
    p = _ipx(spark, sf_dir)
    px = F.col("px")
    return p.select(
        "vec_id",
        A.py_len(px).cast("bigint").alias("n"),
        A.py_getitem(px, -1).alias("last"),
        _s(A.py_slice(px, 2, 50, 3)).alias("sliced"),
        _s(A.py_slice(px, None, None, -5)).alias("rev_sliced"),
        A.py_count(px, 0).cast("bigint").alias("zeros"),
        A.py_index(px, F.array_max(px)).cast("bigint").alias("argmax"),
        _s(A.py_del_item(px, 3)).alias("del_item"),
        _s(A.py_del_slice(px, 10, 20)).alias("del_slice"),
    )


@register("arr_compose", f"WITH {_P} SELECT vec_id, array_to_string(list_concat(px, px), ',') AS doubled, "
          "array_to_string(list_concat(px[1:4], px[1:4], px[1:4]), ',') AS repeated, "
          "array_to_string(list_transform(list_filter(px, lambda x: x > 0), lambda x: x * 2), ',') AS comp, "
          "array_to_string([list_min(px), list_max(px), label::BIGINT], ',') AS nested FROM p")
def q_arr_compose(spark, sf_dir):
    p = _ipx(spark, sf_dir)
    px = F.col("px")
    nested = F.array(F.array(F.array_min(px), F.array_max(px)), F.array(F.col("label").cast("long")))
    return p.select(
        "vec_id",
        _s(A.py_concat(px, px)).alias("doubled"),
        _s(A.py_repeat(A.py_slice(px, None, 4), 3)).alias("repeated"),
        _s(A.py_comprehension(px, lambda x: x * 2, lambda x: x > 0)).alias("comp"),
        _s(F.flatten(nested)).alias("nested"),
    )


@register("arr_iterate", f"WITH {_P} SELECT vec_id, array_to_string(range(0, len(px), 7), ',') AS rng, "
          "array_to_string(range(len(px), 0, -9), ',') AS rng_desc, "
          "list_sum(list_transform(px, lambda x, i: x * (i - 1)))::BIGINT AS enum_dot, "
          "list_sum(list_transform(px[1:10], lambda x, i: x * list_reverse(px[1:10])[i]))::BIGINT AS zip_dot, "
          "list_sum(px)::BIGINT AS loop_total FROM p")
def q_arr_iterate(spark, sf_dir):
    p = _ipx(spark, sf_dir)
    px = F.col("px")
    zipped = A.py_zip(px, F.reverse(F.slice(px, 1, 10)))
    return p.select(
        "vec_id",
        _s(A.py_range(0, F.size(px), 7)).alias("rng"),
        _s(A.py_range(F.size(px), 0, -9)).alias("rng_desc"),
        F.aggregate(A.py_enumerate(px), F.lit(0).cast("long"),
                    lambda acc, s: acc + s["index"] * s["value"]).alias("enum_dot"),
        F.aggregate(zipped, F.lit(0).cast("long"), lambda acc, s: acc + s["_1"] * s["_2"]).alias("zip_dot"),
        F.aggregate(px, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("loop_total"),
    )
