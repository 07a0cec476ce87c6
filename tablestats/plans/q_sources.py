"""Queries for the text sources and sinks.

Each query first has Spark write a driver table as CSV into a fresh folder
under the shared checkpoint root, then reads it back with the operator, so
its work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablestats.operators import profile as P
from tablestats.operators.chunks import POSITION, chunk_rows, row_slice
from tablestats.operators.correlation import correlation_matrix
from tablestats.plans.registry import register
from tablestats.plans.tables import table
from tablestats.session import work_dir
from tablestats.sources import cells as CE
from tablestats.sources import text_table as TT
from tablestats.sources.images import pixel_row_check, resized_pixels


def _written(spark, df, name, **kw):
    path = work_dir(spark, name)
    TT.write_table(df, path, **kw)
    return path


# Lines as only the exact mode reads them: blank ones, short ones with a stray quote, padded cells, 21-digit integers.
@register("csv_scan", "SELECT CASE WHEN m = 0 THEN '' ELSE k::VARCHAR END AS k, CASE m WHEN 0 THEN NULL WHEN 1 THEN '\"quoted' WHEN 2 THEN 'a b' "
          "ELSE o_orderstatus END AS label, CASE WHEN m > 1 THEN CAST('123456789012345' || lpad((k % 1000000)::VARCHAR, 6, '0') AS DECIMAL(38, 0)) END AS big, "
          "CASE WHEN m = 2 THEN 1000.0 WHEN m > 2 THEN o_totalprice END::DOUBLE AS x "
          "FROM (SELECT *, o_orderkey AS k, o_orderkey % 10 AS m FROM orders)")
def q_csv_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, m = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 10
    big = F.concat(F.lit("123456789012345"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))
    line = (F.when(m == 0, F.lit("")).when(m == 1, F.concat(k, F.lit(',"quoted'))).when(m == 2, F.concat(F.lit("  "), k, F.lit(", a b ,"), big, F.lit(",1e3\t")))
            .otherwise(F.concat_ws(",", k, "o_orderstatus", big, F.col("o_totalprice").cast("string"))))
    path = work_dir(spark, "orders-text")
    # Every part file starts with the header, as the sink writes them.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    o.select(F.when(first, F.concat(F.lit("k,label,big,x\n"), line)).otherwise(line).alias("value")).write.mode("overwrite").text(path)
    return TT.read_table(spark, path, exact=True)


@register("csv_declared", "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_nationkey::INTEGER AS c_nationkey, c_acctbal FROM customer")
def q_csv_declared(spark, sf_dir):
    """A declared schema in exact, strict mode: one pass, types as declared."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return TT.read_table(spark, _written(spark, c, "customer-csv"), "c_custkey int, c_name string, c_nationkey int, c_acctbal double", exact=True, strict=True)


# A number of 45 digits per order, negative for every third: 23 digits before, 22 digits of the key behind.
_HIGH = "98765432109876543210987"
_BIG_SIGN = "CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END"


def _big_text(high, low):
    """SQL text of high * 10^22 + low for a HUGEINT pair of equal sign."""
    carry = f"(({high}) + ({low}) // 10000000000000000000000::HUGEINT)"
    return f"({carry})::VARCHAR || lpad((abs({low}) % 10000000000000000000000::HUGEINT)::VARCHAR, 22, '0')"


@register("csv_big_sum", f"WITH s AS (SELECT sum(({_BIG_SIGN}) * {_HIGH}::HUGEINT) AS h, sum(({_BIG_SIGN}) * o_orderkey::HUGEINT) AS l, sum(o_custkey) AS k, "
          "max(o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS least, max(o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS most FROM orders) "
          f"SELECT {_big_text('h', 'l')} AS total, '-{_HIGH}' || lpad(least::VARCHAR, 22, '0') AS smallest, '{_HIGH}' || lpad(most::VARCHAR, 22, '0') AS largest, k::DECIMAL(38, 0) AS keys FROM s")
def q_csv_big_sum(spark, sf_dir):
    """D1, D3 and D4 of a CSV column of 45-digit integers, as the exact mode reads it."""
    o = table(spark, sf_dir, "orders")
    big = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), F.lit(_HIGH), F.lpad(F.col("o_orderkey").cast("string"), 22, "0"))
    df = TT.read_table(spark, _written(spark, o.select(big.alias("big"), "o_custkey"), "big-csv"), exact=True)
    whole = P.column_sum(df).select(F.col("big").alias("total"), F.col("o_custkey").alias("keys"))
    low, high = P.column_min(df).select("big").scalar(), P.column_max(df).select("big").scalar()
    return whole.select("total", low.alias("smallest"), high.alias("largest"), "keys")


_CSV_CHUNKS = 7


@register("csv_chunks", "SELECT o_orderkey, o_totalprice, row_index, row_index // CAST(ceil(n / least(7, n)) AS BIGINT) AS chunk_id FROM "
          "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, count(*) OVER () AS n FROM orders)")
def q_csv_chunks(spark, sf_dir):
    """E2 on a CSV table in input order, by the places of its lines: nothing is sorted."""
    path = _written(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "orders-csv", order_by="o_orderkey")
    return chunk_rows(TT.read_table(spark, path, "o_orderkey bigint, o_totalprice double", exact=True), _CSV_CHUNKS, None)


@register("csv_slice", "SELECT o_orderkey, (row_index - 5) // 3 AS slice_pos FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, count(*) OVER () AS n FROM orders) "
          "WHERE row_index BETWEEN 5 AND n - 11 AND (row_index - 5) % 3 = 0")
def q_csv_slice(spark, sf_dir):
    """B9 on a CSV table, rows [5:-10:3] in input order."""
    path = _written(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "orders-csv", order_by="o_orderkey")
    df = TT.read_table(spark, path, exact=True, positions=True).select("o_orderkey", *POSITION)
    return row_slice(df, None, 5, -10, 3).select("o_orderkey", "slice_pos")


# SQL twins of cells.infer_cell (DuckDB: regexp_replace needs 'g' to replace every match).
def _strip_sql(c):
    return f"regexp_replace({c}, '{CE.STRIP_RE}', '', 'g')"


def _kind_sql(c):
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, '{CE.INT_RE}') THEN 'int' "
            f"WHEN regexp_matches({c}, '{CE.FLOAT_RE}') OR regexp_matches({c}, '{CE.SPECIAL_RE}') THEN 'float' "
            "ELSE 'str' END")


def _cells_sql():
    return ("c AS (SELECT p_partkey, unnest(range(0, 7)) AS pos, unnest(string_split(concat_ws(',', p_partkey, "
            "p_name, p_size, p_retailprice, p_brand, p_type, '99999999999999' || p_partkey), ',')) AS cell FROM part), "
            f"k AS (SELECT *, {_kind_sql('cell')} AS kind, regexp_replace({_strip_sql('cell')}, '_', '', 'g') AS plain, "
            f"{_strip_sql('cell')} AS stripped FROM c)")


def _part_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.concat_ws(",", "p_partkey", "p_name", "p_size", "p_retailprice", "p_brand", "p_type",
                       F.concat(F.lit("99999999999999"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", F.split(line, ",", -1).alias("cells"))


@register("infer_cell_type", f"WITH {_cells_sql()} SELECT p_partkey, pos, kind, "
          "CASE WHEN kind = 'int' THEN TRY_CAST(plain AS BIGINT) END AS i, "
          "CASE WHEN kind IN ('int', 'float') THEN TRY_CAST(plain AS DOUBLE) END AS d, "
          "CASE WHEN kind = 'str' THEN stripped END AS s, CASE WHEN kind = 'int' THEN TRY_CAST(plain AS DECIMAL(38, 0)) END AS n FROM k")
def q_infer_cell_type(spark, sf_dir):
    cells = _part_cells(spark, sf_dir)
    long = cells.select("p_partkey", F.posexplode_outer("cells").alias("pos", "cell")).where(F.col("pos").isNotNull())
    info = long.select("p_partkey", F.col("pos").cast("bigint").alias("pos"), CE.infer_cell(F.col("cell")).alias("x"))
    return info.select("p_partkey", "pos", "x.kind", "x.i", "x.d", "x.s", "x.n")


@register("infer_schema_profile", f"WITH {_cells_sql()} SELECT pos, count(*) FILTER (WHERE kind = 'int') AS n_int, "
          "count(*) FILTER (WHERE kind = 'float') AS n_float, count(*) FILTER (WHERE kind = 'str') AS n_str, "
          "count(*) FILTER (WHERE kind = 'int' AND TRY_CAST(plain AS BIGINT) IS NULL) AS n_big, 0::BIGINT AS n_huge, "
          "CASE WHEN count(*) FILTER (WHERE kind = 'str') > 0 THEN 'string' "
          "WHEN count(*) FILTER (WHERE kind = 'float') > 0 THEN 'double' "
          "WHEN count(*) FILTER (WHERE kind = 'int' AND TRY_CAST(plain AS BIGINT) IS NULL) > 0 THEN 'decimal(38,0)' ELSE 'bigint' END AS col_type "
          "FROM k GROUP BY pos")
def q_infer_schema_profile(spark, sf_dir):
    prof = CE.infer_schema_profile(_part_cells(spark, sf_dir)).drop("digits")
    return prof.withColumn("pos", F.col("pos").cast("bigint"))


@register("header_split", "SELECT pos, name, (SELECT count(*) FROM orders) AS body_rows FROM (VALUES "
                          "(0::BIGINT, 'o_orderkey'), (1::BIGINT, 'o_orderstatus'), (2::BIGINT, 'o_totalprice')) h(pos, name)")
def q_header_split(spark, sf_dir):
    path = _written(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "header-csv")
    names = TT.header_cells(spark, path)
    body = TT.read_cells(spark, path).agg(F.count(F.lit(1)).alias("body_rows"))
    return body.select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("pos", "name"), "body_rows") \
        .select(F.col("pos").cast("bigint").alias("pos"), "name", "body_rows")


@register("csv_sink", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount / 3 AS rate, l_tax * 1e-7 AS small, "
                      "'ship \"' || l_linestatus || '\", ' || l_returnflag AS note FROM lineitem")
def q_csv_sink(spark, sf_dir):
    """Rows of lineitem's size with float text, commas and quotes, written and read back."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_discount") / 3).alias("rate"), (F.col("l_tax") * 1e-7).alias("small"),
        F.concat(F.lit('ship "'), "l_linestatus", F.lit('", '), "l_returnflag").alias("note"))
    path = _written(spark, li, "lineitem-csv")
    return TT.read_table(spark, path, li.schema, strict=True)


_MM = ["l_quantity", "l_extendedprice", "l_discount"]


@register("csv_min_max", " UNION ALL ".join(f"SELECT {k}::INTEGER AS row, '{f}' AS label, " + ", ".join(f"{f}({c}) + 0.0 AS {c}" for c in _MM) + " FROM lineitem"
                                            for k, f in ((1, "min"), (2, "max"))))
def q_csv_min_max(spark, sf_dir):
    """The label/vector layout: a row of minima, a row of maxima."""
    li = table(spark, sf_dir, "lineitem").select(*_MM)
    rows = TT.labelled_layout({"min": P.column_min(li), "max": P.column_max(li)}).select("row", "label", *[(F.col(c) + 0.0).alias(c) for c in _MM])
    return TT.read_table(spark, _written(spark, rows, "min-max-csv", order_by="row"), rows.schema, strict=True)


@register("csv_matrix", "WITH t AS (SELECT * FROM lineitem) " + " UNION ALL ".join(
    f"SELECT {i + 1}::BIGINT AS row, " + ", ".join((f"round(corr({a}, {b}), 8) + 0.0" if a != b else "1.0::DOUBLE") + f" AS {b}" for b in _MM) + " FROM t"
    for i, a in enumerate(_MM)))
def q_csv_matrix(spark, sf_dir):
    """The p x p layout of a correlation matrix."""
    long = correlation_matrix(table(spark, sf_dir, "lineitem").select(*_MM))
    m = TT.matrix_layout(long.withColumn("corr", F.round("corr", 8) + 0.0), _MM).withColumn("row", F.col("row").cast("long"))
    return TT.read_table(spark, _written(spark, m, "matrix-csv", order_by="row"), m.schema, strict=True)


@register("csv_pixel_rows", "SELECT vec_id, " + ", ".join(f"round(embedding[{k + 1}]::DOUBLE * 100.0) + 0.0 AS p{k + 1}" for k in range(64)) + " FROM embeddings WHERE len(embedding) = 64")
def q_csv_pixel_rows(spark, sf_dir):
    """The layout of pixel rows, ``p1..p64``."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    px = e.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 100.0, 0) + 0.0).alias("px"))
    rows = TT.pixel_layout(px, "px", 8, keep=["vec_id"])
    return TT.read_table(spark, _written(spark, rows, "pixels-csv"), rows.schema, strict=True)


# Three colour bytes of every embedding entry, as an 8 x 8 image; 2 x 2 blocks of it are averaged.
@register("image_pixels", "WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(list_transform(embedding, lambda x: CAST(round(abs(x::DOUBLE) * 1000.0) AS BIGINT))) AS v "
          "FROM embeddings WHERE len(embedding) = 64), "
          "g AS (SELECT vec_id, p // 8 AS i, p % 8 AS j, ((v % 256) * 1868 + (v * 3 % 256) * 9617 + (v * 7 % 256) * 4899 + 8192) >> 14 AS grey FROM e) "
          "SELECT vec_id, (i // 2) * 4 + j // 2 AS pos, ((sum(grey) + 2) // 4)::BIGINT AS value FROM g GROUP BY vec_id, i // 2, j // 2")
def q_image_pixels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)

    def bgr(x):
        v = F.round(F.abs(x.cast("double")) * 1000.0, 0).cast("long")
        return F.concat(*[F.lpad(F.hex(v * k % 256), 2, "0") for k in (1, 3, 7)])

    raw = e.select("vec_id", F.unhex(F.array_join(F.transform("embedding", bgr), "")).alias("data"))
    px = raw.select("vec_id", resized_pixels("data", F.lit(8), F.lit(8), F.lit(3), 4).alias("px"))
    return px.select("vec_id", F.posexplode("px").alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("long").alias("value"))


@register("table_footprint", "SELECT count(*)::BIGINT AS rows, sum(len(c_custkey::VARCHAR || ',' || c_name || ',' "
                             "|| c_mktsegment) + 1)::BIGINT AS bytes, 3::BIGINT AS columns FROM customer")
def q_table_footprint(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = _written(spark, c, "customer-text", header=False, line_sep="\n")
    return TT.table_footprint(spark, path)


# Rows as a pixel file may hold them: short ones, a word, an empty cell, padded and signed numbers.
@register("pixel_row_filter", "SELECT vec_id, CASE WHEN len(embedding) <> 64 OR m = 0 THEN 'length' WHEN m IN (1, 2) THEN 'non-numeric' END AS reason, "
                              "NOT (len(embedding) <> 64 OR m < 3) AS ok FROM (SELECT *, vec_id % 5 AS m FROM embeddings)")
def q_pixel_row_filter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cells = F.transform("embedding", lambda x: F.round(x.cast("double") * 100.0, 0).cast("long").cast("string"))
    m = F.col("vec_id") % 5
    cells = (F.when(m == 0, F.slice(cells, 1, 63)).when(m == 1, F.concat(F.slice(cells, 1, 63), F.array(F.lit("dark"))))
             .when(m == 2, F.concat(F.array(F.lit("")), F.slice(cells, 2, 63))).when(m == 3, F.transform(cells, lambda c: F.concat(F.lit(" "), c, F.lit(".0 ")))).otherwise(cells))
    return pixel_row_check(e.select("vec_id", cells.alias("cells")), "cells", 8).select("vec_id", "reason", "ok")
