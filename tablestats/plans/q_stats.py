"""Queries for z-score, correlation, partial merges, chunking, slices and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablestats.operators import chunks as C
from tablestats.operators import partials as PM
from tablestats.operators.correlation import correlation_matrix
from tablestats.operators.exact import exact_correlation, exact_statistics
from tablestats.operators.heavy import heavy_hitters
from tablestats.operators.zscore import zscore
from tablestats.plans.registry import register, rnd, rnd_fixed
from tablestats.plans.tables import CONST_COL, LINEITEM_NUMERIC, sig_round, table, tidy

COLS = LINEITEM_NUMERIC + [CONST_COL]
_T = ("t AS (SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in LINEITEM_NUMERIC)
    + f", 7.0::double AS {CONST_COL} FROM lineitem)")


def _lineitem(spark, sf_dir, keys=True):
    cols = (["l_orderkey", "l_linenumber"] if keys else []) + LINEITEM_NUMERIC
    return table(spark, sf_dir, "lineitem").select(*cols, F.lit(7.0).alias(CONST_COL))


_ZSCORE_SQL = ("WITH " + _T + ", s AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) = max({c}) AS k_{c}" for c in COLS)
    + " FROM t) SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{rnd_fixed(f'CASE WHEN {c} IS NULL THEN NULL WHEN k_{c} OR s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END', 6)} AS {c}"
    for c in COLS) + " FROM t, s")


@register("zscore", _ZSCORE_SQL)
def q_zscore(spark, sf_dir):
    return tidy(zscore(_lineitem(spark, sf_dir), COLS, keep=["l_orderkey", "l_linenumber"]), decimals=6)


def _corr_sql():
    stats = []
    for i, a in enumerate(COLS):
        stats += [f"stddev_pop({a}) AS sd_{a}", f"min({a}) = max({a}) AS k_{a}"]
        for b in COLS[i:]:
            stats.append(f"covar_pop({a}, {b}) AS cov_{a}_{b}")
    cells = []
    for i, a in enumerate(COLS):
        for j, b in enumerate(COLS):
            lo, hi = (a, b) if i <= j else (b, a)
            e = (f"CASE WHEN coalesce(k_{a}, true) OR coalesce(k_{b}, true) OR sd_{a} = 0 OR sd_{b} = 0 "
                 f"THEN 0.0 ELSE cov_{lo}_{hi} / (sd_{a} * sd_{b}) END")
            cells.append(f"SELECT '{a}' AS col_i, '{b}' AS col_j, {rnd_fixed(e)} AS corr FROM s")
    return "WITH " + _T + ", s AS (SELECT " + ", ".join(stats) + " FROM t) " + " UNION ALL ".join(cells)


@register("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf_dir):
    return tidy(correlation_matrix(_lineitem(spark, sf_dir, keys=False), COLS), decimals=9)


_WIDE_CORR_SQL = (
    "WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS k, unnest(embedding)::double AS v FROM embeddings), "
    "m AS (SELECT k, avg(v) AS mu, min(v) = max(v) AS c FROM e GROUP BY k), "
    "x AS (SELECT e.vec_id, e.k, e.v - m.mu AS d, m.c FROM e JOIN m USING (k)), "
    "q AS (SELECT k, sum(d * d) AS ss, any_value(c) AS c FROM x GROUP BY k), "
    "g AS (SELECT a.k AS i, b.k AS j, sum(a.d * b.d) AS s FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.k, b.k) "
    "SELECT 'd' || g.i AS col_i, 'd' || g.j AS col_j, "
    + rnd_fixed("CASE WHEN qi.c OR qj.c OR qi.ss = 0 OR qj.ss = 0 THEN 0.0 WHEN g.i = g.j THEN 1.0 "
                "ELSE g.s / sqrt(qi.ss * qj.ss) END")
    + " AS corr FROM g JOIN q qi ON qi.k = g.i JOIN q qj ON qj.k = g.j")


@register("correlation_matrix_wide", _WIDE_CORR_SQL)
def q_correlation_matrix_wide(spark, sf_dir):
    """D9 with each embedding dimension a column, as many as the vectors have."""
    e = table(spark, sf_dir, "embeddings")
    dims = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    wide = e.select(*[F.get("embedding", k).cast("double").alias(f"d{k}") for k in range(dims)])
    return tidy(correlation_matrix(wide), decimals=9)


# A column that is missing where the quantity is a multiple of 7, and one that is missing on odd lines.
_HOLES = {"q": "CASE WHEN CAST(l_quantity AS BIGINT) % 7 = 0 THEN NULL ELSE l_quantity END", "price": "l_extendedprice",
          "tax": "CASE WHEN l_linenumber % 2 = 1 THEN NULL ELSE l_tax END", "disc": "l_discount"}


def _holes_sql():
    h = list(_HOLES)
    pairs = [f"SELECT '{a}' AS col_i, '{b}' AS col_j, " + rnd_fixed("1.0" if a == b else f"(SELECT corr({a}, {b}) FROM t WHERE {{w}})", 8) + " AS corr"
             for a in h for b in h]
    base = "t AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _HOLES.items()) + " FROM lineitem)"
    full = " AND ".join(f"{c} IS NOT NULL" for c in h)
    return [f"WITH {base} " + " UNION ALL ".join(p.replace("{w}", w) for p in pairs) for w in (full, "true")]


def _holes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _HOLES.items()])


@register("correlation_complete", _holes_sql()[0])
def q_correlation_complete(spark, sf_dir):
    """D9 on columns with missing values, rows with any left out."""
    return tidy(correlation_matrix(_holes(spark, sf_dir)), decimals=8)


@register("correlation_pairwise", _holes_sql()[1])
def q_correlation_pairwise(spark, sf_dir):
    """D9 on columns with missing values, left out pair by pair."""
    return tidy(correlation_matrix(_holes(spark, sf_dir), missing="pairwise"), decimals=8)


_MERGE_SQL = (f"SELECT count(value) AS total_records_processed, {rnd('coalesce(sum(value), 0)')} AS overall_sum, "
              f"{rnd('CASE WHEN count(value) > 0 THEN sum(value) / count(value) ELSE 0 END')} AS overall_average, "
              f"{rnd('min(value)')} AS overall_minimum, {rnd('max(value)')} AS overall_maximum "
              "FROM (SELECT CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM events)")


_REPORT_SQL = (f"SELECT r.*, m.most_common FROM ({_MERGE_SQL}) r, (SELECT string_agg(item || '=' || frequency, ' ' ORDER BY frequency DESC, item) "
               "AS most_common FROM (SELECT event_type AS item, count(*) AS frequency FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) m")


def report_rows(report):
    """The report with its most common items as text."""
    text = F.array_join(F.transform("most_common", lambda x: F.concat(x["item"], F.lit("="), x["frequency"].cast("string"))), " ")
    return tidy(report.withColumn("most_common", text))


@register("partials_merge", _REPORT_SQL)
def q_partials_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return report_rows(PM.merge_partials(PM.partials_by_task(events, "value"), PM.frequency_partials_by_task(events, "event_type")))


@register("frequency_top5", "SELECT event_type AS item, count(*) AS frequency FROM events "
                            "GROUP BY event_type ORDER BY frequency DESC, item ASC LIMIT 5")
def q_frequency_top5(spark, sf_dir):
    return PM.merge_frequencies(PM.frequency_partials_by_task(table(spark, sf_dir, "events"), "event_type"), k=5)


# Seven keys hold a third of the rows, every other row has a key of its own.
_HOT_KEY = "CASE WHEN l_orderkey % 3 = 0 THEN concat('s', CAST(l_suppkey % 7 AS {text})) ELSE concat(CAST(l_orderkey AS {text}), '-', CAST(l_linenumber AS {text})) END"


@register("heavy_hitters", f"SELECT {_HOT_KEY.format(text='VARCHAR')} AS item, count(*) AS frequency FROM lineitem GROUP BY 1 ORDER BY frequency DESC, item ASC LIMIT 5")
def q_heavy_hitters(spark, sf_dir):
    """D11 on a column of mostly distinct values: summaries per task, then an exact count of the candidates."""
    return heavy_hitters(table(spark, sf_dir, "lineitem").select(F.expr(_HOT_KEY.format(text="STRING")).alias("key")), "key", 5)


# Sums of doubles as whole numbers of 2^-60, which all these values are: exact in SQL too.
_UNIT = 2.0**60


def _exact_sql(c):
    return f"((sum(({c} * {_UNIT!r})::HUGEINT))::VARCHAR::DOUBLE / {_UNIT!r})"


#: Large and small numbers of both signs, by powers of two, so that sums in any order of doubles lose digits.
_SWING = "l_extendedprice * CASE WHEN l_linenumber % 2 = 0 THEN 1048576.0{d} ELSE -0.0009765625{d} END"
_EXACT = LINEITEM_NUMERIC + ["swing"]


@register("exact_sums", "WITH t AS (SELECT " + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in _EXACT)
          + f" FROM (SELECT *, {_SWING.format(d='::DOUBLE')} AS swing FROM lineitem)) " + " UNION ALL ".join(
              f"SELECT '{c}' AS col_name, count({c}) AS n, {_exact_sql(c)} AS sum, {_exact_sql(c)} / count({c}) AS mean, {rnd(f'stddev_pop({c})', 8)} AS std_pop FROM t" for c in _EXACT))
def q_exact_sums(spark, sf_dir):
    """D1, D2 and D5 without order dependence: sums and means are compared unrounded."""
    li = table(spark, sf_dir, "lineitem").select(*LINEITEM_NUMERIC, F.expr(_SWING.format(d="D")).alias("swing"))
    return exact_statistics(li).withColumn("std_pop", sig_round("std_pop", 8))


@register("exact_merge", f"SELECT count(value) AS total_records_processed, {_exact_sql('value')} AS overall_sum, {_exact_sql('value')} / count(value) AS overall_average, "
          "min(value) AS overall_minimum, max(value) AS overall_maximum FROM (SELECT CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM events)")
def q_exact_merge(spark, sf_dir):
    """D10 of one partial per user: the report is compared unrounded."""
    return PM.merge_partials(PM.partials_by(table(spark, sf_dir, "events").select("user_id", "value"), "user_id", "value", exact=True))


@register("exact_correlation", _holes_sql()[0])
def q_exact_correlation(spark, sf_dir):
    """D9 from exact sums, on columns with missing values."""
    return tidy(exact_correlation(_holes(spark, sf_dir)), decimals=8)


K_CHUNKS = 7
_ORDERS_CHUNKED = ("o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, "
                   "count(*) OVER () AS n FROM orders), "
                   f"c AS (SELECT *, row_index // CAST(ceil(n / least({K_CHUNKS}, n)) AS BIGINT) AS chunk_id FROM o)")


def _orders_chunked(spark, sf_dir, *cols):
    # Only what the queries below use is sorted and written.
    return C.chunk_rows(table(spark, sf_dir, "orders").select("o_orderkey", *cols), K_CHUNKS, "o_orderkey")


@register("chunk_rows", f"WITH {_ORDERS_CHUNKED} SELECT o_orderkey, row_index, chunk_id FROM c")
def q_chunk_rows(spark, sf_dir):
    return _orders_chunked(spark, sf_dir).select("o_orderkey", "row_index", "chunk_id")


@register("chunk_rows_input_order", "WITH o AS (SELECT s_suppkey, file_row_number AS row_index, count(*) OVER () AS n FROM "
                                    "(SELECT s_suppkey, row_number() OVER () - 1 AS file_row_number FROM supplier)) "
                                    f"SELECT s_suppkey, row_index, row_index // CAST(ceil(n / least({K_CHUNKS}, n)) AS BIGINT) AS chunk_id FROM o")
def q_chunk_rows_input_order(spark, sf_dir):
    """E2 by position in the input file, without a sort."""
    return C.chunk_rows(table(spark, sf_dir, "supplier").select("s_suppkey"), K_CHUNKS, None).select("s_suppkey", "row_index", "chunk_id")


@register("chunk_partials", f"WITH {_ORDERS_CHUNKED} SELECT count(o_totalprice) AS total_records_processed, "
                            f"{rnd('sum(o_totalprice)')} AS overall_sum, {rnd('avg(o_totalprice)')} AS overall_average, "
                            f"{rnd('min(o_totalprice)')} AS overall_minimum, {rnd('max(o_totalprice)')} AS overall_maximum "
                            "FROM c")
def q_chunk_partials(spark, sf_dir):
    chunked = _orders_chunked(spark, sf_dir, "o_totalprice")
    return tidy(PM.merge_partials(PM.partials_by(chunked, "chunk_id", "o_totalprice")))


def _merge_tag_sql():
    p = ("p AS (SELECT chunk_id, sum(o_totalprice) AS s0, sum(o_custkey) AS s1, avg(o_totalprice) AS a0, "
         "avg(o_custkey) AS a1, count(*) AS cnt, max(o_totalprice) AS m0, max(o_custkey) AS m1, "
         "min(o_totalprice) AS n0, min(o_custkey) AS n1, max(o_totalprice) / avg(o_totalprice) AS i0 "
         "FROM (SELECT chunk_id, o_totalprice, o_custkey::double AS o_custkey FROM c) GROUP BY chunk_id)")
    parts = [
        ("s", 0, "sum(s0)"), ("s", 1, "sum(s1)"),
        ("a", 0, "sum(a0 * cnt) / sum(cnt)"), ("a", 1, "sum(a1 * cnt) / sum(cnt)"),
        ("m", 0, "max(m0)"), ("m", 1, "max(m1)"), ("n", 0, "min(n0)"), ("n", 1, "min(n1)"),
        ("l", 0, "sum(cnt)"), ("i", 0, "product(i0)"),
    ]
    sel = [f"SELECT '{t}' AS tag, {pos}::BIGINT AS pos, {rnd(e)} AS value FROM p" for t, pos, e in parts]
    sel.append(f"SELECT 'c' AS tag, chunk_id::BIGINT AS pos, {rnd('cnt')} AS value FROM p")
    return f"WITH {_ORDERS_CHUNKED}, {p} " + " UNION ALL ".join(sel)


@register("merge_by_tag", _merge_tag_sql())
def q_merge_by_tag(spark, sf_dir):
    chunked = _orders_chunked(spark, sf_dir, "o_totalprice", "o_custkey").withColumn("o_custkey", F.col("o_custkey").cast("double"))
    per_chunk = chunked.groupBy("chunk_id").agg(
        F.array(F.sum("o_totalprice"), F.sum("o_custkey")).alias("s"),
        F.array(F.avg("o_totalprice"), F.avg("o_custkey")).alias("a"),
        F.array(F.max("o_totalprice"), F.max("o_custkey")).alias("m"),
        F.array(F.min("o_totalprice"), F.min("o_custkey")).alias("n"),
        F.array(F.count(F.lit(1)).cast("double")).alias("l"),
        F.array(F.max("o_totalprice") / F.avg("o_totalprice")).alias("i"),
        F.count(F.lit(1)).alias("cnt"),
    ).checkpoint()  # one row per chunk; every tag below reads it instead of re-deriving it
    merged = PM.merge_tagged(per_chunk, {t: t for t in ["s", "a", "m", "n", "l", "i"]}, weight_col="cnt")
    concat = PM.merge_by_tag(per_chunk, "c", value_col="l")
    out = merged.select("tag", F.col("pos").cast("bigint").alias("pos"), "value").unionByName(
        concat.select(F.lit("c").alias("tag"), F.col("pos").cast("bigint").alias("pos"),
                      F.col("value").cast("double").alias("value")))
    return tidy(out)


@register("sort_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def q_sort_top_k(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return C.sort_top_k(o, "o_totalprice", 10, tie_by=["o_orderkey"])


@register("row_slice", "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index "
                       "FROM orders) SELECT o_orderkey, row_index, (row_index - 5) // 3 AS slice_pos FROM o "
                       "WHERE row_index >= 5 AND (row_index - 5) % 3 = 0")
def q_row_slice(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return C.row_slice(o, "o_orderkey", lo=5, hi=None, step=3)


@register("row_concat", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, 0 AS part_id FROM customer "
                        "UNION ALL SELECT s_suppkey, s_name, s_acctbal, 1 FROM supplier")
def q_row_concat(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                                   F.col("c_acctbal").alias("acctbal"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                                                   F.col("s_acctbal").alias("acctbal"))
    return C.row_concat(cust, supp)
