"""Queries D1-D8 and D13 on lineitem's numeric columns plus a constant column."""

from __future__ import annotations

from tablestats.operators import profile as P
from tablestats.plans.registry import register, rnd
from tablestats.plans.tables import CONST_COL, LINEITEM_NUMERIC, lineitem_numeric, tidy

COLS = LINEITEM_NUMERIC + [CONST_COL]
THRESHOLD = 20

_BASE = ("WITH t AS (SELECT " + ", ".join(
    f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in LINEITEM_NUMERIC)
    + f", 7.0::double AS {CONST_COL} FROM lineitem) ")


def _wide_sql(template: str, rounded: bool = True) -> str:
    parts = []
    for c in COLS:
        e = template.format(c=c)
        parts.append(f"{rnd(e) if rounded else e} AS {c}")
    return _BASE + "SELECT " + ", ".join(parts) + " FROM t"


_CONST_SQL = ("CASE WHEN count(*) = 0 THEN NULL WHEN count({c}) = 0 THEN 1 "
              "WHEN count({c}) = count(*) AND min({c}) = max({c}) THEN 1 ELSE 0 END")

_PROFILE_SQL = _BASE + "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS col_name, count({c}) AS n, {rnd(f'sum({c})')} AS sum,
        {rnd(f'min({c})')} AS min, {rnd(f'max({c})')} AS max, {rnd(f'avg({c})')} AS mean,
        count(*) FILTER (WHERE {c} > {THRESHOLD}) AS count_above,
        {rnd(f'coalesce(avg({c}) FILTER (WHERE {c} > {THRESHOLD}), 0.0::double)')} AS mean_above,
        {rnd(f'stddev_pop({c})')} AS std_pop, {_CONST_SQL.format(c=c)} AS is_const FROM t"""
    for c in COLS) + ")"


@register("column_profile", _PROFILE_SQL)
def q_column_profile(spark, sf_dir):
    return tidy(P.column_profile(lineitem_numeric(spark, sf_dir), threshold=THRESHOLD))


@register("column_sum", _wide_sql("sum({c})"))
def q_column_sum(spark, sf_dir):
    return tidy(P.column_sum(lineitem_numeric(spark, sf_dir)))


@register("column_mean", _wide_sql("avg({c})"))
def q_column_mean(spark, sf_dir):
    return tidy(P.column_mean(lineitem_numeric(spark, sf_dir)))


@register("column_min", _wide_sql("min({c})"))
def q_column_min(spark, sf_dir):
    return tidy(P.column_min(lineitem_numeric(spark, sf_dir)))


@register("column_max", _wide_sql("max({c})"))
def q_column_max(spark, sf_dir):
    return tidy(P.column_max(lineitem_numeric(spark, sf_dir)))


@register("column_std_pop", _wide_sql("stddev_pop({c})"))
def q_column_std_pop(spark, sf_dir):
    return tidy(P.column_std_pop(lineitem_numeric(spark, sf_dir)))


@register("count_above", _wide_sql(f"count(*) FILTER (WHERE {{c}} > {THRESHOLD})", rounded=False))
def q_count_above(spark, sf_dir):
    return P.count_above(lineitem_numeric(spark, sf_dir), threshold=THRESHOLD)


@register("mean_above", _wide_sql(f"coalesce(avg({{c}}) FILTER (WHERE {{c}} > {THRESHOLD}), 0.0::double)"))
def q_mean_above(spark, sf_dir):
    return tidy(P.mean_above(lineitem_numeric(spark, sf_dir), threshold=THRESHOLD))


@register("constant_columns", _wide_sql(_CONST_SQL, rounded=False))
def q_constant_columns(spark, sf_dir):
    return P.constant_columns(lineitem_numeric(spark, sf_dir))
