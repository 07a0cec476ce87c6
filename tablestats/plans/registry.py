"""Registry of the queries run on the driver tables and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``oracle`` is equivalent SQL over the driver's views; leave it out only for
    operators SQL cannot express (the driver then checks row counts only).
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def rnd(expr: str, digits: int = 10) -> str:
    """SQL twin of ``tables.sig_round`` for one expression."""
    x = f"(({expr})::double)"
    e = f"({digits - 1} - floor(log10(abs({x}))))"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) OR isinf({x}) OR {x} = 0 "
            f"THEN {x} + 0.0::double WHEN {e} >= 0 THEN round({x} * pow(10.0, {e})) / pow(10.0, {e}) + 0.0::double "
            f"ELSE round({x} / pow(10.0, -{e})) * pow(10.0, -{e}) + 0.0::double END)")


def rnd_fixed(expr: str, decimals: int = 9) -> str:
    """SQL twin of ``tables.fixed_round``."""
    scale = float(10 ** decimals)
    return f"(round(({expr})::double * {scale!r}) / {scale!r} + 0.0::double)"
