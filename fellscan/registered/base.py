"""The registry, and the rounding both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.catalog.clearCache()  # tables held by an earlier query of the session are not needed again
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def rnd(c: str | Column, places: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(col) < 0.5 * 10**-places, F.lit(0.0)).otherwise(F.round(col.cast("double"), places))


def rnd_many(c: str, places: int) -> Column:
    """``rnd`` for very many rows: whole multiples where no tie is near, which gives the same doubles; decimals for the rest."""
    scaled = F.col(c) * 10.0**places
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-5)
    return F.when(plain & (F.abs(scaled) >= 0.6), F.rint(scaled) / 10.0**places).otherwise(rnd(c, places))


def rd(expr: str, places: int = 6) -> str:
    return f"CASE WHEN abs({expr}) < {0.5 * 10**-places:.12f} THEN 0.0 ELSE round(CAST({expr} AS DOUBLE), {places}) END"
