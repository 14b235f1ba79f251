"""Registry of named queries (Spark builder + optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .double_columns import DOUBLE_COLUMNS
from .oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple = (), ctes=None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the oracle's final SELECT; ``views`` names the oracle views it reads.
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        if sql is None:
            QUERIES[name] = fn
            return fn
        dbl = DOUBLE_COLUMNS.get(name, [])

        def checked(spark: SparkSession, d: str) -> DataFrame:
            # doubles are printed to 6 decimals on both sides (idempotent when the
            # query already rounds), so engines' last-bit differences do not matter
            return _round_doubles(fn(spark, d))
        checked.__doc__ = fn.__doc__
        QUERIES[name] = checked
        body = with_views(sql, *views, ctes=ctes)
        if dbl:
            rep = ", ".join(f'round("{c}", 6) AS "{c}"' for c in dbl)
            body = f"SELECT * REPLACE ({rep}) FROM ({body}) AS __q"
        ORACLES[name] = body
        return fn
    return deco


def _round_doubles(df: DataFrame) -> DataFrame:
    from ..operators._util import round_half_away
    from pyspark.sql import functions as F
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    if not cols:
        return df
    return df.withColumns({c: round_half_away(F.col(f"`{c}`"), 6) for c in cols})
