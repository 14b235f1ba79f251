"""Table-level cleaning rules: quality report, term standardisation, ordered rule
cascades and keyed patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import recode
from ._util import as_list, is_small


def quality_report(df: DataFrame, cols) -> DataFrame:
    """Per column: rows, nulls, empty strings and distinct values, in one pass.

    Output (column, n_rows, n_null, n_empty, n_distinct).
    """
    cols = as_list(cols)
    aggs = []
    for c in cols:
        v = F.col(f"`{c}`")
        empty = F.count_if(v.cast("string") == "")
        aggs += [F.count_if(v.isNull()).alias(f"{c}__null"), empty.alias(f"{c}__empty"),
                 F.count_distinct(v).alias(f"{c}__distinct")]
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"),
                              F.col(f"`{c}__null`").alias("n_null"),
                              F.col(f"`{c}__empty`").alias("n_empty"),
                              F.col(f"`{c}__distinct`").alias("n_distinct")) for c in cols])
    return (wide.select(F.col("__rows").alias("n_rows"), F.explode(rows).alias("_r"))
            .select("_r.column", "n_rows", "_r.n_null", "_r.n_empty", "_r.n_distinct"))


def standardize_terms(df: DataFrame, cols, synonyms: dict) -> DataFrame:
    """The same synonym map applied to several columns (values not in the map kept)."""
    return df.withColumns({c: recode(c, synonyms) for c in as_list(cols)})


def rule_cascade(df: DataFrame, out: str, rules: list[tuple[Column, Column]],
                 default: Column | None = None) -> DataFrame:
    """First matching rule wins; a null condition counts as no match.

    ``rules`` is an ordered list of (condition, value); use the existing column as
    value for a keep-existing rule.
    """
    expr = None
    for cond, val in rules:
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    expr = expr.otherwise(default if default is not None else F.lit(None)) if expr is not None else default
    return df.withColumn(out, expr)


def patch_rows(df: DataFrame, patches: DataFrame, key, max_broadcast_rows: int = 200_000) -> DataFrame:
    """Listed keys take the patch's non-null values; other rows unchanged.

    The patch list is broadcast when it is proven small, else shuffled with the table.
    """
    keys = as_list(key)
    cols = [c for c in patches.columns if c not in keys]
    p = patches.select(*keys, *[F.col(c).alias(f"__p_{c}") for c in cols])
    if is_small(p, max_broadcast_rows):
        p = F.broadcast(p)
    j = df.join(p, keys, "left")
    return j.select(*[F.coalesce(F.col(f"__p_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def replicate_levels(df: DataFrame, sample: str = "sample") -> DataFrame:
    """N9 (replicate check): how many bottles have 1, 2, 3, ... technical replicates."""
    s = df.select(sample).distinct().withColumn("bottle", F.substring_index(sample, ".", 1))
    per = s.groupBy("bottle").agg(F.count(F.lit(1)).alias("n_replicates"))
    return per.groupBy("n_replicates").agg(F.count(F.lit(1)).alias("n_bottles"))
