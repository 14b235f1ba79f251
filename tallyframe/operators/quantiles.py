"""Exact quantiles of groups by distributed selection: no task holds the values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import as_list, prefix_sum


def value_counts(df: DataFrame, by, x: str) -> DataFrame:
    """(by..., x, c, below, key): the distinct non-null values of a group with their number and
    the number of smaller ones. Equal values are one row; the rows are range-partitioned on
    (group, value), so a group is spread over tasks by its values. ``key`` names the group,
    null group columns included."""
    by = as_list(by)
    c = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumn("key", F.to_json(F.struct(*by)) if by else F.lit(""))
    p = prefix_sum(c, ["key"], [x], "c", "below")
    return p.withColumn("below", F.col("below").cast("bigint"))


def pick_quantiles(counts: DataFrame, x: str, qs: dict) -> DataFrame:
    """(key, n, one column per name of ``qs``): quantiles with linear interpolation between the
    two order statistics around ``q * (n - 1)``, from ``value_counts``."""
    n = counts.groupBy("key").agg(F.sum("c").alias("n"))
    j = counts.join(n, "key")
    at = lambda r: F.max(F.when((F.col("below") <= r) & (r < F.col("below") + F.col("c")), F.col(x)))
    aggs = []
    for name, q in qs.items():
        h = F.lit(float(q)) * (F.col("n") - 1)
        aggs += [at(F.floor(h)).cast("double").alias(f"__lo_{name}"), at(F.ceil(h)).cast("double").alias(f"__hi_{name}")]
    r = j.groupBy("key", "n").agg(*aggs)
    out = []
    for name, q in qs.items():
        h = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return r.select("key", "n", *out)


def grouped_quantiles(df: DataFrame, by, x: str, qs: dict) -> DataFrame:
    """(by..., one column per name of ``qs``). Groups whose values are all null have null ones."""
    by = as_list(by)
    groups = df.select(*by).distinct().withColumn("key", F.to_json(F.struct(*by)) if by else F.lit(""))
    q = pick_quantiles(value_counts(df, by, x), x, qs)
    return groups.join(q, "key", "left").select(*by, *qs)
