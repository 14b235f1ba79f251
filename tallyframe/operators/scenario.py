"""Environmental scenarios, projections and summary tests.

Random draws use a counter-based generator (``xxhash64`` of the row key, draw
index and seed), so they do not depend on partitioning or task retries.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import Texts, binomial_at, binomial_inverse, md5_places
from ..functions.stats import norm_ppf, pnorm_col
from ._util import as_list, is_small, prefix_sum, with_group_agg
from .product import Product
from .quantiles import grouped_quantiles
from .sparse import SparseTable

# Fixed values that must equal the reference's for identical results:
# linear trends over 2000-2095 (pH -0.18, temperature +1.51) and the year window
# whose predicted change spread is added to the pH sd.
TREND_START, TREND_END = 2000, 2095
PH_TREND, T_TREND = -0.18, 1.51
TREND_SD_YEARS = (2020, 2080)


def join_environment(taxa: DataFrame, env: DataFrame, event: str = "event",
                     drop_pattern: str | None = "DO") -> DataFrame:
    """Drop oxygen columns, keep complete environment rows, keep every taxa row
    (right join on site and date parsed from ``event`` = ``site_YYYYMM``)."""
    e = env
    if drop_pattern:
        e = e.drop(*[c for c in env.columns if re.search(drop_pattern, c)])
    e = e.na.drop()
    t = (taxa.withColumn("site", F.substring_index(event, "_", 1))
         .withColumn("date", F.try_to_timestamp(F.concat(F.regexp_extract(event, r"_(.*)$", 1), F.lit("01")),
                                                F.lit("yyyyMMdd")).cast("date")))
    return e.join(t, ["site", "date"], "right")


def standardize_by(df: DataFrame, cols, by=None, suffix: str = "_std") -> DataFrame:
    """M1: z-score with the sample sd (n - 1), per group or overall. Columns with zero
    or undefined spread are kept as they are."""
    cols, by = as_list(cols), as_list(by)
    aggs = {}
    for c in cols:
        aggs[f"__m_{c}"] = F.avg(c)
        aggs[f"__s_{c}"] = F.stddev_samp(c)
    if by:
        r = with_group_agg(df, by, **aggs)
    else:
        r = df
        for k, e in aggs.items():
            r = r.withColumn(k, df.select(e).scalar())
    for c in cols:
        s = F.col(f"__s_{c}")
        r = r.withColumn(c + suffix, F.when(s.isNull() | (s == 0), F.col(c))
                         .otherwise((F.col(c) - F.col(f"__m_{c}")) / s))
    return r.drop(*aggs.keys())


def std_constants(df: DataFrame, cols, by) -> DataFrame:
    """M2: (group..., key, mean, sd) so new rows can be put on the same scale."""
    by = as_list(by)
    long = df.unpivot(by, as_list(cols), "key", "value")
    return long.groupBy(*by, "key").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def to_std(df: DataFrame, constants: DataFrame, col: str, key: str, by, out: str | None = None) -> DataFrame:
    """M2: (x - mean) / sd with the constants of ``key`` for the row's group."""
    by = as_list(by)
    c = constants.where(F.col("key") == key).select(*by, F.col("mean").alias("__m"), F.col("sd").alias("__s"))
    # one row per group: the planner broadcasts it when its statistics say it is small
    return df.join(c, by, "left").withColumn(out or f"{col}_std", F.try_divide(F.col(col) - F.col("__m"), F.col("__s"))) \
        .drop("__m", "__s")


def from_std(df: DataFrame, constants: DataFrame, col: str, key: str, by, out: str | None = None) -> DataFrame:
    """M2: inverse of ``to_std``."""
    by = as_list(by)
    c = constants.where(F.col("key") == key).select(*by, F.col("mean").alias("__m"), F.col("sd").alias("__s"))
    return df.join(c, by, "left").withColumn(out or f"{col}_value", F.col(col) * F.col("__s") + F.col("__m")) \
        .drop("__m", "__s")


def presence_table(df: DataFrame, event: str = "event", taxon: str = "taxon", value: str = "edna_index",
                   event_attrs=(), exclude: str | None = None) -> SparseTable:
    """M3 without its zeros: the present (event, taxon) cells and the two key lists."""
    x = df if exclude is None else df.where(~F.col(taxon).rlike(exclude))
    return SparseTable.of(x, event, taxon, value, event_attrs).presence()


def presence_matrix(df: DataFrame, event: str = "event", taxon: str = "taxon", value: str = "edna_index",
                    event_attrs=(), exclude: str | None = None) -> DataFrame:
    """M3: every event x taxon with 1 when present (value > 0) and 0 otherwise: the dense form
    of ``presence_table``, for results (the operators that follow work on the sparse one)."""
    t = presence_table(df, event, taxon, value, event_attrs, exclude)
    return t.dense().select(taxon, *t.rows.columns, "presence")


def prevalence_filter(df: DataFrame, taxon: str = "taxon", presence: str = "presence",
                      lo: int = 7, hi: int = 69) -> DataFrame:
    """M4: keep taxa present in strictly more than ``lo`` and fewer than ``hi`` events."""
    r = with_group_agg(df, taxon, __n=F.sum(presence))
    return r.where((F.col("__n") > lo) & (F.col("__n") < hi)).drop("__n")


def dense_index(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """M5: integer code 1..k for the sorted distinct values of ``col``: the distinct
    values get 1 + (number of smaller values) from a range-partitioned prefix sum,
    then are joined back; no single-task global sort."""
    vals = df.select(col).distinct().where(F.col(col).isNotNull()).withColumn("__one", F.lit(1))
    codes = prefix_sum(vals, [], [col], "__one", "__p")
    codes = codes.select(col, (F.col("__p") + 1).cast("int").alias(out or f"{col}_id"))
    return df.join(codes, col, "left")


def row_index(df: DataFrame, order, out: str = "row") -> DataFrame:
    """M5: 1-based row number in a total ``order`` (the order columns must identify a
    row), from a range-partitioned prefix count: no single-task global sort."""
    r = prefix_sum(df.withColumn("__one", F.lit(1)), [], as_list(order), "__one", "__p")
    return r.withColumn(out, (F.col("__p") + 1).cast("bigint")).drop("__one", "__p")


def sample_groups(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """M6: keep ``n`` keys chosen by a seeded hash order (a sampling operator)."""
    return df.join(sampled_keys(df.select(key), key, n, seed), key, "left_semi")


def sampled_keys(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """The ``n`` distinct keys that come first by md5 of ``key|seed``."""
    mark = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(mark, key).limit(n)


def trend_sd(change: float, start: int = TREND_START, end: int = TREND_END,
             years=TREND_SD_YEARS) -> float:
    """Population sd of the linear change predicted for each year in ``years``."""
    slope = change / (end - start)
    vals = [slope * (y - start) for y in range(years[0], years[1] + 1)]
    m = sum(vals) / len(vals)
    return math.sqrt(sum((v - m) ** 2 for v in vals) / len(vals))


def scenario_params(env: DataFrame, years, area: str = "area", temperature: str = "temperature",
                    ph: str = "ph") -> DataFrame:
    """Per area observed normal fit (population sd) shifted by the linear trend of
    each year; the pH sd also adds the spread of the trend. Years outside the trend
    window are an error."""
    years = [int(y) for y in years]
    outside = [y for y in years if not TREND_START <= y <= TREND_END]
    if outside:
        raise ValueError(f"years outside the trend window {TREND_START}-{TREND_END}: {outside}")
    fit = env.groupBy(area).agg(F.avg(temperature).alias("t_obs"), F.stddev_pop(temperature).alias("t_sd"),
                                F.avg(ph).alias("ph_obs"), F.stddev_pop(ph).alias("ph_sd0"))
    fit = fit.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    frac = (F.col("year") - TREND_START) / float(TREND_END - TREND_START)
    return fit.select(area, "year",
                      (F.col("t_obs") + frac * T_TREND).alias("t_mean"), "t_sd",
                      (F.col("ph_obs") + frac * PH_TREND).alias("ph_mean"),
                      (F.col("ph_sd0") + trend_sd(PH_TREND)).alias("ph_sd"))


def hash_uniform(*cols) -> Column:
    """Uniform (0, 1) from a 64-bit hash of the given columns (partition independent)."""
    h = F.xxhash64(*cols)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def md5_uniform(*cols) -> Column:
    """Uniform (0, 1) from the md5 of the columns' texts joined by bars: the same in every
    engine. For keys that are strings and whole numbers."""
    mark = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))
    return (F.conv(F.substring(mark, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def md5_normal(*cols) -> Column:
    """Standard normal via Box-Muller from two md5 uniforms."""
    return F.sqrt(-2.0 * F.log(md5_uniform(*cols, F.lit("u1")))) * F.cos(2 * math.pi * md5_uniform(*cols, F.lit("u2")))


def hash_normal(*cols) -> Column:
    """Standard normal via Box-Muller from two independent hash uniforms."""
    u1 = hash_uniform(*cols, F.lit("u1"))
    u2 = hash_uniform(*cols, F.lit("u2"))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)


def scenario_draws(params: DataFrame, n: int, seed: int = 1, ref_year: int | None = None,
                   area: str = "area") -> DataFrame:
    """``n`` draws per (area, year) of temperature and pH; with ``ref_year`` the
    draws are standardised by that year's distribution."""
    d = params.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    key = [F.col(area), F.col("year"), F.col("draw"), F.lit(seed)]
    d = d.withColumn("temperature", F.col("t_mean") + F.col("t_sd") * md5_normal(*key, F.lit("t")))
    d = d.withColumn("ph", F.col("ph_mean") + F.col("ph_sd") * md5_normal(*key, F.lit("ph")))
    if ref_year is not None:
        ref = params.where(F.col("year") == ref_year).select(
            area, F.col("t_mean").alias("__tm"), F.col("t_sd").alias("__ts"),
            F.col("ph_mean").alias("__pm"), F.col("ph_sd").alias("__ps"))
        d = (d.join(ref, area)
             .withColumn("temperature", (F.col("temperature") - F.col("__tm")) / F.col("__ts"))
             .withColumn("ph", (F.col("ph") - F.col("__pm")) / F.col("__ps"))
             .drop("__tm", "__ts", "__pm", "__ps"))
    return d.select(area, "year", "draw", "temperature", "ph")


def trim_tails(df: DataFrame, cols=("temperature", "ph"), by=("year", "area"), lo: float = 0.03,
               hi: float = 0.98, relabel: dict | None = None, year: str = "year") -> DataFrame:
    """Optionally relabel years, refit a normal (population sd) per group and drop
    rows in the lower ``lo`` or upper ``hi`` tail of any column."""
    r = df
    if relabel:
        m = F.create_map(*[F.lit(x) for kv in relabel.items() for x in kv])
        r = r.withColumn(year, F.coalesce(m[F.col(year)], F.col(year)))
    aggs = {}
    for c in as_list(cols):
        aggs[f"__m_{c}"] = F.avg(c)
        aggs[f"__s_{c}"] = F.stddev_pop(c)
    r = with_group_agg(r, as_list(by), **aggs)
    zl, zh = norm_ppf(lo), norm_ppf(hi)
    keep = F.lit(True)
    for c in as_list(cols):
        m, s = F.col(f"__m_{c}"), F.col(f"__s_{c}")
        keep = keep & (F.col(c) >= m + zl * s) & (F.col(c) <= m + zh * s)
    return r.where(keep).drop(*aggs.keys())


def group_ranges(df: DataFrame, by, cols) -> DataFrame:
    """Min and max of several columns per group."""
    aggs = []
    for c in as_list(cols):
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*as_list(by)).agg(*aggs)


def range_grid(df: DataFrame, by, x: str, y: str, step: float = 0.1) -> DataFrame:
    """Per group a regular grid from the rounded min to the rounded max of two
    variables (rounding half to even, integer steps so no float drift)."""
    digits = max(0, -int(math.floor(math.log10(step) + 1e-9)))
    scale = round(1 / step)
    r = group_ranges(df, by, [x, y])

    def seq(c):
        lo = F.round(F.bround(F.col(f"{c}_min"), digits) * scale).cast("bigint")
        hi = F.round(F.bround(F.col(f"{c}_max"), digits) * scale).cast("bigint")
        return F.sequence(lo, hi)
    g = r.select(*as_list(by), F.explode(seq(x)).alias("__x"), seq(y).alias("__ys"))
    g = g.select(*as_list(by), "__x", F.explode("__ys").alias("__y"))
    return g.select(*as_list(by), (F.col("__x") / float(scale)).alias(x), (F.col("__y") / float(scale)).alias(y))


def score_taxa(coef: DataFrame, points: DataFrame, by: str = "area", x: str = "temperature",
               y: str = "ph", out: str = "p") -> DataFrame:
    """M9: probability of presence of every taxon at every point of its area
    (logistic of intercept + b_t * x + b_ph * y), an equi-join on the area."""
    j = coef.join(points, by)
    eta = F.col("intercept") + F.col("b_t") * F.col(x) + F.col("b_ph") * F.col(y)
    return j.withColumn(out, 1.0 / (1.0 + F.exp(-eta)))


def logistic_of_pairs(x: str = "temperature", y: str = "ph"):
    """M9 of a product's pairs: coefficients of its first table at the points of its second."""
    def run(a, b, values):
        eta = a["b_t"] * b[x]
        eta += a["intercept"]
        eta += a["b_ph"] * b[y]
        with np.errstate(over="ignore"):
            e = np.exp(np.negative(eta, out=eta), out=eta)
        e += 1.0
        return np.divide(1.0, e, out=e)
    return run


#: Trials that one uniform is inverted for; more trials take several uniforms.
MAX_TRIALS = 512


def _binomial_inverse(n: int):
    """Successes of ``n`` trials of probability p at the place u of their distribution function."""
    @F.pandas_udf("double")
    def run(u: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(binomial_inverse(u.to_numpy(float), p.to_numpy(float), n))
    return run


def binomial_mean(df: DataFrame | Product, p: str, key_cols, n: int = 100, seed: int = 1, out: str = "mean_presence") -> DataFrame | Product:
    """Mean of ``n`` Bernoulli(p) draws per row from one uniform: the number of successes
    is read off the binomial distribution at that place (several uniforms for more than
    ``MAX_TRIALS`` draws). The uniform is the md5 of the row's keys, so results do not depend on
    partitioning and can be checked in SQL. The pairs of a product have the same means, hashed by
    numpy; the keys of its first table come first."""
    keys = [F.col(c) for c in as_list(key_cols)]
    parts = [MAX_TRIALS] * (n // MAX_TRIALS) + [n % MAX_TRIALS] * (n % MAX_TRIALS > 0)
    if isinstance(df, Product):
        return _binomial_means_of_pairs(df, p, as_list(key_cols), n, parts, seed, out)
    found = F.lit(0.0)
    for i, m in enumerate(parts):
        more = [F.lit(i)] if i else []
        found = found + _binomial_inverse(m)(md5_uniform(*keys, F.lit(seed), *more), F.col(p).cast("double"))
    return df.withColumn(out, F.nanvl(found, F.lit(None).cast("double")) / float(n))


def _binomial_means_of_pairs(pairs: Product, p: str, keys: list, n: int, parts: list, seed: int, out: str) -> Product:
    heads = keys[:next((i for i, c in enumerate(keys) if c not in pairs.a.columns), len(keys))]
    if not set(keys[len(heads):]) <= set(pairs.b.columns):
        raise ValueError(f"the keys of a product's first table come first: {keys}")
    text = lambda cols, *more: F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in cols], *[F.lit(str(x)) for x in more])
    tails = {f"__tail{i}": text(keys[len(heads):], seed, *([i] if i else [])) for i in range(len(parts))}
    trials = list(zip(tails, parts, strict=True))

    def run(a, b, values):
        return sum(binomial_at(*md5_places(a["__head"], b[tail]), values[p], m) for tail, m in trials) / float(n)
    # an empty text at the end leaves a bar there; null keys leave nothing, as in one text of all
    return pairs.with_value(out, run, a={"__head": text(heads, "")}, b=tails)


def bernoulli_mean(df: DataFrame, p: str, key_cols, n: int = 100, seed: int = 1,
                   out: str = "mean_presence") -> DataFrame:
    """Mean of ``n`` Bernoulli(p) draws per row, computed with a higher-order
    aggregate over the draw index (no row explosion, no shuffle)."""
    keys = [F.col(c) for c in as_list(key_cols)]
    cnt = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0),
                      lambda acc, i: acc + F.when(hash_uniform(*keys, i, F.lit(seed)) < F.col(p), 1).otherwise(0))
    return df.withColumn(out, cnt / float(n))


def bernoulli_draws(df: DataFrame, p: str, key_cols, n: int = 100, seed: int = 1) -> DataFrame:
    """The individual draws (one row per draw) when they are needed."""
    keys = [F.col(c) for c in as_list(key_cols)]
    d = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return d.withColumn("present", (hash_uniform(*keys, F.col("draw"), F.lit(seed)) < F.col(p)).cast("int"))


def predict_class(coef: DataFrame, points: DataFrame, point_cols, by: str = "area",
                  x: str = "temperature", y: str = "ph", cls: str = "cluster") -> DataFrame:
    """Most likely class per point: equi-join on the area with the per-class
    linear scores, then ``max_by`` (softmax is monotone, so no exponentials)."""
    j = coef.join(points, by)
    score = F.col("intercept") + F.col("b_t") * F.col(x) + F.col("b_ph") * F.col(y)
    j = j.withColumn("__s", score)
    return j.groupBy(by, *as_list(point_cols)).agg(
        F.max_by(F.col(cls), F.struct(F.col("__s"), -F.col(cls))).alias(cls))


def class_prevalence(df: DataFrame, by, cls: str = "cluster", wide: bool = False,
                     classes: list | None = None) -> DataFrame:
    """Share of rows of each class per group (optionally one column per class;
    pass ``classes`` to skip the pass that discovers the pivot values)."""
    by = as_list(by)
    g = df.groupBy(*by, cls).agg(F.count(F.lit(1)).alias("n"))
    g = with_group_agg(g, by, __t=F.sum("n")).withColumn("share", F.col("n") / F.col("__t")).drop("__t")
    if wide:
        p = g.groupBy(*by)
        p = p.pivot(cls, classes) if classes is not None else p.pivot(cls)
        return p.agg(F.first("share")).fillna(0.0)
    return g


def richness_by_point(df: DataFrame | Product, point_cols, group: str = "phylum", p: str = "p") -> DataFrame:
    """Expected richness (sum of probabilities) per point and group, plus the
    point total. A product's pairs are summed in its pieces first."""
    pc = as_list(point_cols)
    if isinstance(df, Product):
        df = df.sums(pc, group, p)
    g = df.groupBy(*pc, group).agg(F.sum(p).alias("richness"))
    return with_group_agg(g, pc, total=F.sum("richness"))


def relative_to_max(df: DataFrame, by, col: str, out: str | None = None) -> DataFrame:
    """Value divided by its group's maximum."""
    r = with_group_agg(df, as_list(by), __mx=F.max(col))
    return r.withColumn(out or f"{col}_rel", F.col(col) / F.col("__mx")).drop("__mx")


def taxon_change(df: DataFrame, taxon: str, area: str, year: str, value: str, y0, y1,
                 areas: list, group: str | None = None) -> DataFrame:
    """Mean per (taxon, area) in two years, their difference, one column per area,
    summed absolute change and the rank of that change within ``group``."""
    g = df.groupBy(taxon, area).agg(
        F.avg(F.when(F.col(year) == y0, F.col(value))).alias("__a"),
        F.avg(F.when(F.col(year) == y1, F.col(value))).alias("__b"))
    g = g.withColumn("diff", F.col("__a") - F.col("__b"))
    w = g.groupBy(taxon).pivot(area, areas).agg(F.first("diff"))
    for a in areas:
        w = w.withColumnRenamed(a, f"diff_{a}")
    w = w.withColumn("sum_abs", sum(F.abs(F.coalesce(F.col(f"`diff_{a}`"), F.lit(0.0))) for a in areas))
    if group:
        gm = df.select(taxon, group).distinct()
        w = w.join(gm, taxon, "left")
        w = w.withColumn("rank_in_group", F.row_number().over(
            Window.partitionBy(group).orderBy(F.desc("sum_abs"), taxon)))
    return w


def select_taxa(df: DataFrame, label: str, patterns) -> DataFrame:
    """Rows whose label matches any of the patterns (regular expressions)."""
    cond = F.lit(False)
    for p in as_list(patterns):
        cond = cond | F.col(label).rlike(p)
    return df.where(cond)


def grid_mean(df: DataFrame, by, x: str, y: str, value: str, step_digits: int = 1) -> DataFrame:
    """Round coordinates (half to even) and average the value per cell."""
    return (df.withColumn(x, F.bround(x, step_digits)).withColumn(y, F.bround(y, step_digits))
            .groupBy(*as_list(by), x, y).agg(F.avg(value).alias(value)))


def rank_sum_test(df: DataFrame, by, group: str, x: str, g1, g2) -> DataFrame:
    """Wilcoxon rank-sum test of ``x`` between two groups per test key ``by``:
    W, tie-corrected z with continuity correction, two-sided normal p.

    Ties are collapsed first (value counts); the count of smaller values comes from a
    range-partitioned prefix sum, so a large test key is spread over many tasks.
    """
    by = as_list(by)
    d = df.where(F.col(group).isin(g1, g2)).where(F.col(x).isNotNull())
    c = d.groupBy(*by, x).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(group) == g1).alias("t1"))
    c = prefix_sum(c, by, [x], "t", "__below")
    c = c.withColumn("__rank", F.col("__below") + (F.col("t") + 1) / 2.0)
    s = c.groupBy(*by).agg(
        F.sum(F.col("t1")).alias("n1"), (F.sum("t") - F.sum("t1")).alias("n2"),
        F.sum(F.col("__rank") * F.col("t1")).alias("__r1"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("__ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    W = F.col("__r1") - n1 * (n1 + 1) / 2.0
    z0 = W - n1 * n2 / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("__ties") / (n * (n - 1))))
    corr = F.signum(z0) * 0.5
    z = F.try_divide(z0 - corr, sigma)  # all values tied: no spread, no z
    return s.select(*by, "n1", "n2", W.alias("W"), z.alias("z"),
                    (2 * pnorm_col(-F.abs(z))).alias("p"))  # the tail itself: 1 - pnorm would cancel to 0


def group_median(df: DataFrame, by, x: str, out: str = "median") -> DataFrame:
    """Exact median (linear interpolation) per group, by distributed selection."""
    return grouped_quantiles(df, by, x, {out: 0.5})


def condition_share(df: DataFrame, by, cond: Column, value: str | None = None) -> DataFrame:
    """Share of rows meeting ``cond`` per group and the mean ``value`` among them."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(cond).alias("n_cond")]
    if value:
        aggs.append(F.avg(F.when(cond, F.col(value))).alias(f"mean_{value}"))
    g = df.groupBy(*as_list(by)).agg(*aggs)
    return g.withColumn("share", F.col("n_cond") / F.col("n"))


def expand_cross(df1: DataFrame, df2: DataFrame, max_small_rows: int = 200_000) -> DataFrame:
    """Every combination of two tables (``crossing``). When the second table is a
    checked small dimension it is broadcast so the first is never shuffled; beyond the
    bound Spark's partitioned cartesian product is used."""
    if is_small(df2, max_small_rows):
        return df1.join(F.broadcast(df2), how="cross")
    return df1.join(df2, how="cross")


def _below_counts(xs: DataFrame, ys: DataFrame, keys) -> DataFrame:
    """For every x value ``u`` (``__n`` rows), the number of y values strictly below ``u``.

    One sort per key: y rows carry their counts, x rows sort before equal y values.
    """
    u = (xs.select(*keys, "u", F.lit(0).alias("__t"), F.lit(0).cast("bigint").alias("__c"), "__n")
         .unionByName(ys.select(*keys, F.col("v").alias("u"), F.lit(1).alias("__t"), F.col("c").alias("__c"), F.lit(0).cast("bigint").alias("__n"))))
    u = prefix_sum(u, keys, ["u", "__t"], "__c", "__below")
    return u.where(F.col("__t") == 0)


def hodges_lehmann(df: DataFrame, by, group: str, x: str, g1, g2, fan: int = 64,
                   band_rows: int = 50_000, max_rounds: int = 30) -> DataFrame:
    """Hodges-Lehmann shift, the median of all differences x_i - y_j, exactly and
    without forming all pairs.

    ``count(d) = #{x - y <= d}`` is a sort-based count (each x against the sorted y
    values, via range-partitioned prefix sums), evaluated at ``fan`` candidates per
    round; each round narrows the bracket (lo, hi] of the middle order statistics. When
    every bracket holds at most ``band_rows`` differences they are listed with a
    bucketed band join (each x meets only the y values in [x - hi, x - lo)) and the
    wanted order statistic is read off exactly. The bracket state is one small row per
    (test, target), checkpointed between rounds.
    """
    by = as_list(by)
    keys = by + ["target"]
    X = df.where(F.col(group) == g1).where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("x"))
    Y = df.where(F.col(group) == g2).where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("v"))
    # equal values count once on both sides: work follows the distinct values, not the rows
    X = X.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("__n")).checkpoint()
    Yc = Y.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c")).checkpoint()
    sx = X.groupBy(*by).agg(F.sum("__n").alias("n1"), F.min("x").alias("xmin"), F.max("x").alias("xmax"))
    sy = Yc.groupBy(*by).agg(F.sum("c").alias("n2"), F.min("v").alias("ymin"), F.max("v").alias("ymax"))
    s = sx.join(sy, by)
    n = F.col("n1") * F.col("n2")
    t = s.withColumn("target", F.explode(F.array(F.lit(1), F.lit(2))))
    t = t.withColumn("k", F.when(F.col("target") == 1, F.floor((n + 1) / 2)).otherwise(F.floor(n / 2) + 1))
    span = F.col("xmax") - F.col("ymin") - (F.col("xmin") - F.col("ymax"))
    state = t.select(*keys, "n2", "ymin", "k", (F.col("xmin") - F.col("ymax") - 1e-9 * (span + 1)).alias("lo"),
                     (F.col("xmax") - F.col("ymin")).alias("hi"), F.lit(0).cast("bigint").alias("clo"),
                     n.cast("bigint").alias("chi")).checkpoint()
    # a bracket is done when it holds few differences, or when it is so narrow that it
    # can only hold one (tied) value: the band join below meets each x with the distinct
    # y values of the band only, so a tied block costs one row per x
    scale = F.greatest(F.lit(1.0), F.abs(F.col("lo")), F.abs(F.col("hi")))
    open_ = (F.col("chi") - F.col("clo") > band_rows) & ((F.col("hi") - F.col("lo")) > 1e-9 * scale)
    for _ in range(max_rounds):
        if state.where(open_).limit(1).count() == 0:
            break
        cand = state.where(open_).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(fan))))
        cand = cand.withColumn("d", F.when(F.col("m") == fan, F.col("hi"))
                               .otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("m") / fan))
        xs = X.join(cand.select(*keys, "m", "d"), by).withColumn("u", F.col("x") - F.col("d"))
        ys = Yc.join(cand.select(*keys, "m"), by)
        b = _below_counts(xs, ys, keys + ["m"])
        cnt = b.join(cand.select(*keys, "m", "n2"), keys + ["m"]).groupBy(*keys, "m").agg(
            F.sum(F.col("__n") * (F.col("n2") - F.col("__below"))).cast("bigint").alias("cnt"))
        cnt = cnt.join(cand.select(*keys, "m", "d", "k"), keys + ["m"])
        hit = cnt.where(F.col("cnt") >= F.col("k")).groupBy(*keys).agg(F.min("m").alias("m"))
        new = hit.join(cnt.select(*keys, "m", F.col("d").alias("hi2"), F.col("cnt").alias("chi2")), keys + ["m"])
        prev = cnt.select(*keys, (F.col("m") + 1).alias("m"), F.col("d").alias("lo2"), F.col("cnt").alias("clo2"))
        new = new.join(prev, keys + ["m"], "left")
        state = (state.join(new.select(*keys, "hi2", "chi2", "lo2", "clo2"), keys, "left")
                 .withColumn("hi2", F.coalesce("hi2", "hi")).withColumn("chi2", F.coalesce("chi2", "chi"))
                 .withColumn("hi", F.col("hi2")).withColumn("chi", F.col("chi2"))
                 .withColumn("lo", F.coalesce("lo2", "lo")).withColumn("clo", F.coalesce("clo2", "clo"))
                 .drop("hi2", "chi2", "lo2", "clo2").checkpoint())
    # list the differences inside each bracket: y in [x - hi, x - lo), bucketed by width
    st = state.withColumn("w", F.col("hi") - F.col("lo"))
    xb = (X.join(st.select(*keys, "lo", "hi", "w", "ymin"), by)
          .withColumn("b0", F.floor((F.col("x") - F.col("hi") - F.col("ymin")) / F.col("w")))
          .withColumn("bucket", F.explode(F.array(F.col("b0") - 1, F.col("b0"), F.col("b0") + 1))))
    yb = (Yc.join(st.select(*keys, "w", "ymin"), by)
          .withColumn("bucket", F.floor((F.col("v") - F.col("ymin")) / F.col("w"))))
    band = (xb.join(yb.select(*keys, "bucket", "v", "c"), keys + ["bucket"])
            .withColumn("diff", F.col("x") - F.col("v"))
            .where((F.col("diff") > F.col("lo")) & (F.col("diff") <= F.col("hi"))))
    band = band.groupBy(*keys, "diff").agg(F.sum(F.col("__n") * F.col("c")).alias("c"))
    band = band.join(state.select(*keys, "k", "clo"), keys)
    w = Window.partitionBy(*keys).orderBy("diff").rowsBetween(Window.unboundedPreceding, 0)
    band = band.withColumn("cum", F.col("clo") + F.sum("c").over(w))
    kth = band.where(F.col("cum") >= F.col("k")).groupBy(*keys).agg(F.min("diff").alias("dk"))
    return kth.groupBy(*by).agg(F.avg("dk").alias("hl"))
