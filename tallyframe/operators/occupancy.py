"""Occupancy: detection histories, presence patterns and a grid posterior.

The reference fits a Bayesian site-occupancy model once per distinct detection
pattern (an MCMC sampler). Here the posterior is integrated on a grid of (psi, p11,
p10) that is laid again, several times, on the box that holds the pattern's mass;
posterior medians are read off the last grid's marginals. Work is per distinct pattern,
spread over the tasks, then joined back to every hash with that pattern.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import as_list


def detection_histories(df: DataFrame, sample: str = "sample", hash: str = "hash",
                        reps=("1", "2", "3"), n: str = "n_reads") -> DataFrame:
    """Per (site, bottle, hash) a 0/1 detection per technical replicate and their
    sum. Only (bottle, hash) pairs with a detection are stored; all-zero rows are
    implied (counted in D13 from the bottle list)."""
    x = (df.where(F.col(n) > 0)
         .select(F.substring_index(sample, "_", 1).alias("site"),
                 F.substring_index(sample, ".", 1).alias("bottle"),
                 F.regexp_extract(sample, r"\.(.*)$", 1).alias("rep"), hash).distinct())
    g = x.groupBy("site", "bottle", hash).agg(
        *[F.max(F.when(F.col("rep") == r, 1).otherwise(0)).alias(f"rep_{r}") for r in reps])
    return g.withColumn("detections", sum(F.col(f"rep_{r}") for r in reps))


def presence_pattern(hist: DataFrame, bottles: DataFrame, K: int = 3, by_site: bool = True,
                     hash: str = "hash") -> DataFrame:
    """Bottles with 0..K detections per hash (per site), as ``n0.n1...nK``.

    ``bottles`` lists every (site, bottle) sampled; zero-detection bottles are the
    bottles of the site minus those where the hash was detected.
    """
    keys = ["site", hash] if by_site else [hash]
    nb = bottles.select("site", "bottle").distinct()
    g = hist.groupBy(*keys).agg(*[F.count_if(F.col("detections") == y).alias(f"n{y}") for y in range(1, K + 1)])
    if by_site:
        g = g.join(nb.groupBy("site").agg(F.count(F.lit(1)).alias("__nb")), "site")
    else:
        g = g.withColumn("__nb", nb.select(F.count(F.lit(1))).scalar())
    g = g.withColumn("n0", F.col("__nb") - sum(F.col(f"n{y}") for y in range(1, K + 1))).drop("__nb")
    g = g.withColumn("pattern", F.concat_ws(".", *[F.col(f"n{y}").cast("string") for y in range(0, K + 1)]))
    return g.select(*keys, *[f"n{y}" for y in range(0, K + 1)], "pattern")


def pattern_representatives(patterns: DataFrame, hash: str = "hash") -> DataFrame:
    """One (smallest) hash per distinct pattern, with its site where patterns have one."""
    cols = [c for c in patterns.columns if c.startswith("n") and c[1:].isdigit()]
    which = [hash, "site"] if "site" in patterns.columns else [hash]
    b = F.min(F.struct(*which))
    return (patterns.groupBy("pattern", *cols).agg(b.alias("__b"))
            .select("pattern", *cols, *[F.col("__b")[c].alias(c) for c in which]))


#: Mass that each end of a parameter may leave outside the next grid's box.
TAIL = 1e-5


def _posterior_medians(n: np.ndarray, grid: int, p10_beta: float, p11_min: float, rounds: int) -> np.ndarray:
    """Medians (psi, p11, p10) of each row of pattern counts ``n`` (n0..nK)."""
    rows, K = len(n), n.shape[1] - 1
    lo = np.tile([0.0, p11_min, 0.0], (rows, 1))
    hi = np.ones((rows, 3))
    least, most = lo.copy(), hi.copy()
    mid = np.arange(grid) + 0.5
    for r in range(rounds):
        step = (hi - lo) / grid
        psi, p11, p10 = ((lo[:, k, None] + mid * step[:, k, None]).reshape(rows, *shape)
                         for k, shape in enumerate([(grid, 1, 1), (1, grid, 1), (1, 1, grid)]))
        lp = (p10_beta - 1) * np.log(1 - p10)
        for y in range(K + 1):
            lp = lp + n[:, y, None, None, None] * np.log(
                psi * p11**y * (1 - p11)**(K - y) + (1 - psi) * p10**y * (1 - p10)**(K - y))
        w = np.exp(lp - lp.max(axis=(1, 2, 3), keepdims=True))
        w /= w.sum(axis=(1, 2, 3), keepdims=True)
        m = np.stack([w.sum(axis=(2, 3)), w.sum(axis=(1, 3)), w.sum(axis=(1, 2))], 1)
        c = m.cumsum(axis=2)
        if r == rounds - 1:
            cell = (c < 0.5).sum(axis=2).clip(max=grid - 1)
            at = lambda x: np.take_along_axis(x, cell[:, :, None], 2)[:, :, 0]
            return lo + (cell + 1 - (at(c) - 0.5) / at(m)) * step
        # from the cell where the lower tail ends to the one where the upper begins, and one more
        first, last = (c <= TAIL).sum(axis=2), (c < 1 - TAIL).sum(axis=2)
        lo, hi = np.maximum(least, lo + (first - 1) * step), np.minimum(most, lo + (last + 2) * step)


def occupancy_fit(patterns: DataFrame, K: int = 3, grid: int = 20, p10_beta: float = 50.0,
                  p11_min: float = 0.01, rounds: int = 4) -> DataFrame:
    """Posterior medians of psi, p11, p10 for each distinct pattern.

    Priors psi ~ U(0,1), p11 ~ U(p11_min, 1), p10 ~ Beta(1, p10_beta). Each of ``rounds``
    grids has ``grid`` cells a parameter; the first covers the priors, each next one the
    cells that hold all but ``TAIL`` of a parameter's mass at either end (and a cell more).
    Medians lie where the last grid's marginal, even inside a cell, reaches one half.
    Output (pattern, psi, p11, p10).
    """
    ncols = [f"n{y}" for y in range(K + 1)]
    tasks = int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = patterns.select("pattern", *[F.col(c).cast("double") for c in ncols]).distinct().repartition(tasks, "pattern")
    some = max(1, 2**18 // grid**3)  # patterns at once, so that a task holds a few MB

    def fit(batches):
        for pdf in batches:
            n = pdf[ncols].to_numpy()
            med = [_posterior_medians(n[i:i + some], grid, p10_beta, p11_min, rounds) for i in range(0, len(n), some)]
            med = np.concatenate(med) if med else np.zeros((0, 3))
            yield pd.DataFrame({"pattern": pdf["pattern"], "psi": med[:, 0], "p11": med[:, 1], "p10": med[:, 2]})
    return p.mapInPandas(fit, "pattern string, psi double, p11 double, p10 double")


def prob_occupancy(x, psi, p11, p10, K: int = 3) -> Column:
    """Probability a site is occupied given ``x`` detections out of K."""
    def c(v):
        return F.col(v) if isinstance(v, str) else v
    x, psi, p11, p10 = c(x), c(psi), c(p11), c(p10)
    a = psi * F.pow(p11, x) * F.pow(1 - p11, K - x)
    b = (1 - psi) * F.pow(p10, x) * F.pow(1 - p10, K - x)
    return a / (a + b)


def max_detections(K: int = 3) -> Column:
    """Largest y with a non-zero count in ``n0..nK``."""
    e = None
    for y in range(K, -1, -1):
        e = F.when(F.col(f"n{y}") > 0, F.lit(y)) if e is None else e.when(F.col(f"n{y}") > 0, F.lit(y))
    return e.otherwise(F.lit(0))


def attempt_summary(df: DataFrame, cols, prefix: str = "") -> DataFrame:
    """Row-wise mean, median and max over repeated fits stored in columns."""
    arr = F.array(*[F.col(c) for c in as_list(cols)])
    n = len(as_list(cols))
    s = F.array_sort(arr)
    med = (s[(n - 1) // 2] + s[n // 2]) / 2.0
    return df.withColumns({f"{prefix}mean": F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / n,
                           f"{prefix}median": med, f"{prefix}max": F.array_max(arr)})


def broadcast_pattern_result(fit: DataFrame, patterns: DataFrame, value: str, hash: str = "hash",
                             out: str = "max") -> DataFrame:
    """Each hash takes its pattern's result; the maximum over its sites is kept."""
    return (patterns.select(hash, "pattern").join(fit.select("pattern", value), "pattern")
            .groupBy(hash).agg(F.max(value).alias(out)))
