"""Dissimilarity between samples of a long (sample, feature, value) table.

Bray-Curtis ``1 - 2 S / (A + B)`` with ``S = sum_k min(x_k, y_k)`` and quantitative
Jaccard ``2 b / (1 + b)``. ``S`` only has terms for shared features.

* ``dissimilarity`` (all pairs) is a blocked computation: samples are numbered and cut into
  ``blocks``; a task receives the rows of one (block_i, block_j) pair for a share of the
  features, sorted by feature, and streams through them with the pair matrix in memory. It
  returns one sum per pair; the sums of the shares are added by Spark. Memory of a task does
  not depend on the rows or the features, and no per-feature pair rows go through the shuffle.
* ``within_group_distances`` (replicates of one bottle) is a Spark self-join on
  (group, feature): each key holds only the few replicates of one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ._util import prefix_sum

#: Entries (left row, right row of the same feature) that a block task holds at once.
PAIR_CHUNK = 2_000_000
#: Rows that a block task sums at once, and rows that a task reads in all.
FEATURE_ROWS = 200_000
PART_ROWS = 1_000_000
#: Samples up to which their names, codes and totals are broadcast (a few MB).
SMALL = 100_000


def _shared_sums(li, lv, l_codes, ri, rv, r_codes, shape, n_feats, chunk=PAIR_CHUNK) -> np.ndarray:
    """S[i, j]: sum over shared features of the smaller value. Left rows are taken in runs of
    at most ``chunk`` entries (one row at least), so memory does not grow with the features."""
    order = np.argsort(r_codes, kind="stable")
    r_codes, ri, rv = r_codes[order], ri[order], rv[order]
    count = np.bincount(r_codes, minlength=n_feats)
    start = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    reps = count[l_codes]
    ends = np.cumsum(reps)
    S = np.zeros(shape[0] * shape[1])
    lo = 0
    while lo < len(li):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + chunk, side="right")))
        r = reps[lo:hi]
        total = int(r.sum())
        if total:
            pos = np.repeat(start[l_codes[lo:hi]], r) + np.arange(total) - np.repeat(np.cumsum(r) - r, r)
            S += np.bincount(np.repeat(li[lo:hi], r) * shape[1] + ri[pos],
                             weights=np.minimum(np.repeat(lv[lo:hi], r), rv[pos]), minlength=len(S))
        lo = hi
    return S.reshape(shape)


def _pair_sums(size: int, n: int, rows: int = FEATURE_ROWS):
    """Shared sums of one task: a pair of blocks of ``size`` samples and a share of the features.
    Rows come sorted by feature; a run of ``rows`` rows (whole features) is summed at a time, so
    memory holds the pair matrix and that run."""
    def run(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bi, bj = int(key[0]), int(key[1])
        S = np.zeros([min(size, n - k * size) for k in (bi, bj)])

        def add(codes, marks, v):
            feats = np.concatenate([[0], np.cumsum(marks[1:] != marks[:-1])])
            left = codes // size == bi
            right = ~left if bi != bj else left
            S[:] += _shared_sums(codes[left] - bi * size, v[left], feats[left], codes[right] - bj * size, v[right],
                                 feats[right], S.shape, int(feats[-1]) + 1)

        held, count = [], 0
        for pdf in pdfs:
            held.append([pdf["i"].to_numpy(), pdf["f"].to_numpy(), pdf["v"].to_numpy()])
            count += len(pdf)
            if count >= rows:
                cols = [np.concatenate(c) for c in zip(*held)]
                other = np.flatnonzero(cols[1] != cols[1][-1])
                end = int(other[-1]) + 1 if len(other) else 0  # the last feature may go on
                if end:
                    add(*[c[:end] for c in cols])
                held, count = [[c[end:] for c in cols]], count - end
        if count:
            add(*[np.concatenate(c) for c in zip(*held)])
        if bi == bj:
            S = np.triu(S, 1)
        a, b = np.nonzero(S)
        for k in range(0, len(a), 100_000):
            i, j = a[k:k + 100_000], b[k:k + 100_000]
            yield pd.DataFrame({"ia": i + bi * size, "ib": j + bj * size, "S": S[i, j]})
    return run


def dissimilarity(df: DataFrame, sample: str = "sample", feature: str = "hash",
                  value: str = "value", blocks: int | None = None,
                  block_size: int = 2000, part_rows: int = PART_ROWS) -> DataFrame:
    """U4: Bray-Curtis and quantitative Jaccard for every pair of samples (a < b).

    Pairs sharing no feature get 1. ``blocks`` defaults to ceil(samples / block_size). Each
    pair of blocks is cut by a hash of the feature into tasks of about ``part_rows`` rows, which
    return sums over their own features. Null samples are no part of any pair; null features
    count in a sample's total and are shared with nothing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    x = df.select(F.col(sample).cast("string").alias("s"), F.col(feature).cast("string").alias("f"),
                  F.col(value).cast("double").alias("v")).where((F.col("v") > 0) & F.col("s").isNotNull())
    tot = x.groupBy("s").agg(F.sum("v").alias("t"), F.count(F.lit(1)).alias("__r"))
    tot = prefix_sum(tot.withColumn("__one", F.lit(1)), [], ["s"], "__one", "__p")
    tot = tot.select("s", "t", "__r", F.col("__p").cast("long").alias("i")).checkpoint()
    n, rows = tot.agg(F.count(F.lit(1)), F.coalesce(F.sum("__r"), F.lit(0))).first()
    size = max(1, math.ceil(n / blocks) if blocks is not None else block_size)
    blocks = max(1, math.ceil(n / size))
    own = tot.select("s", "i")
    x = x.where(F.col("f").isNotNull()).join(F.broadcast(own) if n <= SMALL else own, "s")
    x = x.select("i", "f", "v", F.floor(F.col("i") / size).cast("int").alias("_blk"))
    # each row goes to every block pair it belongs to: (min(b, j), max(b, j)) for all j
    x = x.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = max(1, math.ceil(rows * min(2, blocks) / blocks / part_rows))
    task = ["_bi", "_bj", "_p"]
    x = x.select("i", "f", "v", F.least("_blk", "_j").alias("_bi"), F.greatest("_blk", "_j").alias("_bj"),
                 F.pmod(F.xxhash64("f"), F.lit(parts)).cast("int").alias("_p"))
    x = x.repartition(blocks * (blocks + 1) // 2 * parts, *task).sortWithinPartitions(*task, "f")
    # rows of a feature are neighbours now: its hash only marks where the next one begins
    x = x.withColumn("f", F.xxhash64("f", F.lit(1)))
    shared = x.groupBy(*task).applyInPandas(_pair_sums(size, n), "ia long, ib long, S double")
    every = df.sparkSession.range(max(0, n - 1)).select(
        F.col("id").alias("ia"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("ib"), F.lit(0.0).alias("S"))
    S = shared.unionByName(every).groupBy("ia", "ib").agg(F.sum("S").alias("S"))
    name = lambda i, s, t: (lambda d: F.broadcast(d) if n <= SMALL else d)(tot.select(F.col("i").alias(i), F.col("s").alias(s), F.col("t").alias(t)))
    p = S.join(name("ia", "a", "ta"), "ia").join(name("ib", "b", "tb"), "ib")
    A = F.col("ta") + F.col("tb")
    p = p.withColumn("bray", F.when((A > 0) & ~F.isnan(A), 1.0 - 2.0 * F.col("S") / A).otherwise(F.lit(0.0)))
    br = F.col("bray")
    return p.select(F.col("a").alias(f"{sample}1"), F.col("b").alias(f"{sample}2"), "bray", (2 * br / (1 + br)).alias("jaccard"))


def within_group_distances(df: DataFrame, group: str, sample: str = "sample",
                           feature: str = "hash", value: str = "value") -> DataFrame:
    """Bray-Curtis between samples of the same group (e.g. replicates of a bottle).

    Self-join on (group, feature); every pair of the group appears once (a < b), pairs
    with no shared feature get 1.
    """
    x = df.select(group, sample, feature, F.col(value).cast("double").alias("v")).where(F.col("v") > 0)
    tot = x.groupBy(group, sample).agg(F.sum("v").alias("t"))
    l = x.select(group, feature, F.col(sample).alias("a"), F.col("v").alias("va"))
    r = x.select(group, feature, F.col(sample).alias("b"), F.col("v").alias("vb"))
    s = (l.join(r, [group, feature]).where(F.col("a") < F.col("b"))
         .groupBy(group, "a", "b").agg(F.sum(F.least("va", "vb")).alias("S")))
    ta = tot.select(group, F.col(sample).alias("a"), F.col("t").alias("ta"))
    tb = tot.select(group, F.col(sample).alias("b"), F.col("t").alias("tb"))
    pairs = ta.join(tb, group).where(F.col("a") < F.col("b"))
    pairs = pairs.join(s, [group, "a", "b"], "left")
    bray = 1.0 - 2.0 * F.coalesce(F.col("S"), F.lit(0.0)) / (F.col("ta") + F.col("tb"))
    return pairs.select(group, "a", "b", bray.alias("bray"))


def centroid_distance(pairs: DataFrame, members: DataFrame, group: str,
                      sample: str = "sample", d: str = "bray") -> DataFrame:
    """D22 closed form: distance of each member to its group centroid in the principal
    coordinate space of the distances.

    d(i, c)^2 = mean_j d_ij^2 - 0.5 * mean_jk d_jk^2 (j, k over all members, d_ii = 0);
    with two members this is d / 2. ``sqrt(abs(.))`` as betadisper does for
    non-Euclidean distances. Groups are small (replicates of one bottle).
    """
    both = (pairs.select(group, F.col("a").alias("i"), F.col(d).alias("_d"))
            .unionByName(pairs.select(group, F.col("b").alias("i"), F.col(d).alias("_d"))))
    row = both.groupBy(group, "i").agg(F.sum(F.col("_d") ** 2).alias("_r"))
    n = members.groupBy(group).agg(F.count_distinct(sample).alias("_n"))
    tot = pairs.groupBy(group).agg((2 * F.sum(F.col(d) ** 2)).alias("_t"))
    m = members.select(group, F.col(sample).alias("i")).distinct()
    r = (m.join(row, [group, "i"], "left").join(n, group).join(tot, group, "left")
         .fillna(0.0, subset=["_r", "_t"]))
    sq = F.col("_r") / F.col("_n") - 0.5 * F.col("_t") / (F.col("_n") * F.col("_n"))
    return r.select(group, F.col("i").alias(sample), F.sqrt(F.abs(sq)).alias("distance"))


def _spatial_median_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distances to the spatial median (Weiszfeld) in principal coordinates."""
    names = sorted(set(pdf["a"]).union(pdf["b"]))
    k = len(names)
    idx = {s: i for i, s in enumerate(names)}
    D = np.zeros((k, k))
    for a, b, v in zip(pdf["a"], pdf["b"], pdf["bray"]):
        D[idx[a], idx[b]] = D[idx[b], idx[a]] = v
    A = -0.5 * D ** 2
    J = np.eye(k) - np.ones((k, k)) / k
    G = J @ A @ J
    w, V = np.linalg.eigh(G)
    tol = 1e-10 * max(1.0, np.abs(w).max())
    pos, neg = w > tol, w < -tol
    Xp = V[:, pos] * np.sqrt(w[pos])
    Xn = V[:, neg] * np.sqrt(-w[neg])
    X = np.hstack([Xp, Xn])
    if not X.shape[1]:  # all members are alike
        return pd.DataFrame({"g": pdf["g"].iloc[0], "sample": names, "distance": 0.0})
    c = X.mean(axis=0)
    for _ in range(200):
        dist = np.sqrt(((X - c) ** 2).sum(axis=1))
        dist = np.where(dist < 1e-12, 1e-12, dist)
        nc = (X / dist[:, None]).sum(axis=0) / (1.0 / dist).sum()
        if np.abs(nc - c).max() < 1e-12:
            c = nc
            break
        c = nc
    npos = Xp.shape[1]
    dp = ((Xp - c[:npos]) ** 2).sum(axis=1)
    dn = ((Xn - c[npos:]) ** 2).sum(axis=1)
    return pd.DataFrame({"g": pdf["g"].iloc[0], "sample": names, "distance": np.sqrt(np.abs(dp - dn))})


def median_distance(pairs: DataFrame, group: str) -> DataFrame:
    """D22 ``center='median'``: betadisper's default spatial median, per group in pandas
    (groups are replicate sets of a bottle: a handful of rows each)."""
    p = pairs.select(F.col(group).alias("g"), "a", "b", "bray")
    out = p.groupBy("g").applyInPandas(_spatial_median_group, "g string, sample string, distance double")
    return out.withColumnRenamed("g", group)


def distance_classes(pairs: DataFrame, s1: str = "sample1", s2: str = "sample2",
                     value: str = "bray") -> DataFrame:
    """Label each pair PCR replicates / biological replicates / same site /
    different site (first match wins); both directions; self pairs removed."""
    both = (pairs.select(F.col(s1).alias("x"), F.col(s2).alias("y"), F.col(value).alias("value"))
            .unionByName(pairs.select(F.col(s2).alias("x"), F.col(s1).alias("y"), F.col(value).alias("value"))))
    b1 = F.substring_index("x", ".", 1)
    b2 = F.substring_index("y", ".", 1)
    d1 = F.expr("substring(substring_index(x, '.', 1), 1, length(substring_index(x, '.', 1)) - 1)")
    d2 = F.expr("substring(substring_index(y, '.', 1), 1, length(substring_index(y, '.', 1)) - 1)")
    site1 = F.substring_index(b1, "_", 1)
    site2 = F.substring_index(b2, "_", 1)
    cls = (F.when(b1 == b2, "PCR.replicates").when(d1 == d2, "Biol.replicates")
           .when(site1 == site2, "Same Site").otherwise("Different Site"))
    return both.where(F.col("x") != F.col("y")).select(
        F.col("x").alias(s1), F.col("y").alias(s2), "value", cls.alias("distance_type"))
