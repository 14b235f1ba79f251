"""Community statistics: PERMANOVA from pair distances, clustering, profiles,
top-k reports, richness, boxplot/histogram tables and shared taxa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import as_list, prefix_sum, with_group_agg
from .quantiles import pick_quantiles, value_counts


# ---- PERMANOVA ------------------------------------------------------------------------

def _ss_within(pairs: DataFrame, labels: DataFrame, keys, d: str) -> DataFrame:
    """Sum over groups of (sum of d^2 within the group) / group size, per ``keys``."""
    la = labels.select(*keys, F.col("s").alias("a"), F.col("g").alias("ga"))
    lb = labels.select(*keys, F.col("s").alias("b"), F.col("g").alias("gb"))
    size = labels.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("n_g"))
    on_a = [k for k in keys if k in pairs.columns] + ["a"]
    p = pairs.join(la, on_a).join(lb, keys + ["b"]).where(F.col("ga") == F.col("gb"))
    s = p.groupBy(*keys, F.col("ga").alias("g")).agg(F.sum(F.col(d) * F.col(d)).alias("ss"))
    s = s.join(size, keys + ["g"])
    return s.groupBy(*keys).agg(F.sum(F.col("ss") / F.col("n_g")).alias("ss_within"))


def permanova(pairs: DataFrame, groups: DataFrame, sample: str = "sample", group: str = "group",
              a: str = "sample1", b: str = "sample2", d: str = "bray") -> DataFrame:
    """Pseudo-F and R2 of a one-way PERMANOVA from a pair table (a < b).

    SS_total = sum d^2 / N, SS_within = sum_g (sum of within-g d^2) / n_g.
    """
    lab = groups.select(F.col(sample).alias("s"), F.col(group).alias("g")).distinct()
    pr = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(d).alias("d"))
    pr = pr.join(lab.select(F.col("s").alias("a")), "a", "left_semi").join(lab.select(F.col("s").alias("b")), "b", "left_semi")
    lab = lab.withColumn("_k", F.lit(0))
    pr = pr.withColumn("_k", F.lit(0))
    ssw = _ss_within(pr, lab, ["_k"], "d")
    stats = lab.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("n_groups"))
    sst = pr.groupBy("_k").agg(F.sum(F.col("d") * F.col("d")).alias("_sd2"))
    r = stats.join(sst, "_k").join(ssw, "_k")
    r = r.withColumn("ss_total", F.col("_sd2") / F.col("n"))
    r = r.withColumn("ss_between", F.col("ss_total") - F.col("ss_within"))
    f = F.try_divide(F.col("ss_between") / (F.col("n_groups") - 1), F.col("ss_within") / (F.col("n") - F.col("n_groups")))
    return r.select("n", "n_groups", "ss_total", "ss_within", "ss_between", f.alias("F"),
                    (F.col("ss_between") / F.col("ss_total")).alias("R2"))


def permuted_labels(groups: DataFrame, nperm: int, seed: int = 1, sample: str = "s",
                    group: str = "g", within: str | None = None) -> DataFrame:
    """Seeded permutations of group labels: (perm, [within,] s, g). Position i in the
    order of permutation k (by md5 of ``sample|k|seed``, the same in every engine) takes the
    label of position i in sample order; ``within`` restricts the shuffling to strata. One
    row per sample and permutation."""
    w = [within] if within else []
    lab = groups.select(*w, sample, group)
    # sample-order position 1..n per stratum from a range-partitioned prefix count
    orig = prefix_sum(lab.withColumn("_one", F.lit(1)), w, [sample], "_one", "_p")
    orig = orig.withColumn("_pos", (F.col("_p") + 1).cast("int")).drop("_one", "_p")
    p = lab.select(*w, sample).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(nperm))))
    mark = F.md5(F.concat_ws("|", F.col(sample).cast("string"), F.col("perm").cast("string"), F.lit(str(seed))).cast("binary"))
    p = p.withColumn("_pos", F.row_number().over(Window.partitionBy("perm", *w).orderBy(mark, sample)))
    return p.join(orig.select(*w, "_pos", group), w + ["_pos"]).select("perm", *w, sample, group)


#: Permutations whose labels stand in one array, and samples of a block.
PERM_BLOCK, SAMPLE_BLOCK = 4096, 256


def _label_arrays(perm: DataFrame, value: Column, *within: str) -> DataFrame:
    """([within,] chunk, s, v): ``value`` of a sample in up to PERM_BLOCK permutations, in their order."""
    chunk = F.floor((F.col("perm") - 1) / PERM_BLOCK).cast("int")
    rows = F.array_sort(F.collect_list(F.struct("perm", value.alias("v"))))
    return perm.groupBy(*within, chunk.alias("chunk"), "s").agg(F.transform(rows, lambda x: x["v"]).alias("v"))


def _block_of(s: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(s), F.lit(blocks)).cast("int")


def _to_block_pairs(df: DataFrame, s: str, blocks: int) -> DataFrame:
    """Rows of samples, once for every pair of blocks (bi <= bj) that the sample's block is in."""
    d = df.withColumn("_b", _block_of(F.col(s), blocks)).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return d.withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o")).drop("_b", "_o")


def _chunks(nperm: int) -> Column:
    """One row for every PERM_BLOCK permutations."""
    return F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-nperm // PERM_BLOCK) - 1)))).alias("chunk")


def _with_labels(pairs: DataFrame, labels: DataFrame, n: int, nperm: int, run, schema: str) -> DataFrame:
    """``run(distances, labels)`` for every pair of blocks of samples and chunk of permutations:
    squared distances as a matrix between the samples of both blocks (each pair once), labels as
    the list array of those samples. A pair row never carries labels: those of a sample go to the
    tasks of its block, once for each other block."""
    import math
    blocks = max(1, math.ceil(n / SAMPLE_BLOCK))
    d = pairs.select(F.col("a"), F.col("b"), (F.col("d") * F.col("d")).cast("double").alias("d2"))
    x, y = _block_of(F.col("a"), blocks), _block_of(F.col("b"), blocks)
    d = d.withColumn("bi", F.least(x, y)).withColumn("bj", F.greatest(x, y)).select("*", _chunks(nperm))
    lab = _to_block_pairs(labels, "s", blocks)
    keys = ["bi", "bj", "chunk"]

    def task(left, right):
        import numpy as np
        import pandas as pd
        names = pd.Index(right.column("s").to_pylist())
        i, j = names.get_indexer(left.column("a").to_pylist()), names.get_indexer(left.column("b").to_pylist())
        known = (i >= 0) & (j >= 0)
        m = np.zeros((len(names), len(names)))
        m[i[known], j[known]] = left.column("d2").to_numpy()[known]
        first = right.column("chunk")[0].as_py() * PERM_BLOCK + 1 if len(names) else 1
        return run(m, right.column("v").combine_chunks(), first)
    return d.groupBy(*keys).cogroup(lab.groupBy(*keys)).applyInArrow(task, schema)


def _within_sums(m, labels, first):
    """Sums of squared distances within each group, for every permutation of the labels."""
    import numpy as np
    import pyarrow as pa
    if not len(labels) or not m.any():
        return pa.table({"perm": pa.array([], pa.int32()), "code": pa.array([], pa.int64()), "ss": pa.array([], pa.float64())})
    v = labels.flatten().to_numpy().reshape(len(labels), -1)
    perm, code, ss = [], [], []
    for g in np.unique(v):
        own = (v == g).astype(np.float64)
        s = ((m @ own) * own).sum(axis=0)
        perm.append(first + np.arange(len(s))), code.append(np.full(len(s), g)), ss.append(s)
    return pa.table({"perm": pa.array(np.concatenate(perm).astype(np.int32)), "code": pa.array(np.concatenate(code)), "ss": pa.array(np.concatenate(ss))})


def _ss_within_permuted(pairs: DataFrame, lab: DataFrame, nperm: int, seed: int) -> DataFrame:
    """``_ss_within`` of every permutation of ``lab``: (perm, ss_within). Group sizes do not
    change by permuting."""
    code = F.xxhash64("g")
    arrays = _label_arrays(permuted_labels(lab, nperm, seed), code)
    sums = _with_labels(pairs, arrays, lab.count(), nperm, _within_sums, "perm int, code bigint, ss double")
    size = lab.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n_g"))
    s = sums.groupBy("perm", "code").agg(F.sum("ss").alias("ss")).join(size, "code")
    return s.groupBy("perm").agg(F.sum(F.col("ss") / F.col("n_g")).alias("ss_within"))


def permanova_test(pairs: DataFrame, groups: DataFrame, nperm: int = 199, seed: int = 1,
                   sample: str = "sample", group: str = "group", a: str = "sample1",
                   b: str = "sample2", d: str = "bray") -> DataFrame:
    """U9 p-value: share of label permutations with F at least the observed one."""
    obs = permanova(pairs, groups, sample, group, a, b, d)
    lab = groups.select(F.col(sample).alias("s"), F.col(group).alias("g")).distinct()
    pr = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(d).alias("d"))
    ssw = _ss_within_permuted(pr, lab, nperm, seed)
    o = obs.select("n", "n_groups", "ss_total", F.col("F").alias("F_obs"), "R2")
    f = ((F.col("ss_total") - F.col("ss_within")) / (F.col("n_groups") - 1)) / \
        (F.col("ss_within") / (F.col("n") - F.col("n_groups")))
    # the observed statistics are one row: attach them on a constant key (broadcast)
    j = ssw.withColumn("__k", F.lit(0)).join(F.broadcast(o.withColumn("__k", F.lit(0))), "__k")
    j = j.withColumn("F_perm", f)
    return j.groupBy("F_obs", "R2").agg(
        ((F.count_if(F.col("F_perm") >= F.col("F_obs") - 1e-12) + 1) / (nperm + 1)).alias("p"),
        F.count(F.lit(1)).alias("nperm"))


# ---- clustering (MLlib) -------------------------------------------------------------

def _vectors(df: DataFrame, cols) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.feature import VectorAssembler
    cols = as_list(cols)
    if len(cols) == 1 and str(df.schema[cols[0]].dataType).startswith("ArrayType"):
        return df.withColumn("features", array_to_vector(F.col(cols[0]).cast("array<double>")))
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def kmeans_clusters(df: DataFrame, cols, k: int, restarts: int = 5, seed: int = 1, id_col: str | None = None):
    """K-means (MLlib, k-means||) with several seeds; the run with the lowest
    within-cluster cost wins. Returns (assignments, cost)."""
    from pyspark.ml.clustering import KMeans
    x = _vectors(df, cols)
    best = None
    for r in range(restarts):
        m = KMeans(k=k, seed=seed + r, featuresCol="features", predictionCol="cluster", maxIter=50).fit(x)
        cost = m.summary.trainingCost
        if best is None or cost < best[1]:
            best = (m, cost)
    out = best[0].transform(x).drop("features")
    return out, best[1]


def cluster_count_scores(df: DataFrame, cols, ks=(1, 2, 3, 4, 5), seed: int = 1, n_ref: int = 3) -> DataFrame:
    """Within-cluster sum of squares, silhouette and gap statistic per k.

    Gap reference sets are uniform over each feature's range, generated per row with
    a hash-based uniform, so they have the data's size and partitioning.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import vector_to_array
    from .scenario import hash_uniform
    x = _vectors(df, cols).select("features").withColumn("__id", F.monotonically_increasing_id())
    arr = x.select("__id", vector_to_array("features").alias("v"))
    dim = len(arr.first()["v"])
    mins = arr.select(*[F.min(F.col("v")[i]) for i in range(dim)]).first()
    maxs = arr.select(*[F.max(F.col("v")[i]) for i in range(dim)]).first()
    import math
    rows = []
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    from pyspark.ml.functions import array_to_vector

    def cost(vecs, k):
        if k == 1:  # one cluster: squared distance to the mean, as aggregates
            a = vecs.select(vector_to_array("features").alias("v"))
            means = a.select(*[F.avg(F.col("v")[i]) for i in range(dim)]).first()
            return a.select(F.sum(sum((F.col("v")[i] - float(means[i])) ** 2 for i in range(dim)))).first()[0]
        return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vecs).summary.trainingCost

    for k in ks:
        w = cost(x, k)
        sil = None
        if k > 1:
            m = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(x)
            sil = ev.evaluate(m.transform(x))
        refs = []
        for b in range(n_ref):
            ref = arr.select(array_to_vector(F.array(*[
                F.lit(mins[i]) + (maxs[i] - mins[i]) * hash_uniform(F.col("__id"), F.lit(b), F.lit(i), F.lit(seed))
                for i in range(dim)])).alias("features"))
            refs.append(cost(ref, k))
        gap = sum(math.log(r) for r in refs) / len(refs) - math.log(w) if w > 0 else None
        rows.append((k, float(w), sil, gap))
    return df.sparkSession.createDataFrame(rows, "k int, wss double, silhouette double, gap double")


def cluster_profile(env: DataFrame, clusters: DataFrame, keys, cols, by=("area", "cluster"),
                    digits: int = 2) -> DataFrame:
    """Join clusters to the environment and profile each cluster (means rounded
    half to even)."""
    j = env.join(clusters, as_list(keys))
    return j.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("n"),
                                       *[F.bround(F.avg(c), digits).alias(c) for c in as_list(cols)])


# ---- reports -------------------------------------------------------------------------

def canonical_pair(a, b, sep: str = "_") -> Column:
    """Order-independent label of a pair."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.concat(F.least(a, b), F.lit(sep), F.greatest(a, b))


def top_k_signed(df: DataFrame, by, value: str, positive: Column, k: int = 5, tie=None) -> DataFrame:
    """Top ``k`` rows by ``value`` per group and direction, with the value signed
    by direction (a top-k report: the limit is the feature)."""
    d = df.withColumn("direction", positive)
    order = F.col(value)
    if d.schema[value].dataType.simpleString() in ("double", "float"):
        order = F.round(order * 1e12)  # equal values may differ in their last bits
    w = Window.partitionBy(*as_list(by), "direction").orderBy(F.desc(order), *as_list(tie))
    r = d.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")
    return r.withColumn("signed", F.when(F.col("direction"), F.col(value)).otherwise(-F.col(value)))


def richness(df: DataFrame, event: str, group: str, taxon: str) -> DataFrame:
    """Distinct taxa per event and group, and the event total."""
    g = df.groupBy(event, group).agg(F.count_distinct(taxon).alias("richness"))
    return with_group_agg(g, event, total=F.sum("richness"))


def env_long(env: DataFrame, keys, predictors, date: str = "date", valid: Column | None = None) -> DataFrame:
    """Distinct valid environment rows, one row per predictor, with the month."""
    e = env.select(*as_list(keys), *as_list(predictors)).distinct()
    if valid is not None:
        e = e.where(valid)
    e = e.withColumn("month", F.date_format(date, "MMM"))
    return e.unpivot([*as_list(keys), "month"], as_list(predictors), "variable", "value")


def box_stats(df: DataFrame, by, x: str) -> DataFrame:
    """The numbers behind a boxplot: quartiles (linear interpolation), whiskers at
    the most extreme values within 1.5 IQR, and the outlier count, all from value counts that
    are spread over tasks by value (``quantiles``)."""
    by = as_list(by)
    c = value_counts(df, by, x)
    q = pick_quantiles(c, x, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    w = c.join(q, "key").groupBy("key", "q1", "median", "q3").agg(
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.min(F.when(F.col(x) >= lo, F.col(x))).alias("whisker_lo"), F.max(F.when(F.col(x) <= hi, F.col(x))).alias("whisker_hi"),
        F.sum(F.when((F.col(x) < lo) | (F.col(x) > hi), F.col("c")).otherwise(0)).alias("n_outliers"))
    groups = df.select(*by).distinct().withColumn("key", F.to_json(F.struct(*by)) if by else F.lit(""))
    return groups.join(w, "key", "left").select(*by, "min", "q1", "median", "q3", "max", "whisker_lo", "whisker_hi",
                                                F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"))


def histogram(df: DataFrame, x: str, width: float, by=None, origin: float = 0.0) -> DataFrame:
    """Fixed-width bins: count and density scaled to the group's tallest bin."""
    by = as_list(by)
    b = F.floor((F.col(x) - origin) / width).cast("bigint")
    g = df.where(F.col(x).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    g = g.withColumn("lo", origin + F.col("bin") * width)
    if by:
        g = with_group_agg(g, by, __mx=F.max("count"))
    else:
        g = g.withColumn("__mx", g.select(F.max("count")).scalar())
    return g.withColumn("ndensity", F.col("count") / F.col("__mx")).drop("__mx")


def shared_taxa(df: DataFrame, taxon: str, site: str, area: str) -> DataFrame:
    """Per taxon the number of sites and areas it occurs in, and whether it is in
    every area or in one only."""
    n_areas = df.select(F.count_distinct(area)).scalar()
    g = df.groupBy(taxon).agg(F.count_distinct(site).alias("n_sites"), F.count_distinct(area).alias("n_areas"))
    return g.withColumn("in_all_areas", F.col("n_areas") == n_areas).withColumn("in_one_area", F.col("n_areas") == 1)


# ---- constrained ordination (distance-based RDA) ------------------------------------

def constraint_moments(pairs: DataFrame, env: DataFrame, terms, sample: str = "sample",
                       a: str = "sample1", b: str = "sample2", d: str = "bray") -> DataFrame:
    """U10 building block: with Z the standardised, centred constraints, the p x p
    matrices M = Z' G Z (G the Gower-centred distance matrix) and C = Z'Z, as rows
    (term_a, term_b, m, c), plus the total inertia on the diagonal rows.

    With centred Z, M_ab = -0.5 * sum_{i<j} d_ij^2 (z_ia z_jb + z_ja z_ib): one
    aggregate over the pair table joined to Z at both ends.
    """
    from .scenario import standardize_by
    terms = as_list(terms)
    z = env.select(F.col(sample).alias("s"), *terms).na.drop()
    z = standardize_by(z, terms, suffix="")
    pr = pairs.select(F.col(a).alias("s1"), F.col(b).alias("s2"), F.col(d).alias("d"))
    za = z.select(F.col("s").alias("s1"), *[F.col(t).alias(f"a_{t}") for t in terms])
    zb = z.select(F.col("s").alias("s2"), *[F.col(t).alias(f"b_{t}") for t in terms])
    j = pr.join(za, "s1").join(zb, "s2")
    d2 = F.col("d") * F.col("d")
    aggs = [F.sum(d2).alias("__sd2")]
    for t1 in terms:
        for t2 in terms:
            aggs.append(F.sum(-0.5 * d2 * (F.col(f"a_{t1}") * F.col(f"b_{t2}") + F.col(f"a_{t2}") * F.col(f"b_{t1}")))
                        .alias(f"m__{t1}__{t2}"))
    m = j.agg(*aggs)
    caggs = [F.count(F.lit(1)).alias("__n")]
    caggs += [F.sum(F.col(t1) * F.col(t2)).alias(f"c__{t1}__{t2}") for t1 in terms for t2 in terms]
    c = z.agg(*caggs)
    rows = F.array(*[F.struct(F.lit(t1).alias("term_a"), F.lit(t2).alias("term_b"),
                              F.col(f"m__{t1}__{t2}").alias("m"), F.col(f"c__{t1}__{t2}").alias("c"))
                     for t1 in terms for t2 in terms])
    out = m.withColumn("__k", F.lit(0)).join(c.withColumn("__k", F.lit(0)), "__k")
    return out.select((F.col("__sd2") / F.col("__n")).alias("total_inertia"), F.col("__n").alias("n"),
                      F.explode(rows).alias("r")).select("r.*", "total_inertia", "n")


def constrained_ordination(pairs: DataFrame, env: DataFrame, terms, sample: str = "sample",
                           a: str = "sample1", b: str = "sample2", d: str = "bray"):
    """Distance-based redundancy analysis (capscale-style).

    The p x p moments come from Spark aggregates; the eigenproblem of
    C^-1/2 M C^-1/2 (p x p, p = number of constraints) is solved on the driver; site
    scores are a linear combination of each sample's standardised constraints.
    Returns (eigen, site_scores, biplot) DataFrames.
    """
    import numpy as np
    from .scenario import standardize_by
    terms = as_list(terms)
    mom = constraint_moments(pairs, env, terms, sample, a, b, d).collect()  # p*p rows
    p = len(terms)
    idx = {t: i for i, t in enumerate(terms)}
    M = np.zeros((p, p))
    Cm = np.zeros((p, p))
    for r in mom:
        M[idx[r["term_a"]], idx[r["term_b"]]] = r["m"]
        Cm[idx[r["term_a"]], idx[r["term_b"]]] = r["c"]
    total = mom[0]["total_inertia"]
    w, V = np.linalg.eigh(Cm)
    c_isqrt = V @ np.diag(1 / np.sqrt(w)) @ V.T
    lam, vec = np.linalg.eigh(c_isqrt @ M @ c_isqrt)
    order = np.argsort(lam)[::-1]
    lam, vec = lam[order], vec[:, order]
    W = c_isqrt @ vec
    spark = pairs.sparkSession
    axes = [f"CAP{k + 1}" for k in range(p)]
    eigen = spark.createDataFrame([(axes[k], float(lam[k]), float(lam[k] / total)) for k in range(p)],
                                  "axis string, eigenvalue double, proportion double")
    z = standardize_by(env.select(F.col(sample), *terms).na.drop(), terms, suffix="")
    scores = z.select(sample, *[sum(F.col(t) * float(W[idx[t], k]) for t in terms).alias(axes[k]) * float(np.sqrt(max(lam[k], 0)))
                                for k in range(p)])
    cw = Cm @ W
    biplot = spark.createDataFrame([(t, *[float(cw[idx[t], k] / np.sqrt(Cm[idx[t], idx[t]])) for k in range(p)])
                                    for t in terms], "term string, " + ", ".join(f"{x} double" for x in axes))
    return eigen, scores, biplot


def ordination_test(pairs: DataFrame, env: DataFrame, terms, nperm: int = 199, seed: int = 1,
                    sample: str = "sample", a: str = "sample1", b: str = "sample2", d: str = "bray") -> DataFrame:
    """Permutation test of the constrained ordination.

    F = (constrained / p) / ((total - constrained) / (n - p - 1)) with
    constrained = trace(C^-1 M). Permuting the constraint rows leaves C unchanged, so
    each permutation only needs sum over pairs of -d^2 * z_i' C^-1 z_j: a product of a block
    of distances with the permuted constraints of its samples.
    """
    import numpy as np
    from .scenario import standardize_by
    terms = as_list(terms)
    p = len(terms)
    mom = constraint_moments(pairs, env, terms, sample, a, b, d).collect()
    idx = {t: i for i, t in enumerate(terms)}
    M = np.zeros((p, p))
    Cm = np.zeros((p, p))
    for r in mom:
        M[idx[r["term_a"]], idx[r["term_b"]]] = r["m"]
        Cm[idx[r["term_a"]], idx[r["term_b"]]] = r["c"]
    n, total = mom[0]["n"], mom[0]["total_inertia"]
    Ci = np.linalg.inv(Cm)
    obs = float(np.trace(Ci @ M))
    f_obs = (obs / p) / ((total - obs) / (n - p - 1))
    z = standardize_by(env.select(F.col(sample).alias("s"), *terms).na.drop(), terms, suffix="")
    lab = z.select("s", F.array(*terms).alias("g"))
    # a sample's array: the constraints of the first permutation, of the second, ...
    arrays = _label_arrays(permuted_labels(lab, nperm, seed), F.col("g")).withColumn("v", F.flatten("v"))
    pr = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(d).alias("d"))

    def sums(m, labels, first):
        import pyarrow as pa
        v = labels.flatten().to_numpy().reshape(len(labels), -1)
        con = -((v.reshape(len(v), -1, p) @ Ci).reshape(v.shape) * (m @ v)).sum(axis=0).reshape(-1, p).sum(axis=1)
        return pa.table({"perm": pa.array((first + np.arange(len(con))).astype(np.int32)), "con": pa.array(con, pa.float64())})
    con = _with_labels(pr, arrays, n, nperm, sums, "perm int, con double").groupBy("perm").agg(F.sum("con").alias("con"))
    fp = (F.col("con") / p) / ((F.lit(total) - F.col("con")) / (n - p - 1))
    res = con.agg(((F.count_if(fp >= f_obs - 1e-12) + 1) / (nperm + 1)).alias("p"), F.count(F.lit(1)).alias("nperm"))
    return res.select(F.lit(f_obs).alias("F"), F.lit(obs).alias("constrained"), F.lit(total).alias("total"), "p", "nperm")


# ---- SIMPER -----------------------------------------------------------------------------

SIMPER_PARTS = "by string, ga string, gb string, taxon string, s1 double, s2 double"


def _simper_block(pdf):
    import numpy as np
    import pandas as pd
    by, ga, gb = pdf["by"].iloc[0], pdf["ga"].iloc[0], pdf["gb"].iloc[0]
    A = pdf[pdf["side"] == 0]
    B = pdf[pdf["side"] == 1]
    sa, sb = np.sort(A["s"].unique()), np.sort(B["s"].unique())
    if len(sa) == 0 or len(sb) == 0:
        return pd.DataFrame(columns=["by", "ga", "gb", "taxon", "s1", "s2"])
    ia, ib = pd.Index(sa).get_indexer(A["s"]), pd.Index(sb).get_indexer(B["s"])
    va, vb = A["v"].to_numpy(float), B["v"].to_numpy(float)
    ta = np.bincount(ia, weights=va, minlength=len(sa))
    tb = np.bincount(ib, weights=vb, minlength=len(sb))
    w = 1.0 / (ta[:, None] + tb[None, :])
    Wa, Wb, W2a, W2b = w.sum(1), w.sum(0), (w * w).sum(1), (w * w).sum(0)
    taxa, ca = np.unique(np.concatenate([A["f"].to_numpy(), B["f"].to_numpy()]), return_inverse=True)
    ca, cb = ca[:len(A)], ca[len(A):]
    k = len(taxa)
    s1 = np.bincount(ca, weights=va * Wa[ia], minlength=k) + np.bincount(cb, weights=vb * Wb[ib], minlength=k)
    s2 = np.bincount(ca, weights=va * va * W2a[ia], minlength=k) + np.bincount(cb, weights=vb * vb * W2b[ib], minlength=k)
    # both non-zero: pairs (A entry, B entry) sharing a taxon, generated per taxon
    order = np.argsort(cb, kind="stable")
    cb_s, ib_s, vb_s = cb[order], ib[order], vb[order]
    cnt = np.bincount(cb_s, minlength=k)
    start = np.concatenate([[0], np.cumsum(cnt)[:-1]])
    reps = cnt[ca]
    tot = int(reps.sum())
    if tot:
        ia_r, va_r, ca_r = np.repeat(ia, reps), np.repeat(va, reps), np.repeat(ca, reps)
        pos = np.repeat(start[ca], reps) + np.arange(tot) - np.repeat(np.cumsum(reps) - reps, reps)
        wij = w[ia_r, ib_s[pos]]
        s1 -= 2 * np.bincount(ca_r, weights=np.minimum(va_r, vb_s[pos]) * wij, minlength=k)
        s2 -= 2 * np.bincount(ca_r, weights=va_r * vb_s[pos] * wij * wij, minlength=k)
    return pd.DataFrame({"by": by, "ga": ga, "gb": gb, "taxon": taxa, "s1": s1, "s2": s2})


def simper(df: DataFrame, groups: DataFrame, sample: str = "sample", taxon: str = "taxon",
           value: str = "value", group: str = "group", by: str | None = None,
           block_size: int = 256) -> DataFrame:
    """SIMPER contributions of each taxon to the Bray-Curtis dissimilarity between
    every pair of groups (within ``by``): average, sd, ratio, group means and the
    cumulative share.

    Contribution of taxon k to pair (i, j) is |x_ik - x_jk| / (T_i + T_j). Its sums
    over all between-group pairs are split into per-sample terms plus a shared-taxon
    correction, computed in tasks that each hold one block of each group, so no pair
    table and no dense matrix is built in Spark.
    """
    import math
    g = groups.select(F.col(sample).alias("s"), F.col(group).cast("string").alias("g"),
                      (F.col(by).cast("string") if by else F.lit("all")).alias("by")).distinct()
    x = df.select(F.col(sample).alias("s"), F.col(taxon).alias("f"), F.col(value).cast("double").alias("v")) \
        .where(F.col("v") > 0).join(g, "s")
    sizes = g.groupBy("by", "g").agg(F.count(F.lit(1)).alias("n"))
    nmax = sizes.agg(F.max("n")).first()[0] or 1
    nb = max(1, math.ceil(nmax / block_size))
    x = x.withColumn("blk", F.pmod(F.xxhash64("s"), F.lit(nb)).cast("int"))
    gl = g.select("by", "g").distinct()
    cmp = gl.alias("l").join(gl.alias("r"), (F.col("l.by") == F.col("r.by")) & (F.col("l.g") < F.col("r.g"))) \
        .select(F.col("l.by").alias("by"), F.col("l.g").alias("ga"), F.col("r.g").alias("gb"))
    left = x.join(cmp.withColumnRenamed("ga", "g"), ["by", "g"]).withColumnRenamed("g", "ga") \
        .withColumn("side", F.lit(0)).withColumn("ob", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))) \
        .withColumn("ba", F.col("blk")).withColumn("bb", F.col("ob"))
    right = x.join(cmp.withColumnRenamed("gb", "g"), ["by", "g"]).withColumnRenamed("g", "gb") \
        .withColumn("side", F.lit(1)).withColumn("ob", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))) \
        .withColumn("ba", F.col("ob")).withColumn("bb", F.col("blk"))
    cols = ["by", "ga", "gb", "ba", "bb", "side", "s", "f", "v"]
    parts = left.select(*cols).unionByName(right.select(*cols))
    sums = parts.groupBy("by", "ga", "gb", "ba", "bb").applyInPandas(_simper_block, SIMPER_PARTS)
    sums = sums.groupBy("by", "ga", "gb", "taxon").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    na = sizes.select("by", F.col("g").alias("ga"), F.col("n").alias("na"))
    nbb = sizes.select("by", F.col("g").alias("gb"), F.col("n").alias("nb"))
    means = x.groupBy("by", "g", F.col("f").alias("taxon")).agg(F.sum("v").alias("sv"))
    r = sums.join(na, ["by", "ga"]).join(nbb, ["by", "gb"])
    r = r.join(means.select("by", F.col("g").alias("ga"), "taxon", F.col("sv").alias("sva")), ["by", "ga", "taxon"], "left")
    r = r.join(means.select("by", F.col("g").alias("gb"), "taxon", F.col("sv").alias("svb")), ["by", "gb", "taxon"], "left")
    npair = F.col("na") * F.col("nb")
    avg = F.col("s1") / npair
    r = r.withColumn("average", avg).withColumn(
        "sd", F.sqrt(F.greatest((F.col("s2") - npair * avg * avg) / (npair - 1), F.lit(0.0))))
    r = r.withColumn("ratio", F.try_divide(F.col("average"), F.col("sd")))
    r = r.withColumn("ava", F.coalesce(F.col("sva"), F.lit(0.0)) / F.col("na")) \
         .withColumn("avb", F.coalesce(F.col("svb"), F.lit(0.0)) / F.col("nb"))
    # equal averages may differ in their last bits with the order of summation: ties by taxon
    w = Window.partitionBy("by", "ga", "gb").orderBy(F.desc(F.round(F.col("average") * 1e12)), "taxon") \
        .rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("cusum", F.sum("average").over(w) / F.sum("average").over(Window.partitionBy("by", "ga", "gb")))
    return r.select("by", F.concat("ga", F.lit("_"), "gb").alias("comparison"), "taxon", "average", "sd", "ratio",
                    "ava", "avb", "cusum")


def _simper_permuted(left, right):
    """Per taxon and two groups, the sums of contributions over the pairs of samples of two
    blocks that have these groups: with the true labels first, then for every permutation."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    out = {"by": [], "ga": [], "gb": [], "taxon": [], "chunk": [], "sums": []}
    schema = pa.schema([("by", pa.string()), ("ga", pa.string()), ("gb", pa.string()), ("taxon", pa.string()), ("chunk", pa.int32()),
                        ("sums", pa.list_(pa.float64()))])
    if not left.num_rows or not right.num_rows:
        return pa.table(out, schema)
    names, block = pd.Index(right.column("s").to_pylist()), np.array(right.column("blk").to_pylist())
    bi, bj = left.column("bi")[0].as_py(), left.column("bj")[0].as_py()
    codes, groups = pd.factorize(np.array(right.column("v").combine_chunks().flatten().to_pylist(), object), sort=True)
    v = codes.reshape(len(names), -1)
    row = names.get_indexer(left.column("s").to_pylist())
    taxa, col = np.unique(left.column("f").to_numpy(), return_inverse=True)
    x = np.zeros((len(taxa), len(names)))
    np.add.at(x, (col, row), left.column("v").to_numpy())
    total = x.sum(axis=0)
    side = block == bi
    pair = np.triu(np.ones((len(names), len(names)), bool), 1) if bi == bj else side[:, None] & ~side[None, :]
    with np.errstate(divide="ignore"):
        w = np.where(pair & (total[:, None] + total[None, :] > 0), 1.0 / (total[:, None] + total[None, :]), 0.0)
    w = w + w.T
    has = [(v == g).astype(np.float64) for g in range(len(groups))]
    by, chunk = left.column("by")[0].as_py(), right.column("chunk")[0].as_py()
    for k, taxon in enumerate(taxa):
        c = np.abs(x[k][:, None] - x[k][None, :]) * w
        for b in range(1, len(groups)):
            some = c @ has[b]
            for a in range(b):
                s = (some * has[a]).sum(axis=0)
                if s.any():
                    for name, value in zip(out, (by, groups[a], groups[b], taxon, chunk, s)):
                        out[name].append(value)
    return pa.table(out, schema)


def simper_permutation_p(df: DataFrame, groups: DataFrame, nperm: int = 99, seed: int = 1,
                         sample: str = "sample", taxon: str = "taxon", value: str = "value",
                         group: str = "group", by: str | None = None, block_size: int = 128) -> DataFrame:
    """U16: permutation p-value of each SIMPER average: labels are shuffled within ``by``. The
    rows and labels of two blocks of samples meet in one task, which sums the contributions of
    each taxon for all permutations at once by products with the label matrix; a row per taxon
    and two groups leaves it, with an array of sums."""
    import math
    g = groups.select(F.col(sample).alias("s"), F.col(group).cast("string").alias("g"),
                      (F.col(by).cast("string") if by else F.lit("all")).alias("by")).distinct()
    x = df.select(F.col(sample).alias("s"), F.col(taxon).alias("f"), F.col(value).cast("double").alias("v")).where(F.col("v") > 0).join(g.drop("g"), "s")
    sizes = g.groupBy("by", "g").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("by").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = max(1, math.ceil(most / block_size))
    labels = _label_arrays(permuted_labels(g, nperm, seed, within="by"), F.col("g"), "by")
    labels = labels.join(g, ["by", "s"]).withColumn("v", F.concat(F.array("g"), "v")).withColumn("blk", _block_of(F.col("s"), blocks))
    lab = _to_block_pairs(labels.select("by", "s", "blk", "chunk", "v"), "s", blocks)
    rows = _to_block_pairs(x, "s", blocks).select("*", _chunks(nperm))
    keys = ["by", "bi", "bj", "chunk"]
    parts = rows.select(F.concat("by", F.lit("")).alias("by"), *keys[1:], "s", "f", "v").groupBy(*keys).cogroup(lab.groupBy(*keys)).applyInArrow(
        _simper_permuted, "by string, ga string, gb string, taxon string, chunk int, sums array<double>")
    both = F.aggregate(F.slice("__l", 2, F.size("__l")), F.get("__l", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda u, w: u + w))
    d = parts.groupBy("by", "ga", "gb", "taxon", "chunk").agg(F.collect_list("sums").alias("__l")).withColumn("sums", both)
    # rounding noise between equal sums does not count as a difference
    least = F.get("sums", F.lit(0)) * (1 - 1e-12) - 1e-12
    d = d.withColumn("more", F.size(F.filter(F.slice("sums", 2, F.size("sums")), lambda v: v >= least)))
    d = d.groupBy("by", "ga", "gb", "taxon").agg(F.sum("more").alias("more"), F.max(F.get("sums", F.lit(0))).alias("s1"))
    na, nb = (sizes.select("by", F.col("g").alias(c), F.col("n").alias(n)) for c, n in (("ga", "na"), ("gb", "nb")))
    d = d.join(na, ["by", "ga"]).join(nb, ["by", "gb"]).where(F.col("s1") > 0)
    return d.select("by", F.concat("ga", F.lit("_"), "gb").alias("comparison"), "taxon", (F.col("s1") / (F.col("na") * F.col("nb"))).alias("average"),
                    ((F.col("more") + 1) / (nperm + 1)).alias("p"))
