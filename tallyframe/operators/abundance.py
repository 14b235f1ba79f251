"""Abundance tables: collapsing counts, the eDNA index, community matrices and
sample/taxon standardisations (long, sparse form throughout)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from ._util import SMALL_ROWS, as_list, is_small, with_group_agg, with_group_total


def collapse_counts(df: DataFrame, keys=("run", "sample", "hash"), n: str = "n_reads") -> DataFrame:
    """Sum repeated rows of the same key."""
    keys = as_list(keys)
    return df.groupBy(*keys).agg(F.sum(n).alias(n))


def duplicate_keys(df: DataFrame, key, name: str = "tot") -> DataFrame:
    """Rows per key, most repeated first."""
    keys = as_list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *keys)


def first_per_key(df: DataFrame, key, order) -> DataFrame:
    """One row per key, the first by an explicit tie order (``distinct(.keep_all)``).

    ``order`` lists column names (ascending) or ``(name, ascending)`` pairs. It is an
    aggregate -- the minimum of a struct of the sort keys and the row -- so rows are
    combined map-side and a key holding a third of the rows is not sorted in one task.
    Descending string keys fall back to a window.
    """
    keys = as_list(key)
    spec = [(o, True) if isinstance(o, str) else tuple(o) for o in as_list(order)]
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    if any(not asc and not types[c].startswith(numeric) for c, asc in spec):
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() if asc else F.col(c).desc() for c, asc in spec])
        return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    rest = [c for c in df.columns if c not in keys]
    sort = [(F.col(c) if asc else -F.col(c)).alias(f"_o{i}") for i, (c, asc) in enumerate(spec)]
    best = F.min(F.struct(*sort, F.struct(*[F.col(c) for c in rest]).alias("_row")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b._row.{c}").alias(c) for c in rest])


def edna_index(df: DataFrame, sample: str = "sample", otu: str = "hash", n: str = "n_reads",
               biol_rep: str | None = None, out: str = "index", per_row: bool = False) -> DataFrame:
    """eDNA index.

    Direct: per (sample, otu) sum, divide by the sample total, divide by the otu's max.
    With ``biol_rep``: proportions per (sample, replicate), summed over replicates and
    divided by the number of replicates of the sample, then divided by the otu max.
    ``per_row``: the replicate-dissimilarity variant -- each input row (e.g. one run's
    count) is divided by the sample total and by the otu's largest row share, and the
    results are summed per (sample, otu).
    """
    if per_row:
        s = with_group_total(df, sample, _tot=F.sum(n))
        s = s.withColumn("_p", F.col(n) / F.col("_tot"))
        s = with_group_agg(s, otu, _mx=F.max("_p"))
        return s.groupBy(sample, otu).agg(F.sum(F.col("_p") / F.col("_mx")).alias(out))
    if biol_rep is None:
        s = df.groupBy(sample, otu).agg(F.sum(n).alias("_s"))
        s = with_group_agg(s, sample, _tot=F.sum("_s"))
        s = s.withColumn("_p", F.col("_s") / F.col("_tot"))
    else:
        # the rows are summed once; totals per replicate and replicates per sample, one small
        # table, come from the sums
        s = stored(df.groupBy(sample, otu, biol_rep).agg(F.sum(n).alias("_s")), "sums")
        t = s.groupBy(F.col(sample).alias("__s"), F.col(biol_rep).alias("__b")).agg(F.sum("_s").alias("_tot"))
        t = stored(with_group_agg(t, "__s", _nrep=F.count("__b")), "totals")  # a null replicate does not count
        same = F.col(sample).eqNullSafe(F.col("__s")) & F.col(biol_rep).eqNullSafe(F.col("__b"))
        s = s.join(F.broadcast(t) if is_small(t, SMALL_ROWS) else t, same).drop("__s", "__b")
        s = (s.groupBy(sample, otu)
             .agg((F.sum(F.col("_s") / F.col("_tot")) / F.max("_nrep")).alias("_p")))
    s = with_group_agg(s, otu, _mx=F.max("_p"))
    return s.select(sample, otu, (F.col("_p") / F.col("_mx")).alias(out))


def top_feature(df: DataFrame, by: str = "sample", feature: str = "hash", value: str = "index") -> DataFrame:
    """Highest-valued feature per group (ties: smallest feature). One aggregate, no window."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(feature).alias("f")))
    return (df.groupBy(by).agg(best.alias("_b"))
            .select(by, F.col("_b.f").alias(feature), (-F.col("_b.v")).alias(value)))


# --- community matrix ---------------------------------------------------------------

def densify(df: DataFrame, sample: str = "sample", otu: str = "hash", value: str = "value") -> DataFrame:
    """U3 long form: every (sample, otu) pair, zero-filled.

    Dense by definition (samples x features rows), formed in blocks (``sparse.SparseTable``):
    rows that are there stay as they are, the others come from the two key lists.
    """
    from .sparse import SparseTable
    t = SparseTable.of(df.fillna(0, subset=[value]), sample, otu, value, zeros=True)
    return t.dense().select(sample, otu, value)


def community_matrix(df: DataFrame, sample: str, otu: str, value: str, otus: list | None = None) -> DataFrame:
    """U3 wide form: one column per feature, zero-filled. Pass ``otus`` to skip the extra
    pass that discovers the pivot values."""
    g = df.groupBy(sample)
    g = g.pivot(otu, otus) if otus is not None else g.pivot(otu)
    return g.agg(F.sum(value)).fillna(0)


def sample_attributes(df: DataFrame, sample: str, cols) -> DataFrame:
    """U3 companion: distinct sample attributes, in the sample order of the matrix."""
    return df.select(sample, *as_list(cols)).distinct()


# --- transformations (vegan decostand semantics on the sparse long table) ------------

SAMPLE_METHODS = ("total", "normalize", "hellinger", "pa", "sqrt", "rank", "rrank", "log")
TAXON_METHODS = ("max", "frequency", "range", "standardize")


def transform(df: DataFrame, method: str, sample: str = "sample", otu: str = "hash",
              value: str = "value", out: str | None = None) -> DataFrame:
    """Decostand-style transforms on a long (sample, otu, value) table.

    Zeros are implicit (absent rows). Methods whose zeros stay zero run on the sparse
    table; ``standardize``, ``range`` and ``chi.square`` need the number of samples.
    Unknown method names are rejected.
    """
    out = out or value
    v = F.col(value)
    if method == "total":
        r = with_group_agg(df, sample, _t=F.sum(value))
        return r.withColumn(out, v / F.col("_t")).drop("_t")
    if method == "normalize":
        r = with_group_agg(df, sample, _t=F.sum(v * v))
        return r.withColumn(out, v / F.sqrt("_t")).drop("_t")
    if method == "hellinger":
        r = with_group_agg(df, sample, _t=F.sum(value))
        return r.withColumn(out, F.sqrt(v / F.col("_t"))).drop("_t")
    if method == "pa":
        return df.withColumn(out, F.when(v > 0, 1.0).otherwise(0.0))
    if method == "sqrt":
        return df.withColumn(out, F.sqrt(v))
    if method == "log":
        return df.withColumn(out, F.when(v > 0, F.log2(v) + 1).otherwise(F.lit(0.0)))
    if method in ("rank", "rrank"):
        nz = df.where(v > 0)
        w = Window.partitionBy(sample).orderBy(value)
        wt = Window.partitionBy(sample, value)
        r = nz.withColumn("_rk", F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0)
        if method == "rrank":
            r = with_group_agg(r, sample, _mx=F.max("_rk"))
            r = r.withColumn("_rk", F.col("_rk") / F.col("_mx")).drop("_mx")
        return r.withColumn(out, F.col("_rk").cast("double")).drop("_rk")
    n_samples = df.select(F.count_distinct(sample)).scalar()  # scalar subquery, no collect
    if method == "max":
        r = with_group_agg(df, otu, _m=F.max(value))
        return r.withColumn(out, v / F.col("_m")).drop("_m")
    if method == "frequency":
        # x / sum * number of non-zero entries  (vegan: divide by column total, times k)
        r = with_group_agg(df, otu, _s=F.sum(value), _k=F.count_if(v > 0))
        return r.withColumn(out, v / F.col("_s") * F.col("_k")).drop("_s", "_k")
    if method == "range":
        # zeros are present whenever a taxon is missing from some sample
        r = with_group_agg(df, otu, _mx=F.max(value), _mn=F.min(value), _c=F.count(F.lit(1)))
        mn = F.when(F.col("_c") < n_samples, F.least(F.col("_mn"), F.lit(0))).otherwise(F.col("_mn"))
        rng = F.col("_mx") - mn
        return (r.withColumn(out, F.when(rng > 0, (v - mn) / rng).otherwise(F.lit(0.0)))
                .drop("_mx", "_mn", "_c"))
    if method == "standardize":
        # mean and sd (n-1) over all samples, zeros included, from the cells alone (k of the n
        # samples have one); returns the dense table because zeros become non-zero by centring
        from .sparse import SparseTable
        t = SparseTable.of(df.select(sample, otu, value).fillna(0, subset=[value]), sample, otu, value, zeros=True)
        g = t.cells.groupBy(otu).agg(F.count(F.lit(1)).alias("_k"), F.avg(value).alias("_a"), F.var_pop(value).alias("_v"))
        m, k = F.col("_k") * F.col("_a") / n_samples, F.col("_k")
        ss = k * F.col("_v") + k * (F.col("_a") - m) * (F.col("_a") - m) + (n_samples - k) * m * m
        g = g.select(otu, m.alias("_m"), F.sqrt(F.try_divide(ss, n_samples - 1)).alias("_sd"))
        t.cols = t.cols.join(g, otu)
        r = t.dense()
        return r.select(sample, otu, value, F.try_divide(v - F.col("_m"), F.col("_sd")).alias("__z")).withColumn(out, F.col("__z")).drop("__z")
    if method == "chi.square":
        # sqrt(grand total) * x / (row total * sqrt(col total))   (vegan, MARGIN = 1)
        r = with_group_agg(df, sample, _rs=F.sum(value))
        r = with_group_agg(r, otu, _cs=F.sum(value))
        grand = df.select(F.sum(value)).scalar()
        return (r.withColumn(out, F.sqrt(grand) * v / (F.col("_rs") * F.sqrt(F.col("_cs"))))
                .drop("_rs", "_cs"))
    raise ValueError(f"unknown transformation {method!r}")
