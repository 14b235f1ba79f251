"""Denoising steps for (run, sample, hash, n_reads) tables.

All steps are per-run joins/aggregations with ``run`` as an ordinary key column
(instead of one nested table per run), so runs are processed in one plan.
Normal fits are kept inside the plan as scalar subqueries; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import POSITIVE_PATTERN, classify_source
from ..functions.stats import norm_ppf
from ..session import stored
from ._util import as_list, small_list, union_all, with_group_total


def tag_source(df: DataFrame, sample: str = "sample", pattern: str = POSITIVE_PATTERN,
               out: str = "source") -> DataFrame:
    """N5 applied to a table: ``Positives`` for control samples, else ``Samples``."""
    return df.withColumn(out, classify_source(sample, pattern))


def stage_summary(df: DataFrame, stage: str, run: str = "run", sample: str = "sample",
                  hash: str = "hash", n: str = "n_reads") -> DataFrame:
    """Per run distinct samples, distinct hashes and reads, as (run, stage, stat, number)."""
    g = df.groupBy(run).agg(
        F.count_distinct(sample).cast("bigint").alias("nsamples"),
        F.count_distinct(hash).cast("bigint").alias("nhashes"),
        F.sum(n).cast("bigint").alias("nreads"))
    return (g.unpivot(run, ["nsamples", "nhashes", "nreads"], "stat", "number")
            .withColumn("stage", F.lit(f"Step_{stage}")))


def otu_rank(df: DataFrame, hash: str = "hash", n: str = "n_reads", out: str = "tot") -> DataFrame:
    """Hashes by total reads, largest first."""
    return df.groupBy(hash).agg(F.sum(n).alias(out)).orderBy(F.desc(out), hash)


def contamination_vector(positives: DataFrame, run: str = "run", sample: str = "sample",
                         hash: str = "hash", n: str = "n_reads",
                         out: str = "vector_contamination") -> DataFrame:
    """D3: per run and hash, the largest share a hash takes of a positive sample."""
    t = with_group_total(positives, [run, sample], _tot=F.sum(n))
    return t.groupBy(run, hash).agg(F.max(F.col(n) / F.col("_tot")).alias(out))


def subtract_contamination(samples: DataFrame, vec: DataFrame, run: str = "run",
                           sample: str = "sample", hash: str = "hash", n: str = "n_reads",
                           v: str = "vector_contamination") -> DataFrame:
    """N - ceil(v * sample total) where the hash has a vector; keep counts > 0."""
    s = samples.select(run, sample, hash, n).join(vec.select(run, hash, v), [run, hash], "left")
    s = with_group_total(samples, [run, sample], to=s, _tot=F.sum(n))
    upd = F.when(F.col(v).isNotNull(), F.col(n) - F.ceil(F.col(v) * F.col("_tot"))).otherwise(F.col(n))
    return (s.select(run, sample, hash, upd.cast("bigint").alias(n))
            .where(F.col(n) > 0))


def normal_fit(df: DataFrame, value: str, by=None) -> DataFrame:
    """Maximum-likelihood normal fit (sd divides by n), optionally per group."""
    aggs = [F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")]
    by = as_list(by)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def low_read_samples(df: DataFrame, p: float = 0.075, sample: str = "sample",
                     n: str = "n_reads") -> DataFrame:
    """D6 (report): samples whose total is in the lower ``p`` tail of a normal fit of all
    totals and below the mean. Totals pool runs, as in the reference."""
    tot = df.groupBy(sample).agg(F.sum(n).alias("tot"))
    fit = tot.select(F.struct(F.avg("tot").alias("m"), F.stddev_pop("tot").alias("s"))).scalar()
    mu = fit["m"]
    cut = mu + F.lit(norm_ppf(p)) * fit["s"]
    return tot.where((F.col("tot") < cut) & (F.col("tot") < mu))


def drop_low_reads(df: DataFrame, p: float = 0.075, sample: str = "sample",
                   n: str = "n_reads") -> DataFrame:
    """Remove the low-read samples."""
    return df.join(small_list(low_read_samples(df, p, sample, n).select(sample)), sample, "left_anti")


def origin_stats(df: DataFrame, source: str = "source", sample: str = "sample",
                 hash: str = "hash", n: str = "n_reads") -> DataFrame:
    """For hashes seen in positives, max/mean sample share and total reads by source.

    Output (hash, stat, positives, samples, origin, n_origins); missing source = 0.
    """
    st = origin_stats_wide(df, source, sample, hash, n)
    stats = ["max", "mean", "tot"]
    long = st.select(hash, F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"),
                 F.coalesce(F.col(f"{s}_Positives"), F.lit(0.0)).alias("positives"),
                 F.coalesce(F.col(f"{s}_Samples"), F.lit(0.0)).alias("samples"))
        for s in stats])).alias("_r")).select(hash, "_r.*")
    long = long.withColumn("origin", F.when(F.col("positives") > F.col("samples"), "Positive.control")
                           .otherwise("Environment"))
    # one row per (hash, stat): distinct origins per hash without a second shuffle
    return long.withColumn("n_origins", F.size(F.collect_set("origin").over(Window.partitionBy(hash))))


def origin_stats_wide(df: DataFrame, source: str = "source", sample: str = "sample",
                      hash: str = "hash", n: str = "n_reads") -> DataFrame:
    """D7 in wide form: one row per hash seen in positives with the three statistics
    for each source (null when the hash never occurs in that source). The rows of those
    hashes are stored once, by hash: totals and statistics are then combined map-side."""
    pos = df.where(F.col(source) == "Positives").select(hash).distinct()
    x = stored(df.select(source, sample, hash, n).join(pos, hash, "left_semi"), "origin")
    x = with_group_total(x, sample, _tot=F.sum(n))
    prop = F.col(n) / F.col("_tot")
    return x.groupBy(hash).agg(
        F.max(F.when(F.col(source) == "Positives", prop)).alias("max_Positives"),
        F.max(F.when(F.col(source) == "Samples", prop)).alias("max_Samples"),
        F.avg(F.when(F.col(source) == "Positives", prop)).alias("mean_Positives"),
        F.avg(F.when(F.col(source) == "Samples", prop)).alias("mean_Samples"),
        F.sum(F.when(F.col(source) == "Positives", F.col(n))).cast("double").alias("tot_Positives"),
        F.sum(F.when(F.col(source) == "Samples", F.col(n))).cast("double").alias("tot_Samples"))


def unanimous_from_wide(wide: DataFrame, hash: str = "hash") -> DataFrame:
    """D8 from the wide statistics: all three say positives (missing source = 0)."""
    cond = F.lit(True)
    for s in ("max", "mean", "tot"):
        cond = cond & (F.coalesce(F.col(f"{s}_Positives"), F.lit(0.0)) > F.coalesce(F.col(f"{s}_Samples"), F.lit(0.0)))
    return wide.where(cond).select(hash)


def unanimous_fate(stats: DataFrame, hash: str = "hash") -> DataFrame:
    """Hashes on which all statistics agree on ``Positive.control``."""
    return (stats.groupBy(hash)
            .agg(F.count_distinct("origin").alias("_n"), F.min("origin").alias("_o"))
            .where((F.col("_n") == 1) & (F.col("_o") == "Positive.control"))
            .select(hash))


def occurrence_fate(df: DataFrame, unanimous: DataFrame, extra=(), source: str = "source",
                    hash: str = "hash") -> DataFrame:
    """Hashes to remove: seen in at least as many positive rows as sample rows,
    or unanimous by D8, or listed in ``extra``. Full outer merge keeps provenance."""
    occ = df.groupBy(hash).agg(
        F.count_if(F.col(source) == "Positives").alias("positives"),
        F.count_if(F.col(source) == "Samples").alias("samples"))
    occ = occ.where(F.col("positives") >= F.col("samples")).withColumn("by_occurrence", F.lit(True))
    u = unanimous.select(hash).withColumn("by_stats", F.lit(True))
    merged = occ.join(u, hash, "full")
    parts = [merged]
    if extra:
        spark = df.sparkSession
        parts.append(spark.createDataFrame([(h,) for h in extra], f"{hash} string")
                     .withColumn("by_list", F.lit(True)))
    out = union_all(parts) if len(parts) > 1 else merged
    return out.select(hash, "positives", "samples",
                      F.coalesce("by_occurrence", F.lit(False)).alias("by_occurrence"),
                      F.coalesce("by_stats", F.lit(False)).alias("by_stats"))


def removed_sequences(removed: DataFrame, hash_key: DataFrame, hash: str = "hash") -> DataFrame:
    """Attach the sequence of every removed hash (null when unknown)."""
    return removed.select(hash).distinct().join(hash_key, hash, "left")


def drop_keys(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows whose key is not in ``keys`` (null-safe, unlike NOT IN)."""
    return df.join(small_list(keys.select(*as_list(on)).distinct()), as_list(on), "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return df.join(small_list(keys.select(*as_list(on)).distinct()), as_list(on), "left_semi")


def keep_occupied(df: DataFrame, fate: DataFrame, threshold: float = 0.8,
                  hash: str = "hash", col: str = "max") -> DataFrame:
    """Keep hashes whose occupancy probability exceeds ``threshold``."""
    return keep_keys(df, fate.where(F.col(col) > threshold), hash)


def equal_width_bins(df: DataFrame, x: str, n: int = 20, weight: str | None = None) -> DataFrame:
    """``n`` equal intervals between min and max (right-closed, lowest included):
    (bin, lo, hi, count, weight_sum)."""
    mn = df.select(F.min(x)).scalar()
    mx = df.select(F.max(x)).scalar()
    width = (mx - mn) / n
    b = F.when(mx == mn, F.lit(0)).otherwise(
        F.greatest(F.ceil((F.col(x) - mn) / width) - 1, F.lit(0)))
    b = F.least(b, F.lit(n - 1)).cast("int")
    w = F.col(weight) if weight else F.lit(None).cast("double")
    g = (df.where(F.col(x).isNotNull()).withColumn("bin", b)
         .groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.sum(w).alias("weight_sum")))
    return g.select("bin", (mn + F.col("bin") * width).alias("lo"),
                    (mn + (F.col("bin") + 1) * width).alias("hi"), "count", "weight_sum")


def single_replicates(df: DataFrame, sample: str = "sample") -> DataFrame:
    """D21 (report): samples that are the only technical replicate of their bottle."""
    s = df.select(sample).distinct().withColumn("_bottle", F.substring_index(sample, ".", 1))
    one = s.groupBy("_bottle").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    return s.join(one, "_bottle", "left_semi").select(sample)


def drop_single_replicates(df: DataFrame, sample: str = "sample") -> DataFrame:
    """Remove bottles with a single technical replicate."""
    return df.join(small_list(single_replicates(df, sample)), sample, "left_anti")


def tail_outliers(dist: DataFrame, p: float = 0.95, singles: DataFrame | None = None,
                  sample: str = "sample", d: str = "distance") -> DataFrame:
    """Replicates whose distance to the bottle centre is in the upper ``p`` tail of
    a normal fit over all distances; single replicates are appended with a null
    distance. Output (sample, distance_to_centroid)."""
    fit = dist.select(F.struct(F.avg(d).alias("m"), F.stddev_pop(d).alias("s"))).scalar()
    out = (dist.where(F.col(d) > fit["m"] + F.lit(norm_ppf(p)) * fit["s"])
           .select(sample, F.col(d).alias("distance_to_centroid")))
    if singles is not None:
        out = out.unionByName(singles.select(sample, F.lit(None).cast("double").alias("distance_to_centroid")))
    return out


def coverage_matrix(kept: DataFrame, site_area: DataFrame, exclude_date: str | None = None,
                    sample: str = "sample", site_names: DataFrame | None = None) -> DataFrame:
    """Technical replicates kept per event (site, date) with area and site name.

    ``kept`` has one row per kept sample; ``site_area`` maps site -> area; optional
    ``site_names`` maps site -> display name (kept as is when missing).
    """
    ev = kept.select(sample).distinct().select(
        F.expr(f"substring({sample}, 1, length({sample}) - 3)").alias("event"))
    g = ev.groupBy("event").agg(F.count(F.lit(1)).alias("cases"))
    g = g.select("event", "cases", F.substring_index("event", "_", 1).alias("site_code"),
                 F.regexp_extract("event", r"_(.*)$", 1).alias("_d"))
    if exclude_date:
        g = g.where(F.col("_d") != exclude_date)
    g = g.withColumn("date", F.try_to_timestamp(F.concat("_d", F.lit("01")), F.lit("yyyyMMdd")).cast("date"))
    g = g.join(site_area.select(F.col("site").alias("site_code"), "area").distinct(), "site_code", "left")
    if site_names is not None:
        g = g.join(site_names.select(F.col("site").alias("site_code"), F.col("name").alias("_nm")),
                   "site_code", "left").withColumn("site", F.coalesce("_nm", "site_code")).drop("_nm")
    else:
        g = g.withColumn("site", F.col("site_code"))
    return g.select("event", "site", "date", "area", "cases")


def coverage_report(df: DataFrame, coverage: DataFrame, sample: str = "sample",
                    n: str = "n_reads", wide: bool = False, site_order=None) -> DataFrame:
    """Per event ``"k (mean +- sd)"`` of reads per sample (R rounding: half to even),
    with a ``Mon'YYYY`` column label. Long form by default; ``wide`` pivots months
    (one row per area and site, rows ranked by ``site_order`` when given)."""
    tot = df.groupBy(sample).agg(F.sum(n).alias("_n"))
    tot = tot.select(F.expr(f"substring({sample}, 1, length({sample}) - 3)").alias("event"), "_n")
    st = tot.groupBy("event").agg(F.avg("_n").alias("_m"), F.stddev_samp("_n").alias("_s"))
    txt = F.concat(F.lit("("), F.bround("_m", 0).cast("bigint").cast("string"), F.lit(" +- "),
                   F.coalesce(F.bround("_s", 0).cast("bigint").cast("string"), F.lit("NA")), F.lit(")"))
    st = st.select("event", txt.alias("_t"))
    r = coverage.join(st, "event", "left")
    r = r.select("area", "site", "date",
                 F.concat(F.col("cases").cast("string"), F.lit(" "), F.coalesce("_t", F.lit("NA"))).alias("data"),
                 F.concat(F.date_format("date", "MMM"), F.lit("'"), F.year("date").cast("string")).alias("month"))
    if not wide:
        return r
    w = r.groupBy("area", "site").pivot("month").agg(F.first("data")).fillna("")
    if site_order:
        from ..functions.keys import order_rank
        w = w.withColumn("site_rank", order_rank("site", list(site_order))).orderBy("site_rank", "area", "site")
    return w
