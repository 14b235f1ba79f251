"""The whole denoising sequence on any (run, sample, hash, n_reads) table.

The positives/samples split, contamination subtraction, low-read filter,
positive-hash removal, replicate check and replicate-outlier removal, composed as
one Spark plan with lineage cuts: ``checkpoint()`` into the cluster's shared
``spark.checkpoint.dir`` after collapsing, after the subtraction, after the positive-hash removal (the
reference's hand-off to the occupancy step), for the normalised table and the
per-sample centre distances (each read several times) and at the end. A checkpoint
survives executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import abundance as A
from ..operators import denoise as D
from ..operators import distance as X
from ..session import stored


def run_denoising(reads: DataFrame, low_p: float = 0.075, outlier_p: float = 0.95,
                  extra_remove=(), occupancy: DataFrame | None = None,
                  occupancy_threshold: float = 0.8, checkpoint: bool = True,
                  center: str = "median") -> DataFrame:
    """Return the cleaned (run, sample, hash, n_reads) table.

    ``center``: what replicates are measured from, the spatial ``median`` of their bottle
    (the default of the reference's dispersion test) or its ``centroid``, in closed form.
    ``occupancy`` (hash, max) optionally applies D19 between the two stages.
    """
    if center not in ("median", "centroid"):
        raise ValueError(f"center must be median or centroid, not {center!r}")
    c = D.tag_source(A.collapse_counts(reads))
    if checkpoint:
        c = stored(c)  # read by the subtraction, the fate statistics and the occurrences
    pos = c.where(F.col("source") == "Positives")
    smp = c.where(F.col("source") == "Samples")
    s1 = D.subtract_contamination(smp, D.contamination_vector(pos))
    if checkpoint:
        s1 = stored(s1)  # read by the per-sample totals, their fit and the anti join
    s2 = D.drop_low_reads(s1, low_p)
    fate = D.occurrence_fate(c, D.unanimous_from_wide(D.origin_stats_wide(c)), extra=extra_remove)
    s3 = D.drop_keys(s2, fate, "hash")
    if checkpoint:
        s3 = stored(s3)
    if occupancy is not None:
        s3 = D.keep_occupied(s3, occupancy, occupancy_threshold)
    singles = D.single_replicates(s3)
    rep = D.drop_keys(s3, singles, "sample")
    norm = A.edna_index(rep, out="value", per_row=True).withColumn("bottle", F.substring_index("sample", ".", 1))
    if checkpoint:
        norm = stored(norm)  # read three times by the replicate pairs
    pairs = X.within_group_distances(norm, "bottle", "sample", "hash", "value")
    cent = X.median_distance(pairs, "bottle") if center == "median" else \
        X.centroid_distance(pairs, norm.select("bottle", "sample"), "bottle")
    if checkpoint:
        cent = stored(cent)  # one row per sample; read by the fit and the cut
    disc = D.tail_outliers(cent, outlier_p, singles=singles)
    out = D.drop_keys(s3, disc, "sample")
    if checkpoint:
        out = stored(out)
    return out
