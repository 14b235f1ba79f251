"""Registered queries: replicate dissimilarity and sample distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import denoise as D
from ..operators import distance as X
from ..operators._util import round_cols
from . import chain as C
from . import oracle_chain  # noqa: F401
from . import views as V
from .registry import query

_U4_SQL = """
WITH nz AS (SELECT sample, hash, value AS v FROM norm WHERE value > 0),
tot AS (SELECT sample, sum(v) AS t FROM nz GROUP BY sample),
s AS (SELECT l.sample AS a, r.sample AS b, sum(least(l.v, r.v)) AS S
      FROM nz l JOIN nz r ON l.hash = r.hash AND l.sample < r.sample GROUP BY l.sample, r.sample),
p AS (SELECT ta.sample AS sample1, tb.sample AS sample2,
             1.0 - 2.0 * coalesce(s.S, 0.0) / (ta.t + tb.t) AS bray
      FROM tot ta JOIN tot tb ON ta.sample < tb.sample
      LEFT JOIN s ON s.a = ta.sample AND s.b = tb.sample)
"""


@query("u4_dissimilarity", _U4_SQL + """
SELECT sample1, sample2, round(bray, 6) AS bray, round(2 * bray / (1 + bray), 6) AS jaccard FROM p""",
       ("norm",))
def u4(spark, d):
    return round_cols(X.dissimilarity(C.normalized(spark, d), "sample", "hash", "value"),
                      ["bray", "jaccard"])


@query("d22_within_bottle_pairs", "SELECT bottle, a, b, round(bray, 6) AS bray FROM bpairs", ("bpairs",))
def d22a(spark, d):
    return round_cols(C.bottle_pairs(spark, d), "bray")


@query("d22_centroid_distance", "SELECT bottle, sample, round(distance, 6) AS distance FROM centroid",
       ("centroid",))
def d22(spark, d):
    return round_cols(C.centroid_distances(spark, d), "distance")


@query("d22_median_distance")
def d22m(spark, d):
    """betadisper default centre (spatial median); checked by unit tests, not SQL."""
    return X.median_distance(C.bottle_pairs(spark, d), "bottle")


@query("d23_tail_outliers", """
SELECT sample, round(distance_to_centroid, 6) AS distance_to_centroid FROM discarded""", ("discarded",))
def d23(spark, d):
    return round_cols(C.discarded(spark, d), "distance_to_centroid")


@query("d24_distance_classes", _U4_SQL + """
SELECT sample1, sample2, round(value, 6) AS value,
  CASE WHEN split_part(sample1, '.', 1) = split_part(sample2, '.', 1) THEN 'PCR.replicates'
       WHEN left(split_part(sample1, '.', 1), length(split_part(sample1, '.', 1)) - 1)
          = left(split_part(sample2, '.', 1), length(split_part(sample2, '.', 1)) - 1) THEN 'Biol.replicates'
       WHEN split_part(split_part(sample1, '.', 1), '_', 1) = split_part(split_part(sample2, '.', 1), '_', 1) THEN 'Same Site'
       ELSE 'Different Site' END AS distance_type
FROM (SELECT sample1, sample2, bray AS value FROM p UNION ALL SELECT sample2, sample1, bray FROM p)""", ("norm",))
def d24(spark, d):
    pairs = X.dissimilarity(C.normalized(spark, d), "sample", "hash", "value")
    return round_cols(X.distance_classes(pairs, value="bray"), "value")


EXCLUDED_DATE = "199501"

_COVERAGE_SQL = f"""
cov AS (
  SELECT e.event, e.site_code AS site, e.date, a.area, e.cases FROM (
    SELECT event, count(*) AS cases, split_part(event, '_', 1) AS site_code,
           strptime(split_part(event, '_', 2) || '01', '%Y%m%d')::DATE AS date
    FROM (SELECT left(sample, length(sample) - 3) AS event
          FROM (SELECT DISTINCT sample FROM centroid WHERE sample NOT IN (SELECT sample FROM discarded)))
    GROUP BY event) e
  LEFT JOIN (SELECT DISTINCT site, area FROM env) a ON a.site = e.site_code
  WHERE split_part(e.event, '_', 2) <> '{EXCLUDED_DATE}')
"""


def _coverage(spark, d):
    kept = D.drop_keys(C.centroid_distances(spark, d).select("sample"), C.discarded(spark, d), "sample")
    return D.coverage_matrix(kept, V.env(spark, d), exclude_date=EXCLUDED_DATE)


@query("d25_coverage_matrix", f"WITH {_COVERAGE_SQL} SELECT event, site, date, area, cases FROM cov",
       ("centroid", "discarded", "env"))
def d25(spark, d):
    return _coverage(spark, d)


@query("d26_coverage_report", f"""
WITH {_COVERAGE_SQL},
st AS (SELECT event, '(' || CAST(CAST(round_even(avg(n), 0) AS BIGINT) AS VARCHAR) || ' +- ' ||
              coalesce(CAST(CAST(round_even(stddev_samp(n), 0) AS BIGINT) AS VARCHAR), 'NA') || ')' AS t
       FROM (SELECT left(sample, length(sample) - 3) AS event, sum(n_reads) AS n FROM step4 GROUP BY sample)
       GROUP BY event)
SELECT c.area, c.site, c.date, CAST(c.cases AS VARCHAR) || ' ' || coalesce(st.t, 'NA') AS data,
       strftime(c.date, '%b') || '''' || CAST(year(c.date) AS VARCHAR) AS month
FROM cov c LEFT JOIN st ON st.event = c.event""", ("centroid", "discarded", "env", "step4"))
def d26(spark, d):
    return D.coverage_report(C.step4(spark, d), _coverage(spark, d))


SITE_ORDER = [f"{i:02d}" for i in range(24, -1, -1)]  # a custom display order of the sites


@query("d26_coverage_report_wide")
def d26w(spark, d):
    return D.coverage_report(C.step4(spark, d), _coverage(spark, d), wide=True, site_order=SITE_ORDER)


@query("d27_run_denoising", "SELECT * FROM step4", ("step4",))
def d27(spark, d):
    from .denoising import run_denoising
    return run_denoising(V.reads(spark, d), center="centroid")


@query("d27_denoising_median")
def d27_median(spark, d):
    from .denoising import run_denoising
    return run_denoising(V.reads(spark, d))
