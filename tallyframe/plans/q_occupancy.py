"""Registered queries: occupancy patterns, grid posterior and fate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import denoise as D
from ..operators import occupancy as O
from ..operators._util import round_cols
from . import chain as C
from . import oracle_chain  # noqa: F401
from .oracle_views import VIEWS
from .registry import query

GRID = 20
ATTEMPT_GRIDS = (20, 24, 28)
ROUNDS = 4
K = 3


def hist(spark, d):
    return O.detection_histories(C.step3(spark, d))


def patterns(spark, d):
    s = C.step3(spark, d)
    bottles = s.select(F.substring_index("sample", "_", 1).alias("site"),
                       F.substring_index("sample", ".", 1).alias("bottle"))
    return O.presence_pattern(hist(spark, d), bottles, K)


def fit(spark, d, grid=GRID):
    f = O.occupancy_fit(patterns(spark, d), K, grid, rounds=ROUNDS)
    reps = O.pattern_representatives(patterns(spark, d)).select("pattern", O.max_detections(K).alias("x"))
    return f.join(reps, "pattern").withColumn("prob", O.prob_occupancy("x", "psi", "p11", "p10", K))


def _fit_sql(g: int) -> str:
    ll = " + ".join(
        f"n{y} * ln(psi * pow(p11, {y}) * pow(1 - p11, {K - y}) + (1 - psi) * pow(p10, {y}) * pow(1 - p10, {K - y}))"
        for y in range(K + 1))
    pars = {"psi": 0.0, "p11": 0.01, "p10": 0.0}
    parts = ["pt AS (SELECT DISTINCT pattern, n0, n1, n2, n3 FROM pats)",
             "box0 AS (SELECT *, " + ", ".join(f"CAST({lo} AS DOUBLE) AS lo_{p}, CAST(1 AS DOUBLE) AS hi_{p}"
                                              for p, lo in pars.items()) + " FROM pt)"]
    for r in range(ROUNDS):
        parts.append(f"""lp{r} AS MATERIALIZED (SELECT *, {ll} + 49.0 * ln(1 - p10) AS lp FROM (
          SELECT b.*, a.i AS i_psi, d.i AS i_p11, e.i AS i_p10, lo_psi + (a.i + 0.5) * (hi_psi - lo_psi) / {g} AS psi,
                 lo_p11 + (d.i + 0.5) * (hi_p11 - lo_p11) / {g} AS p11, lo_p10 + (e.i + 0.5) * (hi_p10 - lo_p10) / {g} AS p10
          FROM box{r} b, range({g}) a(i), range({g}) d(i), range({g}) e(i)))""")
        parts.append(f"w{r} AS MATERIALIZED (SELECT l.*, exp(lp - mx) AS w FROM lp{r} l "
                     f"JOIN (SELECT pattern, max(lp) AS mx FROM lp{r} GROUP BY pattern) USING (pattern))")
        for p, lo in pars.items():
            cum = f"""SELECT pattern, i, lo, step, m / t AS m, c / t AS c FROM (
              SELECT *, sum(m) OVER (PARTITION BY pattern ORDER BY i) AS c, sum(m) OVER (PARTITION BY pattern) AS t FROM (
                SELECT pattern, i_{p} AS i, any_value(lo_{p}) AS lo, any_value((hi_{p} - lo_{p}) / {g}) AS step, sum(w) AS m
                FROM w{r} GROUP BY pattern, i_{p}))"""
            if r == ROUNDS - 1:
                parts.append(f"""m_{p} AS (SELECT pattern, min_by(lo + (i + 1 - (c - 0.5) / m) * step, i) AS {p} FROM ({cum})
                  WHERE c >= 0.5 GROUP BY pattern)""")
            else:
                parts.append(f"""n{r}_{p} AS (SELECT pattern,
                  greatest({lo}, any_value(lo) + (count_if(c <= 1e-5) - 1) * any_value(step)) AS lo_{p},
                  least(1.0, any_value(lo) + (count_if(c < 1 - 1e-5) + 2) * any_value(step)) AS hi_{p}
                  FROM ({cum}) GROUP BY pattern)""")
        if r < ROUNDS - 1:
            parts.append(f"box{r + 1} AS (SELECT * FROM pt " + " ".join(f"JOIN n{r}_{p} USING (pattern)" for p in pars) + ")")
    return f"""(
      WITH {", ".join(parts)},
      rep AS (SELECT pattern, CASE WHEN max(n3) > 0 THEN 3 WHEN max(n2) > 0 THEN 2 WHEN max(n1) > 0 THEN 1 ELSE 0 END AS x
              FROM pt GROUP BY pattern)
      SELECT m_psi.pattern, psi, p11, p10, x,
             psi * pow(p11, x) * pow(1 - p11, {K} - x) /
             (psi * pow(p11, x) * pow(1 - p11, {K} - x) + (1 - psi) * pow(p10, x) * pow(1 - p10, {K} - x)) AS prob
      FROM m_psi JOIN m_p11 USING (pattern) JOIN m_p10 USING (pattern) JOIN rep USING (pattern))"""


VIEWS.update({
    "hist": (r"""
      SELECT site, bottle, hash, max(CASE WHEN rep = '1' THEN 1 ELSE 0 END) AS rep_1,
             max(CASE WHEN rep = '2' THEN 1 ELSE 0 END) AS rep_2, max(CASE WHEN rep = '3' THEN 1 ELSE 0 END) AS rep_3,
             max(CASE WHEN rep = '1' THEN 1 ELSE 0 END) + max(CASE WHEN rep = '2' THEN 1 ELSE 0 END)
               + max(CASE WHEN rep = '3' THEN 1 ELSE 0 END) AS detections
      FROM (SELECT DISTINCT split_part(sample, '_', 1) AS site, split_part(sample, '.', 1) AS bottle,
                   regexp_extract(sample, '\.(.*)$', 1) AS rep, hash FROM step3 WHERE n_reads > 0)
      GROUP BY site, bottle, hash""", ["step3"]),
    "pats": ("""
      SELECT h.site, h.hash, nb.nb - (h.n1 + h.n2 + h.n3) AS n0, h.n1, h.n2, h.n3,
             CAST(nb.nb - (h.n1 + h.n2 + h.n3) AS VARCHAR) || '.' || CAST(h.n1 AS VARCHAR) || '.' ||
             CAST(h.n2 AS VARCHAR) || '.' || CAST(h.n3 AS VARCHAR) AS pattern
      FROM (SELECT site, hash, CAST(count_if(detections = 1) AS BIGINT) AS n1, CAST(count_if(detections = 2) AS BIGINT) AS n2,
                   CAST(count_if(detections = 3) AS BIGINT) AS n3 FROM hist GROUP BY site, hash) h
      JOIN (SELECT site, count(*) AS nb FROM (SELECT DISTINCT split_part(sample, '_', 1) AS site,
                                                     split_part(sample, '.', 1) AS bottle FROM step3)
            GROUP BY site) nb ON h.site = nb.site""", ["hist", "step3"]),
    "occfit": (f"SELECT * FROM {_fit_sql(GRID)}", ["pats"]),
    "occfate": ("""
      SELECT p.hash, max(f.prob) AS max FROM pats p JOIN occfit f ON p.pattern = f.pattern GROUP BY p.hash""",
                ["pats", "occfit"]),
})


@query("d12_detection_histories", "SELECT * FROM hist", ("hist",))
def d12(spark, d):
    return hist(spark, d)


@query("d13_presence_pattern", "SELECT * FROM pats", ("pats",))
def d13(spark, d):
    return patterns(spark, d)


@query("d14_pattern_representatives", """
SELECT pattern, n0, n1, n2, n3, hash, site FROM (
  SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY hash, site) AS rn FROM pats) WHERE rn = 1""",
       ("pats",))
def d14(spark, d):
    return O.pattern_representatives(patterns(spark, d))


@query("d15_occupancy_fit", """
SELECT pattern, round(psi, 6) AS psi, round(p11, 6) AS p11, round(p10, 6) AS p10 FROM occfit""", ("occfit",))
def d15(spark, d):
    return round_cols(O.occupancy_fit(patterns(spark, d), K, GRID, rounds=ROUNDS), ["psi", "p11", "p10"])


@query("d16_prob_occupancy", "SELECT pattern, x, round(prob, 6) AS prob FROM occfit", ("occfit",))
def d16(spark, d):
    return round_cols(fit(spark, d).select("pattern", "x", "prob"), "prob")


@query("d17_attempt_summary", "WITH " + ",\n".join(
    f"f{g} AS (SELECT pattern, prob FROM {_fit_sql(g)})" for g in ATTEMPT_GRIDS) + """
SELECT pattern, round((a.prob + b.prob + c.prob) / 3, 6) AS mean,
       round(list_sort([a.prob, b.prob, c.prob])[2], 6) AS median, round(greatest(a.prob, b.prob, c.prob), 6) AS max
""" + "FROM f{} a JOIN f{} b USING (pattern) JOIN f{} c USING (pattern)".format(*ATTEMPT_GRIDS), ("pats",))
def d17(spark, d):
    fits = None
    for g in ATTEMPT_GRIDS:
        f = fit(spark, d, g).select("pattern", F.col("prob").alias(f"fit_{g}"))
        fits = f if fits is None else fits.join(f, "pattern")
    cols = [f"fit_{g}" for g in ATTEMPT_GRIDS]
    out = O.attempt_summary(fits, cols)
    return round_cols(out.select("pattern", "mean", "median", "max"), ["mean", "median", "max"])


@query("d18_broadcast_pattern_result", "SELECT hash, round(max, 6) AS max FROM occfate", ("occfate",))
def d18(spark, d):
    return round_cols(O.broadcast_pattern_result(fit(spark, d), patterns(spark, d), "prob"), "max")


@query("d19_keep_occupied", """
SELECT * FROM step3 WHERE hash IN (SELECT hash FROM occfate WHERE max > 0.8)""", ("step3", "occfate"))
def d19(spark, d):
    fate = O.broadcast_pattern_result(fit(spark, d), patterns(spark, d), "prob")
    return D.keep_occupied(C.step3(spark, d), fate, 0.8)
