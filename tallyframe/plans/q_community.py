"""Registered queries: community tables, transforms and statistics (U3, U5-U9,
U12-U14, U17-U22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import abundance as A
from ..operators import community as U
from ..operators import distance as X
from ..operators import scenario as M
from ..operators._util import round_cols
from . import chain as C
from . import q_scenario as QS
from . import q_taxonomy as QT
from . import views as V
from .oracle_views import VIEWS
from .registry import query


def event_table(spark, d):
    """(event, taxon, edna_index): the planktonic community per event."""
    return QT.planktonic(spark, d)


def event_pairs(spark, d):
    """Bray-Curtis between events, materialised: read by several statistics."""
    return C.materialized(spark, d, "event_pairs",
                          lambda: X.dissimilarity(event_table(spark, d), "event", "taxon", "edna_index"))


def event_groups(spark, d):
    e = event_table(spark, d).select("event").distinct()
    sa = V.env(spark, d).select("site", "area").distinct()
    return (e.withColumn("site", F.substring_index("event", "_", 1)).join(sa, "site")
            .select(F.col("event").alias("sample"), F.col("area").alias("group")))


VIEWS.update({
    "epairs": ("""
      WITH nz AS (SELECT event AS sample, taxon AS hash, edna_index AS v FROM planktonic WHERE edna_index > 0),
      tot AS (SELECT sample, sum(v) AS t FROM nz GROUP BY sample),
      s AS (SELECT l.sample AS a, r.sample AS b, sum(least(l.v, r.v)) AS S
            FROM nz l JOIN nz r ON l.hash = r.hash AND l.sample < r.sample GROUP BY l.sample, r.sample)
      SELECT ta.sample AS sample1, tb.sample AS sample2, 1.0 - 2.0 * coalesce(s.S, 0.0) / (ta.t + tb.t) AS bray
      FROM tot ta JOIN tot tb ON ta.sample < tb.sample LEFT JOIN s ON s.a = ta.sample AND s.b = tb.sample""",
               ["planktonic"]),
    "egroups": ("""
      SELECT DISTINCT p.event AS sample, e.area AS "group" FROM planktonic p
      JOIN (SELECT DISTINCT site, area FROM env) e ON split_part(p.event, '_', 1) = e.site""", ["planktonic", "env"]),
})


@query("u9_permanova", """
WITH lab AS (SELECT * FROM egroups),
pr AS (SELECT * FROM epairs WHERE sample1 IN (SELECT sample FROM lab) AND sample2 IN (SELECT sample FROM lab)),
n AS (SELECT count(*) AS n, count(DISTINCT "group") AS n_groups FROM lab),
sst AS (SELECT sum(bray * bray) AS sd2 FROM pr),
ssw AS (SELECT sum(ss / n_g) AS ss_within FROM (
          SELECT la."group" AS g, sum(bray * bray) AS ss FROM pr JOIN lab la ON pr.sample1 = la.sample
          JOIN lab lb ON pr.sample2 = lb.sample WHERE la."group" = lb."group" GROUP BY 1) s
        JOIN (SELECT "group" AS g, count(*) AS n_g FROM lab GROUP BY 1) z USING (g))
SELECT n, n_groups, round(sd2 / n, 6) AS ss_total, round(ss_within, 6) AS ss_within,
       round(sd2 / n - ss_within, 6) AS ss_between,
       round(((sd2 / n - ss_within) / (n_groups - 1)) / (ss_within / (n - n_groups)), 6) AS F,
       round((sd2 / n - ss_within) / (sd2 / n), 6) AS R2
FROM n, sst, ssw""", ("epairs", "egroups"))
def u9(spark, d):
    r = U.permanova(event_pairs(spark, d), event_groups(spark, d), a="event1", b="event2")
    return round_cols(r, ["ss_total", "ss_within", "ss_between", "F", "R2"])


_PERM_SQL = """
pos AS (SELECT s, g, row_number() OVER (ORDER BY s) AS i FROM lab),
sh AS (SELECT perm, s, row_number() OVER (PARTITION BY perm ORDER BY md5(s || '|' || perm || '|{seed}'), s) AS i
       FROM lab, (SELECT unnest(range(1, {nperm} + 1)) AS perm)),
pl AS MATERIALIZED (SELECT perm, sh.s, pos.g FROM sh JOIN pos USING (i))"""


@query("u9_permanova_p", """
WITH lab AS (SELECT sample AS s, "group" AS g FROM egroups),
pr AS MATERIALIZED (SELECT sample1, sample2, bray * bray AS d2 FROM epairs
                    WHERE sample1 IN (SELECT s FROM lab) AND sample2 IN (SELECT s FROM lab)),
n AS (SELECT count(*) AS n, count(DISTINCT g) AS n_groups FROM lab),
size AS (SELECT g, count(*) AS n_g FROM lab GROUP BY g),
sst AS (SELECT sum(d2) / max(n) AS ss_total FROM pr, n),
obs AS (SELECT sum(ss / n_g) AS ss FROM (SELECT la.g, sum(d2) AS ss FROM pr JOIN lab la ON pr.sample1 = la.s
          JOIN lab lb ON pr.sample2 = lb.s AND la.g = lb.g GROUP BY 1) JOIN size USING (g)),
""" + _PERM_SQL.format(seed=5, nperm=9999) + """,
w AS (SELECT perm, sum(ss / n_g) AS ss FROM (
        SELECT la.perm, la.g, sum(d2) AS ss FROM pl la JOIN pl lb ON la.perm = lb.perm AND la.g = lb.g AND la.s < lb.s
        JOIN pr ON pr.sample1 = la.s AND pr.sample2 = lb.s GROUP BY 1, 2) JOIN size USING (g) GROUP BY perm),
f AS (SELECT (((ss_total - obs.ss) / (n_groups - 1)) / (obs.ss / (n - n_groups))) AS F_obs, (ss_total - obs.ss) / ss_total AS R2
      FROM obs, sst, n)
SELECT round(F_obs, 6) AS F_obs, round(R2, 6) AS R2,
       round((count_if(((ss_total - w.ss) / (n_groups - 1)) / (w.ss / (n - n_groups)) >= F_obs - 1e-12) + 1) / 10000.0, 6)::DOUBLE AS p,
       count(*) AS nperm
FROM w, sst, n, f GROUP BY F_obs, R2""", ("epairs", "egroups"))
def u9p(spark, d):
    return U.permanova_test(event_pairs(spark, d), event_groups(spark, d), nperm=9999, seed=5,
                            a="event1", b="event2")


@query("u12_kmeans_clusters")
def u12(spark, d):
    emb = V.table(spark, d, "embeddings")
    out, _ = U.kmeans_clusters(emb, "embedding", k=10, restarts=15, seed=1)
    return out.select("vec_id", "label", "cluster")


@query("u13_cluster_count_scores")
def u13(spark, d):
    emb = V.table(spark, d, "embeddings")
    return U.cluster_count_scores(emb, "embedding", ks=(1, 2, 3, 4, 5), seed=1, n_ref=2)


def env_clusters(spark, d):
    pts = QS.env_valid(spark, d).select("area", "site", "date", "temperature", "ph")
    return M.predict_class(QS.cluster_coef(spark, d), pts, ["site", "date"])


@query("u14_cluster_profile", """
WITH c AS (SELECT area, site, date, cluster FROM (
  SELECT e.area, e.site, e.date, k.cluster,
         row_number() OVER (PARTITION BY e.area, e.site, e.date
                            ORDER BY k.intercept + k.b_t * e.temperature + k.b_ph * e.ph DESC, k.cluster) AS rn
  FROM env_valid e JOIN cluster_coef k ON e.area = k.area) WHERE rn = 1)
SELECT e.area, c.cluster, count(*) AS n, round_even(avg(e.temperature), 2) AS temperature,
       round_even(avg(e.ph), 2) AS ph
FROM env e JOIN c ON e.area = c.area AND e.site = c.site AND e.date = c.date GROUP BY e.area, c.cluster""",
       ("env", "env_valid", "cluster_coef"))
def u14(spark, d):
    cl = env_clusters(spark, d)
    return U.cluster_profile(V.env(spark, d), cl, ["area", "site", "date"], ["temperature", "ph"])


@query("u17_top_k_signed", """
WITH g AS (SELECT area, taxon, avg(CASE WHEN year(date) = 1995 THEN p END) AS ava,
                  avg(CASE WHEN year(date) = 2001 THEN p END) AS avb FROM score GROUP BY area, taxon),
h AS (SELECT area, taxon, '1995_2001' AS comparison, abs(ava - avb) AS average, ava > avb AS direction
      FROM g WHERE ava IS NOT NULL AND avb IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY area, comparison, direction ORDER BY round(average * 1e12) DESC, taxon) AS rn FROM h)
SELECT area, taxon, comparison, round(average, 6) AS average, direction,
       round(CASE WHEN direction THEN average ELSE -average END, 6) AS signed
FROM r WHERE rn <= 5""", ("score",))
def u17(spark, d):
    s = QS.scores(spark, d).withColumn("year", F.year("date"))
    g = s.groupBy("area", "taxon").agg(F.avg(F.when(F.col("year") == 1995, F.col("p"))).alias("ava"),
                                       F.avg(F.when(F.col("year") == 2001, F.col("p"))).alias("avb"))
    g = g.where(F.col("ava").isNotNull() & F.col("avb").isNotNull())
    g = g.withColumn("comparison", U.canonical_pair(F.lit("2001"), F.lit("1995")))
    g = g.withColumn("average", F.abs(F.col("ava") - F.col("avb")))
    r = U.top_k_signed(g, ["area", "comparison"], "average", F.col("ava") > F.col("avb"), k=5, tie="taxon")
    return round_cols(r.select("area", "taxon", "comparison", "average", "direction", "signed"), ["average", "signed"])


@query("u18_richness", """
SELECT event, phylum, richness, CAST(sum(richness) OVER (PARTITION BY event) AS BIGINT) AS total FROM (
  SELECT split_part(split_part(s.sample, '.', 1), '_', 1) || '_' ||
         left(split_part(split_part(s.sample, '.', 1), '_', 2), length(split_part(split_part(s.sample, '.', 1), '_', 2)) - 1) AS event,
         t.phylum, count(DISTINCT s.hash) AS richness
  FROM step4 s JOIN taxonomy t ON s.hash = t.hash GROUP BY 1, 2)""", ("step4", "taxonomy"))
def u18(spark, d):
    r = K.with_sample_parts(C.step4(spark, d), parts=("event",)).join(V.taxonomy(spark, d).select("hash", "phylum"), "hash")
    return U.richness(r, "event", "phylum", "hash")


@query("u19_env_long", """
SELECT site, date, area, strftime(date, '%b') AS month, variable, value FROM (
  SELECT DISTINCT site, date, area, temperature, ph, salinity FROM env WHERE ph IS NOT NULL)
UNPIVOT (value FOR variable IN (temperature, ph, salinity))""", ("env",))
def u19(spark, d):
    return U.env_long(V.env(spark, d), ["site", "date", "area"], ["temperature", "ph", "salinity"],
                      valid=F.col("ph").isNotNull())


_BOX_SQL = """
WITH t AS (SELECT split_part(sample, '_', 1) AS site, CAST(sum(n_reads) AS BIGINT) AS tot FROM step4 GROUP BY sample),
q AS (SELECT site, min(tot) AS min, quantile_cont(tot, 0.25) AS q1, median(tot) AS median,
             quantile_cont(tot, 0.75) AS q3, max(tot) AS max FROM t GROUP BY site)
SELECT q.site, q.min, q.q1, q.median, q.q3, q.max,
       min(CASE WHEN t.tot >= q.q1 - 1.5 * (q.q3 - q.q1) THEN t.tot END) AS whisker_lo,
       max(CASE WHEN t.tot <= q.q3 + 1.5 * (q.q3 - q.q1) THEN t.tot END) AS whisker_hi,
       CAST(count_if(t.tot < q.q1 - 1.5 * (q.q3 - q.q1) OR t.tot > q.q3 + 1.5 * (q.q3 - q.q1)) AS BIGINT) AS n_outliers
FROM t JOIN q ON t.site = q.site GROUP BY q.site, q.min, q.q1, q.median, q.q3, q.max"""


@query("u20_box_stats", _BOX_SQL, ("step4",))
def u20(spark, d):
    t = C.step4(spark, d).groupBy("sample").agg(F.sum("n_reads").alias("tot"))
    t = t.withColumn("site", F.substring_index("sample", "_", 1))
    return U.box_stats(t, "site", "tot")


@query("u21_histogram", """
SELECT bin, count, lo, count / max(count) OVER () AS ndensity FROM (
  SELECT CAST(floor((distance - 0.0) / 0.05) AS BIGINT) AS bin, count(*) AS count,
         CAST(0.0 + CAST(floor((distance - 0.0) / 0.05) AS BIGINT) * 0.05 AS DOUBLE) AS lo
  FROM centroid WHERE distance IS NOT NULL GROUP BY 1)""", ("centroid",))
def u21(spark, d):
    return U.histogram(C.centroid_distances(spark, d), "distance", 0.05)


@query("u22_shared_taxa", """
WITH x AS (SELECT t.family, split_part(s.sample, '_', 1) AS site, e.area
           FROM step4 s JOIN taxonomy t ON s.hash = t.hash
           JOIN (SELECT DISTINCT site, area FROM env) e ON split_part(s.sample, '_', 1) = e.site)
SELECT family, count(DISTINCT site) AS n_sites, count(DISTINCT area) AS n_areas,
       count(DISTINCT area) = (SELECT count(DISTINCT area) FROM x) AS in_all_areas,
       count(DISTINCT area) = 1 AS in_one_area
FROM x GROUP BY family""", ("step4", "taxonomy", "env"))
def u22(spark, d):
    s = C.step4(spark, d).join(V.taxonomy(spark, d).select("hash", "family"), "hash")
    s = s.withColumn("site", F.substring_index("sample", "_", 1))
    s = s.join(V.env(spark, d).select("site", "area").distinct(), "site")
    return U.shared_taxa(s, "family", "site", "area")


# ---- community matrix and transforms -------------------------------------------------

@query("u3_densify", """
SELECT e.event, t.taxon, coalesce(p.edna_index, 0.0) AS edna_index
FROM (SELECT DISTINCT event FROM planktonic) e CROSS JOIN (SELECT DISTINCT taxon FROM planktonic) t
LEFT JOIN planktonic p ON p.event = e.event AND p.taxon = t.taxon""", ("planktonic",))
def u3(spark, d):
    x = event_table(spark, d)
    return round_cols(A.densify(x, "event", "taxon", "edna_index"), "edna_index")


@query("u3_community_matrix_wide")
def u3w(spark, d):
    return A.community_matrix(event_table(spark, d), "event", "taxon", "edna_index")


def _tr(spark, d, methods):
    x = event_table(spark, d).select("event", "taxon", "edna_index")
    for m in methods:
        x = A.transform(x, m, "event", "taxon", "edna_index", out=m.replace(".", "_"))
    return round_cols(x.drop("edna_index"), [m.replace(".", "_") for m in methods])


@query("u5_transform_by_sample", """
SELECT event, taxon,
  round(edna_index / sum(edna_index) OVER (PARTITION BY event), 6) AS total,
  round(edna_index / sqrt(sum(edna_index * edna_index) OVER (PARTITION BY event)), 6) AS normalize,
  round(sqrt(edna_index / sum(edna_index) OVER (PARTITION BY event)), 6) AS hellinger,
  CAST(CASE WHEN edna_index > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS pa,
  round(sqrt(edna_index), 6) AS sqrt
FROM planktonic""", ("planktonic",))
def u5(spark, d):
    return _tr(spark, d, ["total", "normalize", "hellinger", "pa", "sqrt"])


@query("u6_transform_by_taxon", """
WITH n AS (SELECT count(DISTINCT event) AS ns FROM planktonic),
x AS (SELECT *, max(edna_index) OVER w AS mx, min(edna_index) OVER w AS mn, count(*) OVER w AS c,
             sum(edna_index) OVER w AS s, count_if(edna_index > 0) OVER w AS k
      FROM planktonic WINDOW w AS (PARTITION BY taxon))
SELECT event, taxon, round(edna_index / mx, 6) AS max, round(edna_index / s * k, 6) AS frequency,
  round(CASE WHEN mx - (CASE WHEN c < ns THEN least(mn, 0) ELSE mn END) > 0
             THEN (edna_index - (CASE WHEN c < ns THEN least(mn, 0) ELSE mn END))
                  / (mx - (CASE WHEN c < ns THEN least(mn, 0) ELSE mn END)) ELSE 0.0 END, 6) AS range
FROM x, n""", ("planktonic",))
def u6(spark, d):
    return _tr(spark, d, ["max", "frequency", "range"])


@query("u6_standardize", """
WITH g AS (SELECT e.event, t.taxon, coalesce(p.edna_index, 0.0) AS v
           FROM (SELECT DISTINCT event FROM planktonic) e CROSS JOIN (SELECT DISTINCT taxon FROM planktonic) t
           LEFT JOIN planktonic p ON p.event = e.event AND p.taxon = t.taxon)
SELECT event, taxon, round((v - avg(v) OVER (PARTITION BY taxon)) / stddev_samp(v) OVER (PARTITION BY taxon), 6)
       AS standardize FROM g""", ("planktonic",))
def u6s(spark, d):
    return _tr(spark, d, ["standardize"])


@query("u7_rank_transform", """
WITH r AS (SELECT event, taxon, rank() OVER (PARTITION BY event ORDER BY edna_index)
                  + (count(*) OVER (PARTITION BY event, edna_index) - 1) / 2.0 AS rk
           FROM planktonic WHERE edna_index > 0)
SELECT event, taxon, round(rk, 6) AS rank, round(rk / max(rk) OVER (PARTITION BY event), 6) AS rrank FROM r""",
       ("planktonic",))
def u7(spark, d):
    x = event_table(spark, d).select("event", "taxon", "edna_index")
    r = A.transform(x, "rank", "event", "taxon", "edna_index", out="rank")
    rr = A.transform(x, "rrank", "event", "taxon", "edna_index", out="rrank").select("event", "taxon", "rrank")
    return round_cols(r.drop("edna_index").join(rr, ["event", "taxon"]), ["rank", "rrank"])


@query("u8_chi_square_log", """
SELECT event, taxon,
  round(sqrt(sum(edna_index) OVER ()) * edna_index
        / (sum(edna_index) OVER (PARTITION BY event) * sqrt(sum(edna_index) OVER (PARTITION BY taxon))), 6) AS chi_square,
  round(CASE WHEN edna_index > 0 THEN log2(edna_index) + 1 ELSE 0.0 END, 6) AS log
FROM planktonic""", ("planktonic",))
def u8(spark, d):
    return _tr(spark, d, ["chi.square", "log"])


# ---- constrained ordination ------------------------------------------------------------

ORD_TERMS = ["temperature", "ph", "salinity"]


def event_env(spark, d):
    """(sample = event, temperature, ph, salinity) for events with complete data."""
    ev = event_table(spark, d).select("event").distinct()
    j = M.join_environment(ev, V.env(spark, d)).where(F.col("area").isNotNull())
    return j.select(F.col("event").alias("sample"), *ORD_TERMS).na.drop()


_ZSQL = """
ev AS (SELECT DISTINCT event FROM planktonic),
e AS (SELECT ev.event AS s, env.temperature, env.ph, env.salinity FROM ev JOIN env
        ON split_part(ev.event, '_', 1) = env.site
       AND strptime(split_part(ev.event, '_', 2) || '01', '%Y%m%d')::DATE = env.date
      WHERE env.temperature IS NOT NULL AND env.ph IS NOT NULL AND env.salinity IS NOT NULL AND env.area IS NOT NULL),
z AS (SELECT s, """ + ", ".join(
    f"CASE WHEN coalesce(stddev_samp({t}) OVER (), 0) = 0 THEN {t} ELSE ({t} - avg({t}) OVER ()) / stddev_samp({t}) OVER () END AS {t}"
    for t in ORD_TERMS) + """ FROM e),
j AS (SELECT p.bray * p.bray AS d2, """ + ", ".join(f"za.{t} AS a_{t}, zb.{t} AS b_{t}" for t in ORD_TERMS) + """
      FROM epairs p JOIN z za ON p.sample1 = za.s JOIN z zb ON p.sample2 = zb.s),
tot AS (SELECT sum(d2) / (SELECT count(*) FROM z) AS total_inertia, (SELECT count(*) FROM z) AS n FROM j)
"""


@query("u10_constraint_moments", "WITH " + _ZSQL + " SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{t1}' AS term_a, '{t2}' AS term_b,
        round((SELECT sum(-0.5 * d2 * (a_{t1} * b_{t2} + a_{t2} * b_{t1})) FROM j), 6) AS m,
        round((SELECT sum({t1} * {t2}) FROM z), 6) AS c,
        round((SELECT total_inertia FROM tot), 6) AS total_inertia, (SELECT n FROM tot) AS n"""
    for t1 in ORD_TERMS for t2 in ORD_TERMS) + ")", ("epairs", "planktonic", "env"))
def u10m(spark, d):
    r = U.constraint_moments(event_pairs(spark, d), event_env(spark, d), ORD_TERMS,
                             a="event1", b="event2")
    return round_cols(r, ["m", "c", "total_inertia"])


@query("u10_ordination_eigen")
def u10e(spark, d):
    eig, _, _ = U.constrained_ordination(event_pairs(spark, d), event_env(spark, d), ORD_TERMS,
                                         a="event1", b="event2")
    return eig


@query("u10_site_scores")
def u10s(spark, d):
    _, scores, _ = U.constrained_ordination(event_pairs(spark, d), event_env(spark, d), ORD_TERMS,
                                            a="event1", b="event2")
    return scores


@query("u10_biplot_scores")
def u10b(spark, d):
    _, _, bp = U.constrained_ordination(event_pairs(spark, d), event_env(spark, d), ORD_TERMS,
                                        a="event1", b="event2")
    return bp


@query("u11_ordination_test", "WITH " + _ZSQL + """,
c AS (SELECT sum(temperature * temperature) AS a, sum(temperature * ph) AS b, sum(temperature * salinity) AS c,
             sum(ph * ph) AS d, sum(ph * salinity) AS e, sum(salinity * salinity) AS f FROM z),
i AS (SELECT (d * f - e * e) / det AS i11, (c * e - b * f) / det AS i12, (b * e - c * d) / det AS i13,
             (a * f - c * c) / det AS i22, (b * c - a * e) / det AS i23, (a * d - b * b) / det AS i33
      FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM c)),
lab AS (SELECT s, s AS g FROM z),
""" + _PERM_SQL.format(seed=2, nperm=999) + """,
who AS (SELECT 0 AS perm, s, s AS g FROM z UNION ALL SELECT * FROM pl),
v AS MATERIALIZED (SELECT perm, who.s, z.temperature AS t, z.ph AS p, z.salinity AS q,
                          i11 * z.temperature + i12 * z.ph + i13 * z.salinity AS t2, i12 * z.temperature + i22 * z.ph + i23 * z.salinity AS p2,
                          i13 * z.temperature + i23 * z.ph + i33 * z.salinity AS q2 FROM who JOIN z ON z.s = who.g, i),
pr AS MATERIALIZED (SELECT sample1, sample2, bray * bray AS d2 FROM epairs WHERE sample1 IN (SELECT s FROM z) AND sample2 IN (SELECT s FROM z)),
con AS (SELECT va.perm, -sum(d2 * (va.t2 * vb.t + va.p2 * vb.p + va.q2 * vb.q)) AS con
        FROM pr JOIN v va ON va.s = pr.sample1 JOIN v vb ON vb.s = pr.sample2 AND vb.perm = va.perm GROUP BY va.perm),
f AS (SELECT perm, con, total_inertia AS total, (con / 3) / ((total_inertia - con) / (n - 4)) AS F FROM con, tot)
SELECT round(o.F, 6) AS F, round(o.con, 6) AS constrained, round(o.total, 6) AS total,
       round((count_if(f.F >= o.F - 1e-12) + 1) / 1000.0, 6)::DOUBLE AS p, count(*) AS nperm
FROM f, (SELECT * FROM f WHERE perm = 0) o WHERE f.perm > 0 GROUP BY o.F, o.con, o.total""", ("epairs", "planktonic", "env"))
def u11(spark, d):
    return U.ordination_test(event_pairs(spark, d), event_env(spark, d), ORD_TERMS, nperm=999, seed=2,
                             a="event1", b="event2")


# ---- SIMPER -------------------------------------------------------------------------

def event_clusters(spark, d):
    """(event, area, cluster) from the environment-based class of each event."""
    ev = event_table(spark, d).select("event").distinct()
    j = M.join_environment(ev, V.env(spark, d)).where(F.col("area").isNotNull())
    cl = env_clusters(spark, d)
    return j.join(cl, ["area", "site", "date"]).select("event", "area", F.col("cluster").cast("string").alias("cluster"))


@query("u15_simper", """
WITH ev AS (SELECT event, taxon, edna_index AS v FROM planktonic WHERE edna_index > 0),
cc AS (SELECT area, site, date, cluster FROM (
  SELECT e.area, e.site, e.date, k.cluster,
         row_number() OVER (PARTITION BY e.area, e.site, e.date
                            ORDER BY k.intercept + k.b_t * e.temperature + k.b_ph * e.ph DESC, k.cluster) AS rn
  FROM env_valid e JOIN cluster_coef k ON e.area = k.area) WHERE rn = 1),
cl AS (SELECT DISTINCT x.event, c.area, CAST(c.cluster AS VARCHAR) AS cluster FROM (SELECT DISTINCT event FROM planktonic) x
       JOIN cc c ON split_part(x.event, '_', 1) = c.site
        AND strptime(split_part(x.event, '_', 2) || '01', '%Y%m%d')::DATE = c.date),
tot AS (SELECT event, sum(v) AS t FROM ev GROUP BY event),
n AS (SELECT area, cluster, count(*) AS n FROM cl GROUP BY area, cluster),
pr AS (SELECT a.area, a.cluster AS ga, b.cluster AS gb, a.event AS ea, b.event AS eb, 1.0 / (ta.t + tb.t) AS w
       FROM cl a JOIN cl b ON a.area = b.area AND a.cluster < b.cluster
       JOIN tot ta ON ta.event = a.event JOIN tot tb ON tb.event = b.event),
tx AS (SELECT DISTINCT p.area, p.ga, p.gb, e.taxon FROM pr p JOIN ev e ON e.event = p.ea OR e.event = p.eb),
c AS (SELECT p.area, p.ga, p.gb, t.taxon, abs(coalesce(xa.v, 0) - coalesce(xb.v, 0)) * p.w AS c
      FROM pr p JOIN tx t ON t.area = p.area AND t.ga = p.ga AND t.gb = p.gb
      LEFT JOIN ev xa ON xa.event = p.ea AND xa.taxon = t.taxon
      LEFT JOIN ev xb ON xb.event = p.eb AND xb.taxon = t.taxon),
s AS (SELECT area, ga, gb, taxon, avg(c) AS average, stddev_samp(c) AS sd FROM c GROUP BY 1, 2, 3, 4),
m AS (SELECT cl.area, cl.cluster, ev.taxon, sum(ev.v) AS sv FROM ev JOIN cl ON ev.event = cl.event GROUP BY 1, 2, 3)
SELECT s.area AS by, s.ga || '_' || s.gb AS comparison, s.taxon, round(s.average, 6) AS average, round(s.sd, 6) AS sd,
       round(s.average / s.sd, 6) AS ratio,
       round(coalesce(ma.sv, 0) / na.n, 6) AS ava, round(coalesce(mb.sv, 0) / nb.n, 6) AS avb,
       round(sum(s.average) OVER (PARTITION BY s.area, s.ga, s.gb ORDER BY round(s.average * 1e12) DESC, s.taxon
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / sum(s.average) OVER (PARTITION BY s.area, s.ga, s.gb), 6) AS cusum
FROM s JOIN n na ON na.area = s.area AND na.cluster = s.ga JOIN n nb ON nb.area = s.area AND nb.cluster = s.gb
LEFT JOIN m ma ON ma.area = s.area AND ma.cluster = s.ga AND ma.taxon = s.taxon
LEFT JOIN m mb ON mb.area = s.area AND mb.cluster = s.gb AND mb.taxon = s.taxon""",
       ("planktonic", "env_valid", "cluster_coef"))
def u15(spark, d):
    r = U.simper(event_table(spark, d), event_clusters(spark, d), "event", "taxon", "edna_index", "cluster", "area")
    return round_cols(r, ["average", "sd", "ratio", "ava", "avb", "cusum"])


@query("u16_simper_permutation_p")
def u16(spark, d):
    return U.simper_permutation_p(event_table(spark, d), event_clusters(spark, d), nperm=999, seed=4,
                                  sample="event", taxon="taxon", value="edna_index", group="cluster", by="area")


@query("u3_sample_attributes", """
SELECT DISTINCT event, split_part(event, '_', 1) AS site, split_part(event, '_', 2) AS yyyymm FROM planktonic""",
       ("planktonic",))
def u3a(spark, d):
    x = event_table(spark, d).withColumn("site", F.substring_index("event", "_", 1)) \
        .withColumn("yyyymm", F.regexp_extract("event", r"_(.*)$", 1))
    return A.sample_attributes(x, "event", ["site", "yyyymm"])
