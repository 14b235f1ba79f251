"""Registered queries: scenarios, projections and tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import scenario as M
from ..operators._util import round_cols
from . import chain as C
from . import q_taxonomy as QT
from . import views as V
from .oracle_views import VIEWS
from .registry import query

AREAS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
YEARS = [2017, 2050, 2095]
PH_MIN = 7.4

VIEWS.update({
    "env_valid": (f"SELECT * FROM env WHERE ph > {PH_MIN}", ["env"]),
    "score": ("""
      SELECT c.taxon, c.area, e.site, e.date, e.temperature, e.ph,
             1.0 / (1.0 + exp(-(c.intercept + c.b_t * e.temperature + c.b_ph * e.ph))) AS p
      FROM coef c JOIN env_valid e ON c.area = e.area""", ["coef", "env_valid"]),
    "grid": ("""
      WITH r AS (SELECT area, CAST(round(round_even(min(temperature), 1) * 10) AS BIGINT) AS tlo,
                        CAST(round(round_even(max(temperature), 1) * 10) AS BIGINT) AS thi,
                        CAST(round(round_even(min(ph), 1) * 10) AS BIGINT) AS plo,
                        CAST(round(round_even(max(ph), 1) * 10) AS BIGINT) AS phi
                 FROM env_valid GROUP BY area),
      t AS (SELECT area, unnest(generate_series(tlo, thi)) AS ti, plo, phi FROM r)
      SELECT area, ti / 10.0 AS temperature, unnest(generate_series(plo, phi)) / 10.0 AS ph FROM t""",
             ["env_valid"]),
    "cluster_coef": ("""
      SELECT area, k AS cluster, k * 0.1 AS intercept, (k - 2) * length(area) / 10.0 AS b_t, (2 - k) * 0.5 AS b_ph
      FROM (SELECT DISTINCT area FROM env_valid), (SELECT unnest([1, 2, 3]) AS k)""", ["env_valid"]),
    "predicted": ("""
      SELECT area, temperature, ph, cluster FROM (
        SELECT g.area, g.temperature, g.ph, c.cluster,
               row_number() OVER (PARTITION BY g.area, g.temperature, g.ph
                                  ORDER BY c.intercept + c.b_t * g.temperature + c.b_ph * g.ph DESC, c.cluster) AS rn
        FROM grid g JOIN cluster_coef c ON g.area = c.area) WHERE rn = 1""", ["grid", "cluster_coef"]),
})


def env_valid(spark, d):
    return V.env(spark, d).where(F.col("ph") > PH_MIN)


def scores(spark, d):
    return M.score_taxa(V.coef(spark, d), env_valid(spark, d).select("area", "site", "date", "temperature", "ph"))


def grid(spark, d):
    return M.range_grid(env_valid(spark, d), "area", "temperature", "ph", 0.1)


def cluster_coef(spark, d):
    areas = env_valid(spark, d).select("area").distinct()
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("cluster")
    c = areas.select("area", k)
    return c.select("area", "cluster", (F.col("cluster") * 0.1).alias("intercept"),
                    ((F.col("cluster") - 2) * F.length("area") / 10.0).alias("b_t"),
                    ((2 - F.col("cluster")) * 0.5).alias("b_ph"))


def predicted(spark, d):
    return M.predict_class(cluster_coef(spark, d), grid(spark, d), ["temperature", "ph"])


@query("m1_standardize_by_area", """
SELECT site, date, area,
  CASE WHEN coalesce(stddev_samp(temperature) OVER w, 0) = 0 THEN temperature
       ELSE (temperature - avg(temperature) OVER w) / stddev_samp(temperature) OVER w END AS temperature_std,
  CASE WHEN coalesce(stddev_samp(ph) OVER w, 0) = 0 THEN ph
       ELSE (ph - avg(ph) OVER w) / stddev_samp(ph) OVER w END AS ph_std
FROM env WINDOW w AS (PARTITION BY area)""", ("env",))
def m1(spark, d):
    r = M.standardize_by(V.env(spark, d), ["temperature", "ph"], "area")
    return round_cols(r.select("site", "date", "area", "temperature_std", "ph_std"), ["temperature_std", "ph_std"])


V_M1_ALL = """
SELECT site, date, area, (salinity - avg(salinity) OVER ()) / stddev_samp(salinity) OVER () AS salinity_std FROM env"""


@query("m1_standardize_all", V_M1_ALL, ("env",))
def m1b(spark, d):
    r = M.standardize_by(V.env(spark, d), ["salinity"])
    return round_cols(r.select("site", "date", "area", "salinity_std"), "salinity_std")


@query("m2_to_from_std", """
WITH c AS (SELECT area, avg(temperature) AS m, stddev_samp(temperature) AS s FROM env_valid GROUP BY area)
SELECT e.site, e.date, e.area, (e.temperature - c.m) / c.s AS temperature_std,
       ((e.temperature - c.m) / c.s) * c.s + c.m AS temperature_back
FROM env e LEFT JOIN c ON e.area = c.area""", ("env", "env_valid"))
def m2(spark, d):
    cons = M.std_constants(env_valid(spark, d), ["temperature", "ph"], "area")
    e = M.to_std(V.env(spark, d), cons, "temperature", "temperature", "area")
    e = M.from_std(e, cons, "temperature_std", "temperature", "area", out="temperature_back")
    return round_cols(e.select("site", "date", "area", "temperature_std", "temperature_back"),
                      ["temperature_std", "temperature_back"])


EXCLUDE_TAXA = r"Brand#2\|"

VIEWS.update({
    "presence": (f"""
      WITH x AS (SELECT * FROM planktonic WHERE NOT regexp_matches(taxon, '{EXCLUDE_TAXA}'))
      SELECT t.taxon, e.event, CAST(CASE WHEN p.event IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS presence
      FROM (SELECT DISTINCT taxon FROM x) t CROSS JOIN (SELECT DISTINCT event FROM x) e
      LEFT JOIN (SELECT DISTINCT event, taxon FROM x WHERE edna_index > 0) p
        ON p.event = e.event AND p.taxon = t.taxon""", ["planktonic"]),
    "prevalent": ("""
      SELECT * FROM presence WHERE taxon IN (
        SELECT taxon FROM presence GROUP BY taxon HAVING sum(presence) > 7 AND sum(presence) < 69)""",
                  ["presence"]),
})


def presence_table(spark, d):
    """The sparse presence table, built once: read by M3 to M6 and the models."""
    key = (spark.sparkContext.applicationId, d, "presence_table")
    if key not in C._MEMO:
        C._MEMO[key] = M.presence_table(QT.planktonic(spark, d), "event", "taxon", "edna_index", exclude=EXCLUDE_TAXA)
    return C._MEMO[key]


def presence(spark, d):
    return presence_table(spark, d).dense().select("taxon", "event", "presence")


@query("m3_presence_matrix", "SELECT * FROM presence", ("presence",))
def m3(spark, d):
    return presence(spark, d)


@query("m4_prevalence_filter", "SELECT * FROM prevalent", ("prevalent",))
def m4(spark, d):
    return presence_table(spark, d).prevalent(7, 69).dense().select("taxon", "event", "presence")


@query("m5_dense_index", """
SELECT taxon, event, presence, CAST(dense_rank() OVER (ORDER BY taxon) AS INTEGER) AS taxon_id,
       CAST(dense_rank() OVER (ORDER BY event) AS INTEGER) AS event_id,
       row_number() OVER (ORDER BY taxon, event) AS row FROM prevalent""", ("prevalent",))
def m5(spark, d):
    t = presence_table(spark, d).prevalent(7, 69).coded("event_id", "taxon_id")
    r = t.dense().select("taxon", "event", "presence", "taxon_id", "event_id")
    # the matrix is complete, so the row number by (taxon, event) follows from the codes
    n = t.rows.select(F.count(F.lit(1))).scalar()
    return r.withColumn("row", (F.col("taxon_id") - 1) * n + F.col("event_id"))


@query("m6_sample_groups", """
SELECT * FROM presence WHERE taxon IN (
  SELECT taxon FROM (SELECT DISTINCT taxon FROM presence) ORDER BY md5(taxon || '|7'), taxon LIMIT 25)""", ("presence",))
def m6(spark, d):
    t = presence_table(spark, d)
    return t.keep_cols(M.sampled_keys(t.cols, "taxon", 25, seed=7)).dense().select("taxon", "event", "presence")


@query("m9_score_taxa", """
SELECT taxon, area, site, date, round(p, 6) AS p FROM score""", ("score",))
def m9(spark, d):
    return round_cols(scores(spark, d).select("taxon", "area", "site", "date", "p"), "p")


def uniform_sql(*parts) -> str:
    """``md5_uniform`` of SQL expressions."""
    said = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((('0x' || substr(md5({said}), 1, 13))::BIGINT + 0.5) / {float(1 << 52)})"


def normal_sql(*parts) -> str:
    return f"(sqrt(-2.0 * ln({uniform_sql(*parts, _q('u1'))})) * cos({2 * math.pi!r} * {uniform_sql(*parts, _q('u2'))}))"


def _q(x: str) -> str:
    return f"'{x}'"


def binomial_sql(rows: str, p: str, u: str, n: int) -> str:
    """``rows`` with k, the successes of ``n`` trials: the terms of the distribution one by one,
    a row leaving when its place is reached."""
    return f"""
WITH RECURSIVE b0 AS (SELECT *, {u} AS u__, CASE WHEN {p} <= 0.5 THEN {p} ELSE 1.0 - {p} END AS q__ FROM ({rows})),
b AS (SELECT *, q__ / (1.0 - q__) AS r__, pow(1.0 - q__, {n}) AS t__, pow(1.0 - q__, {n}) AS b__, 0 AS j__ FROM b0
      UNION ALL
      SELECT * REPLACE (t__ * (({n} - j__) / (j__ + 1)::DOUBLE) * r__ AS t__, b__ + t__ * (({n} - j__) / (j__ + 1)::DOUBLE) * r__ AS b__,
                        j__ + 1 AS j__) FROM b WHERE b__ < u__ AND j__ < {n})
SELECT * EXCLUDE (u__, q__, r__, t__, b__, j__), CASE WHEN {p} <= 0.5 THEN j__ ELSE {n} - j__ END AS k
FROM b WHERE b__ >= u__ OR j__ = {n}"""


@query("m10_bernoulli_mean", "SELECT taxon, area, site, date, p, k / 100.0 AS mean_presence FROM (" + binomial_sql(
    "SELECT taxon, area, site, date, p FROM score", "p", uniform_sql("taxon", "site", "date", "11"), 100) + ")", ("score",))
def m10(spark, d):
    s = scores(spark, d).select("taxon", "area", "site", "date", "p")
    return round_cols(M.binomial_mean(s, "p", ["taxon", "site", "date"], n=100, seed=11), ["p", "mean_presence"])


_TSD = M.trend_sd(M.PH_TREND)


@query("m11_scenario_params", f"""
SELECT area, year,
       round(t_obs + (year - {M.TREND_START}) / {float(M.TREND_END - M.TREND_START)} * {M.T_TREND}, 6) AS t_mean,
       round(t_sd, 6) AS t_sd,
       round(ph_obs + (year - {M.TREND_START}) / {float(M.TREND_END - M.TREND_START)} * ({M.PH_TREND}), 6) AS ph_mean,
       round(ph_sd0 + {_TSD!r}, 6) AS ph_sd
FROM (SELECT area, avg(temperature) AS t_obs, stddev_pop(temperature) AS t_sd, avg(ph) AS ph_obs,
             stddev_pop(ph) AS ph_sd0 FROM env_valid GROUP BY area),
     (SELECT unnest([2017, 2050, 2095]) AS year)""", ("env_valid",))
def m11(spark, d):
    r = M.scenario_params(env_valid(spark, d), YEARS)
    return round_cols(r, ["t_mean", "t_sd", "ph_mean", "ph_sd"])


VIEWS.update({
    "params": (f"""
      SELECT area, year, t_obs + (year - {M.TREND_START}) / {float(M.TREND_END - M.TREND_START)} * {M.T_TREND} AS t_mean, t_sd,
             ph_obs + (year - {M.TREND_START}) / {float(M.TREND_END - M.TREND_START)} * ({M.PH_TREND}) AS ph_mean, ph_sd0 + {_TSD!r} AS ph_sd
      FROM (SELECT area, avg(temperature) AS t_obs, stddev_pop(temperature) AS t_sd, avg(ph) AS ph_obs, stddev_pop(ph) AS ph_sd0
            FROM env_valid GROUP BY area), (SELECT unnest([2017, 2050, 2095])::INTEGER AS year)""", ["env_valid"]),
})


def draws_sql(seed: int) -> str:
    key = ("area", "year", "draw", str(seed))
    return f"""
SELECT area, year, draw, t_mean + t_sd * {normal_sql(*key, _q('t'))} AS temperature, ph_mean + ph_sd * {normal_sql(*key, _q('ph'))} AS ph
FROM params, (SELECT unnest(range(1, 1001))::INTEGER AS draw)"""


@query("m12_scenario_draws", draws_sql(3), ("params",))
def m12(spark, d):
    return M.scenario_draws(M.scenario_params(env_valid(spark, d), YEARS), 1000, seed=3)


@query("m12_scenario_draws_std", "SELECT d.area, d.year, d.draw, (d.temperature - r.t_mean) / r.t_sd AS temperature, "
       "(d.ph - r.ph_mean) / r.ph_sd AS ph FROM (" + draws_sql(3) + ") d JOIN params r ON r.area = d.area AND r.year = 2017", ("params",))
def m12b(spark, d):
    return M.scenario_draws(M.scenario_params(env_valid(spark, d), YEARS), 1000, seed=3, ref_year=2017)


RELABEL = {1996: 2001, 1997: 2001, 1998: 2001, 1999: 2001, 2000: 2001}


@query("m13_trim_tails", f"""
WITH y AS (SELECT site, date, area, temperature, ph,
                  CAST(CASE WHEN year(date) BETWEEN 1996 AND 2000 THEN 2001 ELSE year(date) END AS INTEGER) AS year
           FROM env),
f AS (SELECT *, avg(temperature) OVER w AS mt, stddev_pop(temperature) OVER w AS st,
             avg(ph) OVER w AS mp, stddev_pop(ph) OVER w AS sp FROM y WINDOW w AS (PARTITION BY year, area))
SELECT site, date, area, year FROM f
WHERE temperature >= mt + ({M.norm_ppf(0.03)!r}) * st AND temperature <= mt + {M.norm_ppf(0.98)!r} * st
  AND ph >= mp + ({M.norm_ppf(0.03)!r}) * sp AND ph <= mp + {M.norm_ppf(0.98)!r} * sp""", ("env",))
def m13(spark, d):
    e = V.env(spark, d).withColumn("year", F.year("date"))
    return M.trim_tails(e, relabel=RELABEL).select("site", "date", "area", "year")


@query("m14_range_grid", "SELECT area, temperature, ph FROM grid", ("grid",))
def m14(spark, d):
    return grid(spark, d)


@query("m15_group_ranges", """
SELECT area, min(temperature) AS temperature_min, max(temperature) AS temperature_max,
       min(ph) AS ph_min, max(ph) AS ph_max FROM env_valid GROUP BY area""", ("env_valid",))
def m15(spark, d):
    return M.group_ranges(env_valid(spark, d), "area", ["temperature", "ph"])


@query("m17_predict_cluster", "SELECT * FROM predicted", ("predicted",))
def m17(spark, d):
    return predicted(spark, d)


@query("m18_cluster_prevalence", """
SELECT area, cluster, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY area) AS share
FROM predicted GROUP BY area, cluster""", ("predicted",))
def m18(spark, d):
    return M.class_prevalence(predicted(spark, d), "area", "cluster")


CLASSES = [1, 2, 3]  # the classes of the cluster coefficient table


@query("m18_cluster_prevalence_wide", """
SELECT area, """ + ", ".join(
    f"coalesce(max(CASE WHEN cluster = {k} THEN share END), 0.0) AS \"{k}\"" for k in CLASSES) + """
FROM (SELECT area, cluster, count(*) / sum(count(*)) OVER (PARTITION BY area) AS share
      FROM predicted GROUP BY area, cluster) GROUP BY area""", ("predicted",))
def m18w(spark, d):
    return M.class_prevalence(predicted(spark, d), "area", "cluster", wide=True, classes=CLASSES)


VIEWS.update({
    "rich": ("""
      SELECT area, site, date, phylum, richness, sum(richness) OVER (PARTITION BY area, site, date) AS total FROM (
        SELECT s.area, s.site, s.date, t.phylum, sum(s.p) AS richness
        FROM score s JOIN taxonomy t ON s.taxon = t.hash GROUP BY 1, 2, 3, 4)""", ["score", "taxonomy"]),
})


def richness(spark, d):
    s = scores(spark, d).join(V.taxonomy(spark, d).select(F.col("hash").alias("taxon"), "phylum"), "taxon")
    return M.richness_by_point(s, ["area", "site", "date"], "phylum", "p")


@query("m19_richness_by_point", """
SELECT area, site, date, phylum, round(richness, 6) AS richness, round(total, 6) AS total FROM rich""", ("rich",))
def m19(spark, d):
    return round_cols(richness(spark, d), ["richness", "total"])


@query("m20_relative_to_max", """
SELECT area, site, date, phylum, round(total / max(total) OVER (PARTITION BY area), 6) AS total_rel FROM rich""",
       ("rich",))
def m20(spark, d):
    r = M.relative_to_max(richness(spark, d), "area", "total")
    return round_cols(r.select("area", "site", "date", "phylum", "total_rel"), "total_rel")


@query("m21_taxon_change", """
WITH g AS (SELECT taxon, area, avg(CASE WHEN year(date) = 1995 THEN p END) - avg(CASE WHEN year(date) = 2001 THEN p END) AS diff
           FROM score GROUP BY taxon, area),
w AS (SELECT taxon, """ + ", ".join(f"max(CASE WHEN area = '{a}' THEN diff END) AS \"diff_{a}\"" for a in AREAS) + """
      FROM g GROUP BY taxon),
w2 AS (SELECT *, """ + " + ".join(f"abs(coalesce(\"diff_{a}\", 0.0))" for a in AREAS) + """ AS sum_abs FROM w)
SELECT w2.taxon, """ + ", ".join(f"round(\"diff_{a}\", 6) AS \"diff_{a}\"" for a in AREAS) + """,
       round(sum_abs, 6) AS sum_abs, t.phylum,
       CAST(row_number() OVER (PARTITION BY t.phylum ORDER BY sum_abs DESC, w2.taxon) AS INTEGER) AS rank_in_group
FROM w2 LEFT JOIN (SELECT hash, phylum FROM taxonomy) t ON w2.taxon = t.hash""", ("score", "taxonomy"))
def m21(spark, d):
    s = scores(spark, d).withColumn("year", F.year("date"))
    s = s.join(V.taxonomy(spark, d).select(F.col("hash").alias("taxon"), "phylum"), "taxon", "left")
    r = M.taxon_change(s, "taxon", "area", "year", "p", 1995, 2001, AREAS, group="phylum")
    cols = [f"diff_{a}" for a in AREAS] + ["sum_abs"]
    return round_cols(r, cols)


@query("m22_select_taxa", """
SELECT hash, species FROM taxonomy WHERE contains(species, 'ring') OR contains(species, 'bolt')""", ("taxonomy",))
def m22(spark, d):
    return M.select_taxa(V.taxonomy(spark, d).select("hash", "species"), "species", ["ring", "bolt"])


@query("m23_grid_mean", """
SELECT area, round_even(temperature, 1) AS temperature, round_even(ph, 1) AS ph, round(avg(p), 6) AS p
FROM score GROUP BY 1, 2, 3""", ("score",))
def m23(spark, d):
    r = M.grid_mean(scores(spark, d), "area", "temperature", "ph", "p")
    return round_cols(r, ["temperature", "ph", "p"])


_RANK_SQL = """
WITH x AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, event_type, value FROM events
           WHERE event_type IN ('click', 'view') AND value IS NOT NULL),
c AS (SELECT hour, value, count(*) AS t, count_if(event_type = 'click') AS t1 FROM x GROUP BY hour, value),
r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY hour ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                + (t + 1) / 2.0 AS rk FROM c),
s AS (SELECT hour, sum(t1) AS n1, sum(t) - sum(t1) AS n2, sum(rk * t1) AS r1, sum(t * t * t - t) AS ties FROM r GROUP BY hour)
SELECT hour, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(r1 - n1 * (n1 + 1) / 2.0, 6) AS W,
       round(((r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) - sign(r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) * 0.5)
             / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z
FROM s"""


def rank_test(spark, d):
    e = V.table(spark, d, "events").select(F.hour("ts").alias("hour"), "event_type", "value")
    return M.rank_sum_test(e, "hour", "event_type", "value", "click", "view")


@query("m24_rank_sum_test", _RANK_SQL)
def m24(spark, d):
    r = rank_test(spark, d).select("hour", F.col("n1").cast("bigint"), F.col("n2").cast("bigint"), "W", "z")
    return round_cols(r, ["W", "z"])


@query("m24_rank_sum_p")
def m24p(spark, d):
    return rank_test(spark, d)


@query("m26_group_median", "SELECT area, median(temperature) AS median FROM env GROUP BY area", ("env",))
def m26(spark, d):
    return M.group_median(V.env(spark, d), "area", "temperature")


@query("m27_condition_share", """
SELECT area, count(*) AS n, CAST(count_if(temperature > 10 AND ph < 8.1) AS BIGINT) AS n_cond,
       round(avg(CASE WHEN temperature > 10 AND ph < 8.1 THEN p END), 6) AS mean_p,
       count_if(temperature > 10 AND ph < 8.1) / count(*) AS share
FROM score GROUP BY area""", ("score",))
def m27(spark, d):
    cond = (F.col("temperature") > 10) & (F.col("ph") < 8.1)
    return round_cols(M.condition_share(scores(spark, d), "area", cond, "p"), "mean_p")


@query("m28_expand_cross", """
SELECT t.taxon, p.area, y.year FROM (SELECT DISTINCT taxon FROM coef) t
CROSS JOIN (SELECT DISTINCT area FROM env_valid) p(area) CROSS JOIN (SELECT unnest([2017, 2050, 2095]) AS year) y(year)""",
       ("coef", "env_valid"))
def m28(spark, d):
    params = M.scenario_params(env_valid(spark, d), YEARS).select("area", "year")
    return M.expand_cross(V.coef(spark, d).select("taxon").distinct(), params)


@query("m25_hodges_lehmann", """
WITH x AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, event_type, value FROM events
           WHERE event_type IN ('click', 'view') AND value IS NOT NULL)
SELECT a.hour, round(quantile_cont(a.value - b.value, 0.5), 6) AS hl
FROM x a JOIN x b ON a.hour = b.hour AND a.event_type = 'click' AND b.event_type = 'view'
GROUP BY a.hour""")
def m25(spark, d):
    e = V.table(spark, d, "events").select(F.hour("ts").alias("hour"), "event_type", "value")
    return round_cols(M.hodges_lehmann(e, "hour", "event_type", "value", "click", "view"), "hl")

