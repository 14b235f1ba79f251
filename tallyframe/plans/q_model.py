"""Registered queries: fitted models (M7, M8, M16) -- checked by row counts and unit
tests, since fitted coefficients are not SQL-expressible."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model as ML
from ..operators import scenario as M
from ..operators._util import round_cols
from . import chain as C
from . import q_scenario as QS
from . import views as V
from .oracle_views import VIEWS
from .registry import query

CANDIDATES = {"T": ["temperature_std"], "pH": ["ph_std"], "T+pH": ["temperature_std", "ph_std"]}


REG = 0.01


def model_data(spark, d):
    """Prevalent presence matrix with standardised temperature and pH of each event."""
    from .analysis import model_table
    return C.materialized(spark, d, "model_data", lambda: model_table(
        QS.presence_table(spark, d), V.env(spark, d)).dense().drop("taxon_id", "event_id"))


@query("m7_taxon_response_model")
def m7(spark, d):
    coef, _, _ = ML.taxon_response_model(model_data(spark, d), xs=["temperature_std", "ph_std"])
    return coef


@query("m8_compare_models")
def m8(spark, d):
    return ML.compare_models(model_data(spark, d), CANDIDATES)


_MODEL_DATA = """
e AS (SELECT * FROM env WHERE site IS NOT NULL AND date IS NOT NULL AND area IS NOT NULL
      AND temperature IS NOT NULL AND ph IS NOT NULL AND salinity IS NOT NULL),
j AS (SELECT e.area, e.temperature, e.ph, p.taxon, p.presence
      FROM prevalent p JOIN e ON e.site = split_part(p.event, '_', 1)
       AND e.date = strptime(split_part(p.event, '_', 2) || '01', '%Y%m%d')::DATE),
md AS (SELECT taxon, area, presence,
        CASE WHEN coalesce(stddev_samp(temperature) OVER w, 0) = 0 THEN temperature
             ELSE (temperature - avg(temperature) OVER w) / stddev_samp(temperature) OVER w END AS temperature_std,
        CASE WHEN coalesce(stddev_samp(ph) OVER w, 0) = 0 THEN ph
             ELSE (ph - avg(ph) OVER w) / stddev_samp(ph) OVER w END AS ph_std
      FROM j WINDOW w AS (PARTITION BY area))
"""


@query("m7_score_equations", "WITH " + _MODEL_DATA + """
SELECT taxon, area, n, round(sum(temperature_sum) OVER (PARTITION BY taxon), 5) AS temperature,
       round(sum(ph_sum) OVER (PARTITION BY taxon), 5) AS ph FROM (
  SELECT taxon, area, sum(presence)::double AS n, sum(presence * temperature_std) AS temperature_sum, sum(presence * ph_std) AS ph_sum
  FROM md GROUP BY taxon, area)""", ("prevalent", "env"))
def m7s(spark, d):
    """M7's fitted totals, which at the optimum are the observed ones, for every taxon."""
    rows, xs = model_data(spark, d), ["temperature_std", "ph_std"]
    _, fit, _ = ML.taxon_response_model(rows, xs=xs, reg=REG)
    coef = fit.coefficients("presence", "area").select("taxon", "area", "presence", "intercept", *[F.get("slopes", i).alias(f"b_{x}") for i, x in enumerate(xs)])
    r = ML.score_equations(rows, coef, "taxon", "presence", xs, "area", REG).where("presence = 1")
    return round_cols(r.select("taxon", "area", F.col("fitted_n").alias("n"), F.col("fitted_temperature_std").alias("temperature"),
                               F.col("fitted_ph_std").alias("ph")), ["n", "temperature", "ph"], 5)


VIEWS.update({
    "env_classes": ("""
      SELECT *, CAST(1 + CASE WHEN (CAST(site AS INTEGER) + year(date)) % 4 = 0 THEN CAST(site AS INTEGER) % 3
                              ELSE CAST(temperature > 10 AS INTEGER) + CAST(ph < 8.1 AS INTEGER) END AS INTEGER) AS cluster
      FROM env_valid""", ["env_valid"]),
})


def env_classes(spark, d):
    """Valid environment rows with one of three classes, by warmth and acidity but for a
    quarter of them: several classes in every area, which the predictors do not separate."""
    site = F.col("site").cast("int")
    by_env = (F.col("temperature") > 10).cast("int") + (F.col("ph") < 8.1).cast("int")
    return QS.env_valid(spark, d).withColumn(
        "cluster", (F.lit(1) + F.when((site + F.year("date")) % 4 == 0, site % 3).otherwise(by_env)).cast("int"))


@query("m16_cluster_model")
def m16(spark, d):
    return ML.cluster_model(env_classes(spark, d), "area", "cluster", ["temperature", "ph"])


@query("m16_score_equations", """
SELECT area, cluster, count(*)::double AS n, round(sum(temperature), 5) AS temperature, round(sum(ph), 5) AS ph
FROM env_classes GROUP BY area, cluster""", ("env_classes",))
def m16s(spark, d):
    """M16's fitted totals, which at the optimum are the observed ones, for every area and class."""
    rows = env_classes(spark, d)
    coef = ML.cluster_model(rows, "area", "cluster", ["temperature", "ph"])
    r = ML.score_equations(rows, coef, "area", "cluster", ["temperature", "ph"])
    return round_cols(r.select("area", "cluster", F.col("fitted_n").alias("n"), F.col("fitted_temperature").alias("temperature"),
                               F.col("fitted_ph").alias("ph")), ["n", "temperature", "ph"], 5)


@query("m16_predict_fitted")
def m16p(spark, d):
    """M16 + M17: predict grid classes from the fitted multinomial model."""
    coef = ML.cluster_model(env_classes(spark, d), "area", "cluster", ["temperature", "ph"])
    coef = coef.withColumnRenamed("b_temperature", "b_t").withColumnRenamed("b_ph", "b_ph")
    return M.predict_class(coef, QS.grid(spark, d), ["temperature", "ph"])


@query("entry2_prepare_model_data", """
WITH e AS (SELECT * FROM env WHERE site IS NOT NULL AND date IS NOT NULL AND area IS NOT NULL
           AND temperature IS NOT NULL AND ph IS NOT NULL AND salinity IS NOT NULL),
j AS (SELECT e.site, e.date, e.area, e.temperature, e.ph, e.salinity, p.taxon, p.event, p.presence
      FROM prevalent p JOIN e ON e.site = split_part(p.event, '_', 1)
       AND e.date = strptime(split_part(p.event, '_', 2) || '01', '%Y%m%d')::DATE),
s AS (SELECT *,
        CASE WHEN coalesce(stddev_samp(temperature) OVER w, 0) = 0 THEN temperature
             ELSE (temperature - avg(temperature) OVER w) / stddev_samp(temperature) OVER w END AS temperature_std,
        CASE WHEN coalesce(stddev_samp(ph) OVER w, 0) = 0 THEN ph
             ELSE (ph - avg(ph) OVER w) / stddev_samp(ph) OVER w END AS ph_std
      FROM j WINDOW w AS (PARTITION BY area))
SELECT *, CAST(dense_rank() OVER (ORDER BY taxon) AS INTEGER) AS taxon_id,
       CAST(dense_rank() OVER (ORDER BY event) AS INTEGER) AS event_id FROM s""", ("prevalent", "env"))
def entry2(spark, d):
    """Second entry point: cleaned reads to the model-ready presence table."""
    from . import q_taxonomy as QT
    from .analysis import planktonic_index, prepare_model_data
    annot = V.taxonomy(spark, d).withColumn("lifestyle", QT.lifestyle_rule())
    idx = planktonic_index(C.step4(spark, d), annot, QT.human_hashes(spark, d), QT.EXCLUDED_EVENTS)
    return prepare_model_data(idx, V.env(spark, d), QS.EXCLUDE_TAXA)


@query("entry3_project_scenarios")
def entry3(spark, d):
    """Third entry point: scenario draws to expected richness per draw and phylum."""
    from .analysis import project_scenarios
    groups = V.taxonomy(spark, d).select(F.col("hash").alias("taxon"), "phylum")
    return project_scenarios(QS.env_valid(spark, d), V.coef(spark, d), groups, QS.YEARS,
                             n_draws=1000, seed=9, presence_draws=100)
