"""Models: species response, comparison of predictor sets, classes of the environment. All fits
of a call run together (``logit.fit_grouped_logit``); coefficients stay tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import as_list
from .logit import fit_grouped_logit
from .scenario import hash_uniform


def _spread(xs) -> list:
    return [F.get("slopes", i).alias(f"b_{x}") for i, x in enumerate(xs)]


def taxon_response_model(df: DataFrame, taxon: str = "taxon", area: str = "area", y: str = "presence",
                         xs=("temperature", "ph"), reg: float = 0.01, max_iter: int = 100):
    """M7: presence (0 or 1) ~ slope per taxon for each predictor + intercept per taxon x area,
    L2-regularised (``reg`` times half the taxon's rows). Taxa share no parameter, so each is a
    group of one grouped fit. Returns (coefficients, fit, status table); coefficients are
    (taxon, area, intercept, b_<x>...)."""
    xs = as_list(xs)
    d = df.withColumn("__y", F.col(y).cast("int")).withColumn(area, F.col(area).cast("string"))
    fit = fit_grouped_logit(d, taxon, "__y", F.array(*xs), area, reg, max_rounds=max_iter, classes=[0, 1])
    c = fit.coefficients("__y", area).where("__y = 1")
    return c.select(taxon, area, "intercept", *_spread(xs)), fit, fit.groups


def compare_models(df: DataFrame, candidates: dict, taxon: str = "taxon", area: str = "area",
                   y: str = "presence", split_key=("taxon", "event"), train_share: float = 0.8,
                   seed: int = 1, reg: float = 0.01) -> DataFrame:
    """M8: (model, predictors, n_params, n_train, n_test, train_loglik, test_log_loss, aic) of
    each candidate set of predictors, by held-out log loss and training AIC. The split is a
    seeded hash of ``split_key``, so it does not depend on partitioning. All candidates are
    fitted at once, a taxon under a candidate being a group; held-out rows of a taxon and area
    without training rows are not scored."""
    sets = [(name, as_list(xs)) for name, xs in candidates.items()]
    u = hash_uniform(*[F.col(c) for c in as_list(split_key)], F.lit(seed))
    d = df.select(F.col(taxon).alias("taxon"), F.col(area).cast("string").alias("area"), F.col(y).cast("int").alias("y"),
                  (u < train_share).alias("train"),
                  F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.array(*[F.col(x).cast("double") for x in xs]).alias("x"))
                                      for n, xs in sets])).alias("m")).select("taxon", "area", "y", "train", "m.*")
    d = d.where(F.col("y").isNotNull() & F.col("area").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    fit = fit_grouped_logit(d.where("train"), ["model", "taxon"], "y", F.col("x"), "area", reg, classes=[0, 1])
    j = d.join(fit.coefficients("class", "area").where("class = 1"), ["model", "taxon", "area"])
    eta = F.col("intercept") + F.aggregate(F.zip_with("x", "slopes", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    p = 1 / (1 + F.exp(-eta))
    eps = 1e-15
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    j = j.withColumn("ll", F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))
    s = j.groupBy("model").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_test"),
                               F.sum(F.when(F.col("train"), F.col("ll"))).alias("train_loglik"),
                               F.avg(F.when(~F.col("train"), -F.col("ll"))).alias("test_log_loss"))
    k = fit.groups.groupBy("model").agg(F.sum("n_params").cast("bigint").alias("n_params"))
    names = F.create_map(*[F.lit(v) for n, xs in sets for v in (n, ",".join(xs))])
    return s.join(k, "model").select("model", names[F.col("model")].alias("predictors"), "n_params", "n_train", "n_test", "train_loglik",
                                     "test_log_loss", (2 * F.col("n_params") - 2 * F.col("train_loglik")).alias("aic"))


def cluster_model(df: DataFrame, by: str = "area", label: str = "cluster", xs=("temperature", "ph"), reg: float = 0.0) -> DataFrame:
    """Multinomial logistic regression of the class on the predictors, one per group, all
    fitted together. Returns (group, class, intercept, b_<x>...); a group's first class is the
    baseline with zeros."""
    xs = as_list(xs)
    c = fit_grouped_logit(df, by, label, F.array(*xs), None, reg).coefficients(label)
    return c.select(by, label, "intercept", *_spread(xs))


def score_equations(rows: DataFrame, coef: DataFrame, group, label: str, xs, level: str | None = None, reg: float = 0.0) -> DataFrame:
    """What the data must equal at the optimum: per group, class and level the sum of fitted
    probabilities plus the penalty's pull (``fitted_n``), per group and class the same of each
    predictor (``fitted_<x>``); at the optimum they are the counts and sums of the observed rows
    of the class. ``coef`` has (group, class, [level,] intercept, b_<x>...)."""
    g, xs = as_list(group), as_list(xs)
    at = [*g, *([level] if level else [])]
    n = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"))
    c = coef.groupBy(*at).agg(F.collect_list(F.struct(F.col(label).alias("c"), F.col("intercept").alias("b0"),
                                                      F.array(*[f"b_{x}" for x in xs]).alias("b"))).alias("__c"))
    eta = lambda k: k["b0"] + sum(k["b"][i] * F.col(x) for i, x in enumerate(xs))
    j = rows.join(c, at).withColumn("__e", F.transform("__c", lambda k: F.struct(k["c"].alias("c"), eta(k).alias("e"))))
    j = j.withColumn("__top", F.array_max(F.transform("__e", lambda k: k["e"])))
    j = j.withColumn("__z", F.aggregate("__e", F.lit(0.0), lambda a, k: a + F.exp(k["e"] - F.col("__top"))))
    j = j.select(*at, *xs, "__top", "__z", F.explode("__e").alias("k")).withColumn("__p", F.exp(F.col("k.e") - F.col("__top")) / F.col("__z"))
    s = j.groupBy(*at, F.col("k.c").alias(label)).agg(F.sum("__p").alias("fitted_n"), *[F.sum(F.col("__p") * F.col(x)).alias(f"fitted_{x}") for x in xs])
    s = s.join(coef, [*at, label]).join(n, g)
    s = s.withColumn("fitted_n", F.col("fitted_n") + reg * F.col("__n") * F.col("intercept"))
    if not level:
        return s.select(*g, label, "fitted_n", *[(F.col(f"fitted_{x}") + reg * F.col("__n") * F.col(f"b_{x}")).alias(f"fitted_{x}") for x in xs])
    # a slope belongs to all levels of a group
    t = s.groupBy(*g, label).agg(*[(F.sum(f"fitted_{x}") + reg * F.max("__n") * F.max(f"b_{x}")).alias(f"fitted_{x}") for x in xs])
    return s.select(*at, label, "fitted_n").join(t, [*g, label])
