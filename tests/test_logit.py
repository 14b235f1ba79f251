"""Grouped logistic fits against a plain gradient check and a dense Newton solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import model
from tallyframe.operators.logit import fit_grouped_logit


def dense_fit(z, y, k, ridge):
    """Newton on one data set; classes 0..k, class 0 the baseline."""
    q = z.shape[1]
    b = np.zeros(k * q)
    for _ in range(60):
        eta = np.column_stack([np.zeros(len(y)), z @ b.reshape(k, q).T])
        p = np.exp(eta - eta.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = np.concatenate([z.T @ ((y == c + 1) - p[:, c + 1]) for c in range(k)]) - ridge * b
        h = np.block([[(z * (p[:, a + 1] * ((a == c) - p[:, c + 1]))[:, None]).T @ z for c in range(k)] for a in range(k)])
        b = b + np.linalg.solve(h + ridge * np.eye(k * q), g)
    return b.reshape(k, q)


def data(seed, sizes, classes=3, levels=("p", "q")):
    g = np.random.default_rng(seed)
    rows = []
    for name, n in sizes.items():
        for _ in range(n):
            x = g.normal(size=2)
            rows.append((name, str(g.choice(levels)), int((x @ [1.0, -0.5] + g.logistic() > 0) + (g.random() < 0.3)) % classes, float(x[0]), float(x[1])))
    return rows


FORM = "grp string, level string, y int, a double, b double"


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_multinomial_equals_dense_newton(spark, block_rows):
    rows = data(1, {"small": 40, "mid": 120, "hot": 900})
    d = spark.createDataFrame(rows + rows[:25], FORM).repartition(5)
    fit = fit_grouped_logit(d, "grp", "y", F.array("a", "b"), "level", reg=0.01, block_rows=block_rows, classes=[0, 1, 2])
    assert all(r.converged for r in fit.groups.collect())
    got = {(r.grp, r.y, r.level): [r.intercept, *r.slopes] for r in fit.coefficients("y", "level").collect()}
    for name in ("small", "mid", "hot"):
        own = [r for r in rows + rows[:25] if r[0] == name]
        z = np.array([[r[1] == "p", r[1] == "q", r[3], r[4]] for r in own], float)
        b = dense_fit(z, np.array([r[2] for r in own]), 2, 0.01 * len(own))
        for c in (0, 1, 2):
            for i, lv in enumerate(("p", "q")):
                want = [0, 0, 0] if c == 0 else [b[c - 1][i], *b[c - 1][2:]]
                assert np.allclose(got[name, c, lv], want, atol=1e-7)


def test_odd_groups(spark):
    rows = [("one", "p", 1, 0.5, 1.0)] * 5  # a single class has nothing to fit
    rows += [("apart", "p", int(i >= 5), float(i), 0.0) for i in range(10)]  # separated: no finite optimum
    rows += [(None, "p", i % 2, float(i % 3), float(i % 5)) for i in range(30)]  # a null group is a group
    rows += [("gaps", None, 0, 1.0, 1.0), ("gaps", "p", None, 1.0, 1.0), ("gaps", "p", 0, None, 1.0), ("gaps", "p", 0, float("nan"), 1.0)]
    fit = fit_grouped_logit(spark.createDataFrame(rows, FORM), "grp", "y", F.array("a", "b"), "level", max_rounds=60)
    groups = {r.grp: r for r in fit.groups.collect()}
    assert set(groups) == {"one", "apart", None}
    assert groups["one"].n_params == 0 and groups["one"].converged and groups[None].converged
    coef = {(r.grp, r.y): r for r in fit.coefficients("y", "level").collect()}
    assert coef["one", 1].intercept == 0 and coef["apart", 1].slopes[0] > 1
    empty = fit_grouped_logit(spark.createDataFrame([], FORM), "grp", "y", F.array("a", "b"))
    assert empty.coefficients().count() == 0


def test_response_model_and_score_equations(spark):
    mixed = np.random.default_rng(2).normal(size=(400, 3)) @ [[1, 0, 1], [0, 1, -1], [0, 0, 1]]
    rows = [(f"t{i % 4}", f"A{i % 3}", float(x), float(z), float(y)) for i, (x, z, y) in enumerate(mixed)]
    rows = [(t, a, x, z, int(y > 0)) for t, a, x, z, y in rows] + [("always", "A0", 0.1, 0.2, 1), ("always", "A0", 0.3, -0.2, 1)]
    d = spark.createDataFrame(rows, "taxon string, area string, temperature double, ph double, presence int")
    coef, fit, status = model.taxon_response_model(d, reg=0.02)
    assert coef.count() == 13 and all(r.converged for r in status.collect())
    assert {r.taxon: r.intercept > 0 for r in coef.where("taxon = 'always'").collect()} == {"always": True}
    both = fit.coefficients("presence", "area").select("taxon", "area", "presence", "intercept", F.col("slopes")[0].alias("b_temperature"),
                                                       F.col("slopes")[1].alias("b_ph"))
    for r in model.score_equations(d, both, "taxon", "presence", ["temperature", "ph"], "area", 0.02).where("presence = 1").collect():
        own = [x for x in rows if x[0] == r.taxon]
        assert abs(r.fitted_n - sum(x[4] for x in own if x[1] == r.area)) < 1e-6
        assert abs(r.fitted_temperature - sum(x[4] * x[2] for x in own)) < 1e-6 and abs(r.fitted_ph - sum(x[4] * x[3] for x in own)) < 1e-6


def test_compare_models(spark):
    """A row per candidate; the one with the predictor that matters wins, labels with bars survive."""
    g = np.random.default_rng(3)
    rows = []
    for t in ("f|g", "h||i"):
        for i in range(300):
            x, z = g.normal(size=2)
            rows.append((t, f"A|{i % 2}", f"e{i}", float(x), float(z), int(2 * x + g.logistic() > 0)))
    d = spark.createDataFrame(rows, "taxon string, area string, event string, x double, z double, presence int")
    got = {r.model: r for r in model.compare_models(d, {"X": ["x"], "Z": ["z"], "XZ": ["x", "z"]}).collect()}
    assert set(got) == {"X", "Z", "XZ"}
    assert all(r.n_train + r.n_test == 600 and r.n_test > 60 for r in got.values())
    assert (got["X"].n_params, got["XZ"].n_params) == (6, 8)
    assert got["X"].test_log_loss < got["Z"].test_log_loss - 0.1 and got["X"].aic < got["Z"].aic
    assert abs(got["XZ"].test_log_loss - got["X"].test_log_loss) < 0.05
