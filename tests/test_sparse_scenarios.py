"""Sparse tables, quantiles by selection, products in pieces and draws against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import quantiles, scenario, sparse
from tallyframe.operators import community as U
from tallyframe.operators._util import product_by
from tallyframe.plans.analysis import project_scenarios


def uniform(*key):
    return (int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def binomial(u, p, n):
    """Least k with P(K <= k) >= u; the rarer outcome is counted."""
    q = p if p <= 0.5 else 1 - p
    total, k = (1 - q)**n, 0
    term = total
    while total < u and k < n:
        term = term * ((n - k) / (k + 1)) * (q / (1 - q))
        total += term
        k += 1
    return k if p <= 0.5 else n - k


def test_quantiles_with_a_hot_group(spark):
    g = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in g.integers(0, 400, 6000)] + [("b", float(x)) for x in g.normal(size=7)] + [("one", 2.5), ("none", None)]
    rows += [(None, float(x)) for x in g.normal(size=40)]
    d = spark.createDataFrame(rows, "grp string, x double")
    by = {}
    for k, x in rows:
        by.setdefault(k, []).extend([] if x is None else [x])
    got = {r.grp: r for r in quantiles.grouped_quantiles(d, "grp", "x", {"a": 0.1, "m": 0.5, "z": 1.0}).collect()}
    assert set(got) == set(by) and got["none"].m is None
    for k, xs in by.items():
        if xs:
            assert np.allclose([got[k].a, got[k].m, got[k].z], np.quantile(xs, [0.1, 0.5, 1.0]))
    box = {r.grp: r for r in U.box_stats(d, "grp", "x").collect()}
    q1, q3 = np.quantile(by["b"], [0.25, 0.75])
    inside = [x for x in by["b"] if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
    assert (box["b"].whisker_lo, box["b"].whisker_hi, box["b"].n_outliers) == (min(inside), max(inside), len(by["b"]) - len(inside))
    assert quantiles.grouped_quantiles(d.where("grp = 'x'"), "grp", "x", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("pack", [4096, 3])
def test_sparse_table(spark, monkeypatch, pack):
    monkeypatch.setattr(sparse, "PACK", pack)
    rows = [(f"e{i}", f"t{j}", float((i * j) % 4)) for i in range(9) for j in range(6) if (i + j) % 3]
    rows += [(None, "t1", 1.0), ("e1", None, 1.0), ("e99", "t0", 0.0)]
    d = spark.createDataFrame(rows, "event string, taxon string, value double")
    cells = {(e, t): v for e, t, v in rows if e and t and v > 0}
    events, taxa = {e for e, t, _ in rows if e and t}, {t for e, t, _ in rows if e and t}
    p = sparse.SparseTable.of(d, "event", "taxon", "value").presence()
    got = {(r.event, r.taxon): r.presence for r in p.dense().collect()}
    assert got == {(e, t): int((e, t) in cells) for e in events for t in taxa}
    n = {t: sum((e, t) in cells for e in events) for t in taxa}
    kept = sorted(t for t in taxa if 2 < n[t] < 5)
    coded = p.prevalent(2, 5).coded("eid", "tid").dense().collect()
    assert {(r.event, r.taxon): (r.eid, r.tid, r.presence) for r in coded} == {
        (e, t): (sorted(events).index(e) + 1, kept.index(t) + 1, int((e, t) in cells)) for e in events for t in kept}
    assert len(coded) == len(events) * len(kept)
    assert p.keep_cols(p.cols.limit(0)).dense().count() == 0


def test_product_in_pieces(spark):
    a = spark.createDataFrame([("x" if i % 5 else "y", i) for i in range(60)] + [(None, 99)], "k string, i int")
    b = spark.createDataFrame([("x" if j % 3 else "y", j) for j in range(40)] + [("z", 1), (None, 2)], "k string, j int")
    got = sorted(map(tuple, product_by(a, b, "k", rows=7).select("k", "i", "j").collect()))
    assert got == sorted(map(tuple, a.join(b, "k").select("k", "i", "j").collect()))


@pytest.mark.parametrize("n", [100, 600])
def test_binomial_mean(spark, n):
    ps = [0.0, 1e-4, 0.02, 0.3, 0.5, 0.77, 0.999, 1.0]
    rows = [(f"t{i}", j, p) for i, p in enumerate(ps) for j in range(40)] + [("null", 0, None)]
    got = {(r.taxon, r.j): r.m for r in scenario.binomial_mean(spark.createDataFrame(rows, "taxon string, j int, p double"), "p", ["taxon", "j"],
                                                               n, 3, "m").collect()}
    assert got["null", 0] is None
    for t, j, p in rows[:-1]:
        parts = [(512, ()), (88, (1,))] if n == 600 else [(100, ())]
        assert got[t, j] == pytest.approx(sum(binomial(uniform(t, j, 3, *more), p, m) for m, more in parts) / n, abs=1e-12)


def test_projection(spark):
    env = spark.createDataFrame([(a, 9 + i * 0.4 + k, 7.9 + 0.05 * i) for k, a in enumerate("PQ") for i in range(8)], "area string, temperature double, ph double")
    coef = spark.createDataFrame([(f"t{i}", a, i / 4 - 1, 0.1 * i, -0.1) for i in range(6) for a in "PQ"],
                                 "taxon string, area string, intercept double, b_t double, b_ph double")
    groups = spark.createDataFrame([(f"t{i}", "AB"[i % 2]) for i in range(5)], "taxon string, phylum string")
    got = {(r.area, r.year, r.draw, r.phylum): r.richness for r in project_scenarios(env, coef, groups, [2017, 2095], 20, 4, 50).collect()}
    draws = scenario.trim_tails(scenario.scenario_draws(scenario.scenario_params(env, [2017, 2095]), 20, 4)).collect()
    want = {}
    for d in draws:
        for i in range(6):
            p = 1 / (1 + math.exp(-(i / 4 - 1 + 0.1 * i * d.temperature - 0.1 * d.ph)))
            k = (d.area, d.year, d.draw, "AB"[i % 2] if i < 5 else None)
            want[k] = want.get(k, 0) + binomial(uniform(f"t{i}", d.area, d.year, d.draw, 4), p, 50) / 50
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
