"""Permutation tests against plain loops over the same permutations."""

import hashlib

import numpy as np
import pytest

from tallyframe.operators import community as U


def shuffled(labels: dict, k: int, seed: int) -> dict:
    order = sorted(labels)
    by_mark = sorted(order, key=lambda s: (hashlib.md5(f"{s}|{k}|{seed}".encode()).hexdigest(), s))
    return {s: labels[order[i]] for i, s in enumerate(by_mark)}


def table(seed, n=14, taxa=9):
    g = np.random.default_rng(seed)
    x = g.random((n, taxa)) * (g.random((n, taxa)) < 0.6)
    return {f"s{i}": x[i] for i in range(n)}


def contributions(x, labels):
    out, n = {}, {}
    for i in x:
        for j in x:
            a, b = labels[i], labels[j]
            if a < b and x[i].sum() + x[j].sum() > 0:
                c = np.abs(x[i] - x[j]) / (x[i].sum() + x[j].sum())
                out[a, b] = out.get((a, b), 0) + c
    size = {g: sum(v == g for v in labels.values()) for g in labels.values()}
    return {k: v / (size[k[0]] * size[k[1]]) for k, v in out.items()}


@pytest.mark.parametrize("block", [128, 4])
def test_simper_p(spark, block):
    areas = {"n": table(1), "m": {f"t{k}": v for k, v in table(2, 8).items()}}
    labels = {a: {s: "AAABBC"[i % 6] if a == "n" else "AB"[i % 2] for i, s in enumerate(x)} for a, x in areas.items()}
    rows = [(s, f"k{j}", float(v)) for x in areas.values() for s, r in x.items() for j, v in enumerate(r)]
    groups = [(s, g, a) for a, l in labels.items() for s, g in l.items()]
    got = U.simper_permutation_p(spark.createDataFrame(rows, "sample string, taxon string, value double"),
                                 spark.createDataFrame(groups, "sample string, group string, area string"), nperm=30, seed=5, by="area",
                                 block_size=block).collect()
    want = {}
    for a, x in areas.items():
        obs = contributions(x, labels[a])
        perms = [contributions(x, shuffled(labels[a], k, 5)) for k in range(1, 31)]
        for (ga, gb), c in obs.items():
            for j in np.flatnonzero(c > 0):
                want[a, f"{ga}_{gb}", f"k{j}"] = (c[j], (1 + sum(p[ga, gb][j] >= c[j] - 1e-12 for p in perms)) / 31)
    assert {(r.by, r.comparison, r.taxon): (round(r.average, 9), round(r.p, 9)) for r in got} == \
        {k: (round(v[0], 9), round(v[1], 9)) for k, v in want.items()}


@pytest.mark.parametrize("block", [256, 3])
def test_permanova_p(spark, monkeypatch, block):
    monkeypatch.setattr(U, "SAMPLE_BLOCK", block)
    monkeypatch.setattr(U, "PERM_BLOCK", 8)
    g = np.random.default_rng(3)
    names = [f"s{i:02d}" for i in range(15)]
    lab = {s: "XYZ"[i % 3] for i, s in enumerate(names)}
    d = {(a, b): float(g.random() + (lab[a] != lab[b]) * 0.2) for a in names for b in names if a < b}

    def f(l):
        within = sum(sum(v * v for (a, b), v in d.items() if l[a] == l[b] == k) / 5 for k in "XYZ")
        total = sum(v * v for v in d.values()) / 15
        return ((total - within) / 2) / (within / 12)
    got = U.permanova_test(spark.createDataFrame([(*k, v) for k, v in d.items()], "sample1 string, sample2 string, bray double"),
                           spark.createDataFrame(list(lab.items()), "sample string, group string"), nperm=20, seed=7).first()
    more = sum(f(shuffled(lab, k, 7)) >= f(lab) - 1e-12 for k in range(1, 21))
    assert got.nperm == 20 and abs(got.F_obs - f(lab)) < 1e-9 and abs(got.p - (more + 1) / 21) < 1e-12


def test_equal_averages_keep_the_order_of_taxa(spark):
    """Averages that differ in the last bits only are ties: the shares follow the taxon."""
    rows = [(f"a{i}", t, 0.1 + 0.2 * (t == "k3")) for i in range(3) for t in ("k1", "k2", "k3")] + [(f"b{i}", "k9", 0.3) for i in range(3)]
    r = U.simper(spark.createDataFrame(rows, "sample string, taxon string, value double"),
                 spark.createDataFrame([(f"{g}{i}", g) for g in "ab" for i in range(3)], "sample string, group string")).collect()
    share = {x.taxon: x.cusum for x in r}
    assert share["k9"] < share["k1"] < share["k2"] or share["k3"] < share["k1"] < share["k2"]
