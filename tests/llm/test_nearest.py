"""Nearest neighbours against brute force: exact when every bucket is probed, recall else."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import nearest

FORM = "vec_id long, embedding array<float>"


def plain(rows, k, every=10):
    ok = {(i, tuple(map(float, np.float32(v)))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = []
    for q, v in ok:
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in ok if i != q and len(w) == len(v))
            out += [(q, r, i, d) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def clustered(seed, n, dim):
    g = np.random.default_rng(seed)
    centre = g.normal(size=(8, dim))
    v = centre[g.integers(0, 8, n)] + 0.6 * g.normal(size=(n, dim))
    return [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]


def search(spark, rows, form=FORM, **how):
    df = spark.createDataFrame(rows, form).selectExpr("*", "'x' as id", "'y' as vec", "1 as score", "2 as code").repartition(4)
    r = nearest.nearest_neighbours(df, F.col("id") % 10 == 0, **how)
    return sorted(map(tuple, r.select("query_id", "rank", "vec_id", "score").collect()))


def odd_rows():
    rows = clustered(1, 200, 12)
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(20, rows[20][1]), (20, rows[20][1])]  # copies, repeated rows
    rows += [(2000, None), (2010, []), (2020, [0.0] * 12), (2030, [1.0, None] + [0.0] * 10), (2040, [float("nan")] + [1.0] * 11),
             (2050, [float("inf")] + [1.0] * 11), (None, rows[7][1]), (-10, [-0.0] + rows[9][1][1:]), (3000, [1.0, 2.0]), (3001, [1.0, 2.5]), (4000, [3.0])]
    return rows


@pytest.mark.parametrize("how", [{}, {"block": 16}])
def test_all_probes_are_exact(spark, how):
    rows = odd_rows()
    got, want = search(spark, rows, probes=32, **how), plain(rows, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


@pytest.mark.parametrize("dim, n", [(24, 3000), (64, 1500)])
def test_recall(spark, dim, n):
    rows = clustered(2, n, dim)
    got, want = {g[0::2] for g in search(spark, rows)}, {w[0::2] for w in plain(rows, 10)}
    found = {(q, i) for q, i in got} & {(q, i) for q, i in want}
    assert len(found) >= 0.9 * len(want)


def test_deeper_codes(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BUCKET", 2)
    rows = clustered(3, 2000, 8)
    got, want = {g[0::2] for g in search(spark, rows)}, {w[0::2] for w in plain(rows, 10)}
    assert len(got & want) >= 0.9 * len(want)


def test_empty_and_doubles(spark):
    assert search(spark, [], FORM) == []
    assert search(spark, [(10, [1.0, 2.0])], "vec_id long, embedding array<double>") == []
    rows = [(i, [1e200 * i, 1.0, float(i)]) for i in range(1, 30)]
    got = search(spark, rows, "vec_id int, embedding array<double>", k=3)
    assert {g[0] for g in got} == {10, 20} and all(g[1] <= 3 for g in got)


def test_transform_is_a_rotation():
    x = np.random.default_rng(4).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(nearest.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(nearest.hadamard(nearest.hadamard(x)), x)
    p = nearest.Polytopes(16, 3, 2)
    codes, probes = p.codes(x), p.probes(x, 5)
    assert (probes[:, :, 0] == codes).all()
    assert (p.place(x, x) == 0).all()
    for i in range(5):  # the r-th probe is the bucket that r others come before
        for t in range(3):
            y = p.axes(x[i:i + 1], t)[0]
            cost = (y.max(axis=1, keepdims=True) - y) ** 2
            all_costs = np.add.outer(cost[1], cost[0]).ravel()
            assert (np.argsort(all_costs, kind="stable")[:5] == probes[i, t]).all()
