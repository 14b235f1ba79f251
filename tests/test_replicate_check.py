"""Replicate check: centres, block sums of bounded memory, id repair by year, whole views."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tallyframe.functions import keys as K
from tallyframe.operators import distance as X
from tallyframe.plans import views as V
from tallyframe.plans.denoising import run_denoising

SF = "/root/testdata/sf0.001"


def _entries(n_samples, n_feats, seed=0):
    g = np.random.default_rng(seed)
    i = np.repeat(np.arange(n_samples), n_feats)
    return i, g.random(len(i)), np.tile(np.arange(n_feats), n_samples)


@pytest.mark.parametrize("chunk", [1, 7, 100, 10**6])
def test_block_sums_do_not_depend_on_the_chunk(chunk):
    li, lv, lf = _entries(5, 11)
    ri, rv, rf = _entries(4, 8, 1)
    got = X._shared_sums(li, lv, lf, ri, rv, rf, (5, 4), 11, chunk)
    a, b = lv.reshape(5, 11)[:, :8], rv.reshape(4, 8)
    assert np.allclose(got, np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2))


def test_block_memory_does_not_grow_with_features():
    def peak(n_feats):
        e = _entries(64, n_feats)
        tracemalloc.start()
        X._shared_sums(*e, *e, (64, 64), n_feats, 100_000)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top - 6 * 8 * 64 * n_feats  # sorted copies and counts of the rows themselves
    assert peak(1600) < 2 * peak(200) + 2_000_000


def test_median_of_equal_replicates_is_zero():
    pdf = pd.DataFrame({"g": "b", "a": ["x", "x", "y"], "b": ["y", "z", "z"], "bray": 0.0})
    assert X._spatial_median_group(pdf)["distance"].tolist() == [0.0, 0.0, 0.0]


def test_centre_is_checked(spark):
    df = spark.createDataFrame([(1, "s", "h", 1)], "run int, sample string, hash string, n_reads bigint")
    with pytest.raises(ValueError):
        run_denoising(df, center="mode")


def test_year_of_the_repair(spark):
    df = spark.createDataFrame([("TW201703A.1",), ("TW201803A.1",)], "sample string")
    one = [r[0] for r in df.select(K.normalize_sample_id("sample", "2017")).collect()]
    every = [r[0] for r in df.select(K.normalize_sample_id("sample")).collect()]
    assert one == ["TW_201703A.1", "TW201803A.1"] and every == ["TW_201703A.1", "TW_201803A.1"]


def test_views_read_whole_tables(spark):
    assert V.reads(spark, SF).count() == V.table(spark, SF, "lineitem").count()
    parts = V.table(spark, SF, "part")
    assert V.traits(spark, SF).count() > parts.where("p_partkey % 3 = 0").count()


@pytest.mark.parametrize("block_size", [3, 100])
def test_dissimilarity_shares_of_features_and_runs_of_rows(spark, monkeypatch, block_size):
    """Tasks hold a run of whole features; their sums add up, repeated and null rows included."""
    rng = np.random.default_rng(8)
    rows = [(f"s{rng.integers(9)}", f"f{rng.integers(30)}", float(rng.integers(1, 9))) for _ in range(400)]
    rows += [("s1", None, 5.0), (None, "f1", 2.0), ("s2", "f3", 0.0)]
    df = spark.createDataFrame(rows, "sample string, hash string, value double")
    want = {}
    for a in range(9):
        for b in range(a + 1, 9):
            x, y = ([(f, v) for s, f, v in rows if s == f"s{k}"] for k in (a, b))
            shared = sum(min(v, w) for f, v in x for g, w in y if f is not None and f == g)
            want[f"s{a}", f"s{b}"] = 1 - 2 * shared / (sum(v for _, v in x) + sum(v for _, v in y))
    got = X.dissimilarity(df, block_size=block_size, part_rows=60)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == pytest.approx(want, abs=1e-12)
    # the same from one task in runs of 7 rows
    f = sorted((g, int(s[1]), v) for s, g, v in rows if s and g)
    pdf = pd.DataFrame({"i": [r[1] for r in f], "f": [int(r[0][1:]) for r in f], "v": [r[2] for r in f]})
    out = pd.concat(X._pair_sums(100, 9, rows=7)((0, 0, 0), (pdf[k:k + 5] for k in range(0, len(pdf), 5))))
    whole = pd.concat(X._pair_sums(100, 9)((0, 0, 0), iter([pdf])))
    assert np.allclose(out.to_numpy(float), whole.to_numpy(float))
