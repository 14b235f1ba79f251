"""One key holding a third of all rows: results stay exact (checked with pandas)."""

import numpy as np
import pandas as pd
import pytest

from tallyframe.operators import abundance as A
from tallyframe.operators import scenario as M


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(11)
    n = 9000
    sample = np.where(np.arange(n) < n // 3, "HOT", np.char.add("s", (rng.integers(0, 300, n)).astype(str)))
    feature = np.char.add("f", rng.integers(0, 400, n).astype(str))
    reads = rng.integers(1, 50, n)
    return pd.DataFrame({"sample": sample, "hash": feature, "n_reads": reads})


def test_index_with_a_hot_sample(spark, skewed):
    got = A.edna_index(spark.createDataFrame(skewed)).toPandas()
    s = skewed.groupby(["sample", "hash"], as_index=False)["n_reads"].sum()
    s["p"] = s["n_reads"] / s.groupby("sample")["n_reads"].transform("sum")
    s["want"] = s["p"] / s.groupby("hash")["p"].transform("max")
    m = got.merge(s, on=["sample", "hash"])
    assert len(m) == len(s) == len(got)
    assert np.allclose(m["index"], m["want"], atol=1e-12)


def test_first_per_key_with_a_hot_key(spark, skewed):
    got = A.first_per_key(spark.createDataFrame(skewed), "sample", [("n_reads", False), "hash"]).toPandas()
    want = skewed.sort_values(["sample", "n_reads", "hash"], ascending=[True, False, True]).groupby("sample").head(1)
    m = got.merge(want, on="sample", suffixes=("", "_w"))
    assert len(m) == skewed["sample"].nunique()
    assert (m["hash"] == m["hash_w"]).all() and (m["n_reads"] == m["n_reads_w"]).all()


def test_rank_sum_with_one_hot_test_key(spark, skewed):
    df = skewed.assign(key=np.where(skewed["sample"] == "HOT", "HOT", "rest"),
                       grp=np.where(skewed.index % 2 == 0, "a", "b"), v=skewed["n_reads"].astype(float))
    got = {r["key"]: r["W"] for r in M.rank_sum_test(spark.createDataFrame(df[["key", "grp", "v"]]),
                                                     "key", "grp", "v", "a", "b").collect()}
    for k, part in df.groupby("key"):
        ranks = part["v"].rank(method="average")
        n1 = int((part["grp"] == "a").sum())
        assert got[k] == pytest.approx(ranks[part["grp"] == "a"].sum() - n1 * (n1 + 1) / 2)
