"""Pairs of a product that are scored, drawn and summed in pieces, against the same pairs as rows."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import draws as R
from tallyframe.operators import product
from tallyframe.operators import scenario as M
from tallyframe.operators._util import product_by
from tallyframe.plans.analysis import project_scenarios
from test_plans import plan


def test_places_of_all_pairs():
    heads = ["", "é|", "t1|x|", "t2|x|", *("y" * n for n in range(1, 140, 9))]
    tails = ["9", "2017|1|9", "2017|1000|9", "z" * 44, "z" * 45, "w" * 70]
    high, low = R.md5_places(R.Texts.of(pa.array(["cut", *heads])[1:]), R.Texts.of(pa.array(tails)))
    first = [[hashlib.md5((h + t).encode()).hexdigest()[:13] for t in tails] for h in heads]
    assert [[f"{int(a) << 20 | int(b):013x}" for a, b in zip(x, y)] for x, y in zip(high, low)] == first
    assert R.uniform(high, low)[2, 1] == (int(first[2][1], 16) + 0.5) / 2**52


@pytest.mark.parametrize("n", [1, 100, 512])
def test_binomial_by_table(n):
    g = np.random.default_rng(n)
    p = np.concatenate([g.random(50_000), np.arange(4097) / 4096, [0.0, 1.0, np.nan, 1e-300, 1 - 1e-9, np.nextafter(0.5, 1), np.nextafter(0.5, 0)]])
    high, low = g.integers(0, 2**32, len(p)).astype(np.uint32), g.integers(0, 2**20, len(p)).astype(np.uint32)
    high[:50], high[50:100] = 0, 2**32 - 1
    got = R.binomial_at(high, low, p, n)
    assert np.array_equal(got, R.binomial_inverse(R.uniform(high, low), p, n), equal_nan=True)
    assert not np.isnan(got[:-5]).any()


@pytest.mark.parametrize("n", [50, 600])
def test_sums_in_pieces_equal_the_rows(spark, monkeypatch, n):
    monkeypatch.setattr(product, "LEAST_A", 4)
    monkeypatch.setattr(product, "PIECE_A", 4)
    monkeypatch.setattr(product, "PIECE_B", 3)
    a = [(f"t{i}" if i % 9 else None, "xy"[i % 2], i / 5 - 2, 0.3 * i, None if i == 7 else -0.1, f"g{i % 4}" if i % 4 else None) for i in range(24)]
    a += [a[2], a[2], ("nan", "x", float("nan"), 0.0, 0.0, "alone"), ("none", "y", None, 0.0, 0.0, "g1"), ("far", "x", 900.0, 0.0, 0.0, "g2"),
          ("far", "y", -900.0, 0.0, 0.0, "g2"), ("half", "x", 0.0, 0.0, 0.0, "g2"), ("no area", None, 0.0, 0.0, 0.0, "g1"), ("other", "z", 0.0, 0.0, 0.0, "g1")]
    a = spark.createDataFrame(a, "taxon string, area string, intercept double, b_t double, b_ph double, phylum string")
    b = [("xy"[i % 2], 2017, i, i / 3, 8.0) for i in range(17)] + [("x", 2017, 2, 2 / 3, 8.0), ("y", 2017, 99, None, 8.0), (None, 2017, 1, 0.0, 8.0), ("w", 2017, 1, 0.0, 8.0)]
    b = spark.createDataFrame(b, "area string, year int, draw int, temperature double, ph double")
    keys, points = ["taxon", "area", "year", "draw"], ["area", "year", "draw"]
    eta = F.col("intercept") + F.col("b_t") * F.col("temperature") + F.col("b_ph") * F.col("ph")
    laid = M.binomial_mean(product_by(a, b, "area").withColumn("p", 1.0 / (1.0 + F.exp(-eta))), "p", keys, n, 5)
    want = {(*r[:4],): (r.richness, r.total) for r in M.richness_by_point(laid, points, "phylum", "mean_presence").collect()}
    pairs = product_by(a, b, "area", laid_out=False).with_value("p", M.logistic_of_pairs())
    out = M.richness_by_point(M.binomial_mean(pairs, "p", keys, n, 5), points, "phylum", "mean_presence")
    got = {(*r[:4],): (r.richness, r.total) for r in out.collect()}
    assert out.columns == [*points, "phylum", "richness", "total"] and set(got) == set(want) and len(want) > 50
    assert any(v == (None, None) for v in want.values()) and want["x", 2017, 4, "alone"][0] is None
    for k, v in want.items():
        assert [x if x is None else round(x, 9) for x in got[k]] == [x if x is None else round(x, 9) for x in v]
    with pytest.raises(ValueError):
        M.binomial_mean(pairs, "p", ["draw", "taxon"], n, 5)


def test_a_piece_returns_its_sums_bit_by_bit(monkeypatch):
    monkeypatch.setattr(product, "PAIRS", 12)
    monkeypatch.setattr(product, "OUT_ROWS", 5)
    g = np.random.default_rng(3)
    x, y, group = g.integers(0, 9, 40) / 1.0, g.integers(0, 9, 4) / 1.0, [None if i % 7 == 0 else i % 5 for i in range(40)]
    x[3] = np.nan
    a = pa.StructArray.from_arrays([pa.array(x), pa.array(group)], ["x", "__group"])
    b = pa.StructArray.from_arrays([pa.array(y), pa.array(range(4))], ["y", "__point0"])
    found = list(product._sums(a, b, (("v", lambda a, b, values: a["x"] * b["y"]),), "v", 1))
    assert len(found) > 2 and max(r.num_rows for r in found) <= 8
    got = {(r["__point0"], r["__group"]): r["__sum"] for f in found for r in f.to_pylist()}
    assert got == {(j, k): sum(x[i] * y[j] for i in range(40) if group[i] == k and i != 3) for j in range(4) for k in set(group)}


def test_scored_pairs_are_no_rows_of_the_plan(spark):
    env = spark.createDataFrame([("P", 9 + i * 0.4, 7.9 + 0.05 * i) for i in range(8)], "area string, temperature double, ph double")
    coef = spark.createDataFrame([(f"t{i}", "P", 0.1, 0.1, -0.1) for i in range(40)], "taxon string, area string, intercept double, b_t double, b_ph double")
    out = project_scenarios(env, coef, spark.createDataFrame([("t1", "A")], "taxon string, phylum string"), [2017], 30, 4, 50)
    assert "MapInArrow" in plan(out) and "ArrowEvalPython" not in plan(out) and "md5" not in plan(out).split("MapInArrow")[0]
    assert out.where("phylum is null and richness > 0").count() > 20
