"""Regressions: steps that once depended on the plan, on label text or on value types."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import model, occupancy, scenario, taxonomy
from tallyframe.operators._util import prefix_sum


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_prefix_sum_without_exchange_reuse(spark, adaptive):
    was = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", "false")
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        n = 1_000_000
        d = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(n))).alias("k"), F.lit(1.0).alias("v")) \
            .groupBy("k").agg(F.sum("v").alias("v"))
        p = prefix_sum(d, [], ["k"], "v")
        total = d.agg(F.sum("v")).first()[0]
        # exclusive sums in order: the next row's sum is this one's and its value
        back = p.select("k", "v", "prefix", (F.col("prefix") + F.col("v")).alias("next"))
        ends = back.select("next").exceptAll(back.select(F.col("prefix").alias("next"))).collect()
        assert [r.next for r in ends] == [total]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_rank_sum_far_tail(spark):
    d = spark.range(400).select(F.lit(1).alias("site"), F.when(F.col("id") < 200, "a").otherwise("b").alias("g"), F.col("id").cast("double").alias("x"))
    r = scenario.rank_sum_test(d, "site", "g", "x", "a", "b").first()
    assert r.z < -15 and 0 < r.p < 1e-50


def test_select_taxa_takes_regular_expressions(spark):
    d = spark.createDataFrame([("Gymnodinium",), ("Alexandrium",), ("Zzz",)], "taxon string")
    assert {r.taxon for r in scenario.select_taxa(d, "taxon", "Gym|Zzz").collect()} == {"Gymnodinium", "Zzz"}


def test_years_outside_the_window_raise(spark):
    with pytest.raises(ValueError):
        scenario.scenario_params(spark.createDataFrame([("A", 1.0, 8.0)], "area string, temperature double, ph double"), [1990, 2017])


def test_sequential_join_of_numbers(spark):
    a = spark.createDataFrame([("x", "g1"), ("y", "g2")], "species string, genus string")
    b = spark.createDataFrame([("x", "g1", 3), ("q", "g2", 1), ("r", "g2", 2)], "species string, genus string, trait int")
    got = {r.species: r.trait for r in taxonomy.sequential_join(a, b, ["species", "genus"], ["trait"]).collect()}
    assert got == {"x": "3", "y": "undetermined"}


def test_pattern_representatives_without_sites(spark):
    p = spark.createDataFrame([("h2", 3, 1, "3.1"), ("h1", 3, 1, "3.1")], "hash string, n0 int, n1 int, pattern string")
    assert [tuple(r) for r in occupancy.pattern_representatives(p).collect()] == [("3.1", 3, 1, "h1")]


def test_response_model_with_bars_in_labels(spark):
    rows = [("f|g|", f"A{i % 2}", float(i % 3), float(i % 5), i % 2) for i in range(40)]
    d = spark.createDataFrame(rows, "taxon string, area string, temperature double, ph double, presence int")
    coef, _, _ = model.taxon_response_model(d, max_iter=5)
    assert {(r.taxon, r.area) for r in coef.collect()} == {("f|g|", "A0"), ("f|g|", "A1")}
