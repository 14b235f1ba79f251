"""Steps that met their limits on larger tables: what they return and what their plans hold."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import abundance as A
from tallyframe.operators import denoise as D
from tallyframe.operators import taxonomy as T
from tallyframe.operators._util import product_by, with_group_agg, with_group_total
from tallyframe.plans import chain as C
from test_plans import plan

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_group_totals_are_broadcast_and_equal_the_window(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), (None, 1, 5), (None, 2, None), ("b", None, 7)], "s string, r int, n long")
    for most in (100, 1):  # few groups are broadcast, more take the window
        assert rows(with_group_total(df, ["s", "r"], max_rows=most, t=F.sum("n"))) == rows(with_group_agg(df, ["s", "r"], t=F.sum("n")))
    assert "Window" not in plan(with_group_total(df, "s", t=F.sum("n")))


def test_subtraction_and_index_sort_no_sample(spark):
    df = spark.createDataFrame([(1, f"e{i % 3}", f"b{i % 2}", f"h{i % 7}", i) for i in range(1, 60)] + [(1, "e1", None, "h1", 4)],
                               "run int, event string, biol string, hash string, n_reads long")
    vec = spark.createDataFrame([(1, "h1", 0.01), (1, "h2", 1.0)], "run int, hash string, vector_contamination double")
    sub = D.subtract_contamination(df.withColumnRenamed("event", "sample"), vec)
    assert "Window" not in plan(sub)
    idx = A.edna_index(df, "event", "hash", "n_reads", biol_rep="biol", out="i")
    assert "collect_set" not in plan(idx)  # a sample's replicates are not gathered beside each of its rows
    p, tot, reps = {}, {}, {}
    for _, e, b, _, n in df.collect():
        tot[e, b] = tot.get((e, b), 0) + n
        reps.setdefault(e, set()).update({b} - {None})
    for _, e, b, h, n in df.collect():
        p[e, h] = p.get((e, h), 0) + n / tot[e, b] / len(reps[e])
    top = {h: max(v for (_, g), v in p.items() if g == h) for _, h in p}
    assert {(e, h): i for e, h, i in idx.collect()} == pytest.approx({(e, h): v / top[h] for (e, h), v in p.items()})


def test_steps_of_the_chain_are_stored_as_columns(spark):
    C.reset()
    assert "Scan parquet" in plan(C.step1(spark, SF))
    assert "Window" not in plan(C.step4(spark, SF))
    C.reset()


def test_sequential_join_repeats_equal_rows_and_spreads_the_left(spark):
    left = spark.createDataFrame([(1, "s", "g"), (2, "s", "g"), (3, None, "g"), (4, "x", "y")], "id int, sp string, ge string")
    right = spark.createDataFrame([("s", "g", 1), ("s", "g", 1), ("s", "g", None), (None, "g", 2), ("t", "z", 3)], "sp string, ge string, v int")
    out = T.sequential_join(left, right, ["sp", "ge"], "v")
    want = [(i, "s", "g", v, "sp") for i in (1, 2) for v in ("1", "1", None)] + [(3, None, "g", "undetermined", "ge"), (4, "x", "y", None, None)]
    assert rows(out) == sorted(want, key=repr)
    assert "RoundRobinPartitioning" in plan(out)


def test_terms_are_met_before_equal_ones_are_dropped(spark):
    df = spark.createDataFrame([(1, "a b a b"), (1, "b"), (2, "c"), (3, None)], "k int, x string")
    out = T.contains_any(df, "k", "x", spark.createDataFrame([("a b",), ("b",), ("a  b",)], "term string"))
    assert rows(out) == [("a b", 1), ("b", 1)] and out.columns == ["term", "k"]
    assert "RoundRobinPartitioning" in plan(out)


def test_hodges_lehmann_meets_equal_values_once(spark, monkeypatch):
    import numpy as np
    from tallyframe.operators import scenario as M
    x, y = np.repeat([1.0, 2.5, 4.0], [400, 300, 50]), np.repeat([0.5, 2.0, 3.0, 7.0], [100, 200, 150, 30])
    df = spark.createDataFrame([("k", "a", float(v)) for v in x] + [("k", "b", float(v)) for v in y], "test string, g string, x double")
    seen, below = [], M._below_counts
    monkeypatch.setattr(M, "_below_counts", lambda xs, ys, keys: seen.append(xs.count()) or below(xs, ys, keys))
    got = M.hodges_lehmann(df, "test", "g", "x", "a", "b", fan=8, band_rows=200_000).first()["hl"]
    assert got == np.median(np.subtract.outer(x, y))
    assert seen and max(seen) <= 3 * 8 * 2  # values x candidates x targets


def parts(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_pieces_of_a_product_are_dealt_to_many_tasks(spark):
    a = spark.createDataFrame([("k", i) for i in range(80)], "k string, i int")
    b = spark.createDataFrame([("k", -i) for i in range(80)] + [(None, 1)], "k string, j int")
    out = product_by(a, b, "k", rows=20)
    assert out.distinct().count() == out.count() == 80 * 80
    assert parts(out) >= 5  # of 16 pieces; their bytes fit one partition


def test_zeros_of_a_dense_table_come_from_many_tasks(spark):
    df = spark.createDataFrame([(f"e{i % 5}", f"t{i}", 1.0) for i in range(3000)], "event string, taxon string, v double")
    out = A.densify(df, "event", "taxon", "v")
    assert out.count() == out.select("event", "taxon").distinct().count() == 5 * 3000
    assert out.agg(F.sum("v")).first()[0] == 3000
    assert parts(out.where("v = 0")) >= 4


def test_index_reads_its_rows_once(spark):
    df = spark.createDataFrame([("e", "x", "h", 3), ("e", "x", "h", 1), ("e", None, "g", 4)], "event string, biol string, hash string, n_reads long")
    idx = A.edna_index(df, "event", "hash", "n_reads", biol_rep="biol", out="i")
    assert "ExistingRDD" not in plan(idx)  # totals and shares both come from the stored sums
    assert rows(idx) == [("e", "g", 1.0), ("e", "h", 1.0)]


def test_reads_are_summed_per_hash_before_they_meet_the_annotation(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 4), (None, 8), ("c", None)], "hash string, n_reads long")
    annot = spark.createDataFrame([("a", "PLK"), ("a", "BEN"), ("b", None), (None, "PLK"), ("c", "BEN")], "hash string, status string")
    out = T.reads_by_status(df, annot)
    assert rows(out) == [("BEN", 2, 3), ("PLK", 1, 3), ("unassigned", 1, 12)]
    assert "Aggregate [hash" in out._jdf.queryExecution().optimizedPlan().toString()
