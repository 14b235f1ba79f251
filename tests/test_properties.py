"""Hypothesis properties (few examples each: every example runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyframe.operators import abundance as A
from tallyframe.operators import denoise as D
from tallyframe.operators import taxonomy as T

SET = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.sampled_from(["h1", "h2", "h3", "h4", "h5"]),
                          st.integers(min_value=1, max_value=50)), min_size=1, max_size=25)


@SET
@given(rows)
def test_index_in_unit_interval_with_one_max_per_feature(spark, data):
    df = spark.createDataFrame(data, "sample string, hash string, n_reads long")
    out = A.edna_index(df).collect()
    assert all(0 < r["index"] <= 1 + 1e-12 for r in out)
    best = {}
    for r in out:
        best[r["hash"]] = max(best.get(r["hash"], 0), r["index"])
    assert all(abs(v - 1) < 1e-12 for v in best.values())


@SET
@given(rows, st.lists(st.tuples(st.sampled_from(["h1", "h2", "h3", "h9"]),
                                st.floats(min_value=0, max_value=1)), max_size=4))
def test_subtraction_keeps_positive_counts_only(spark, data, vec):
    df = spark.createDataFrame([(1, s, h, n) for s, h, n in data], "run int, sample string, hash string, n_reads long")
    v = spark.createDataFrame([(1, h, x) for h, x in dict(vec).items()], "run int, hash string, vector_contamination double")
    out = D.subtract_contamination(df, v).collect()
    orig = {}
    for s, h, n in data:
        orig[(s, h)] = orig.get((s, h), 0) + n
    assert all(0 < r["n_reads"] <= max(orig.values()) for r in out)


@SET
@given(st.lists(st.tuples(st.sampled_from(["s1", "s2", "s3", None]), st.sampled_from(["g1", "g2", None])),
                min_size=1, max_size=10),
       st.lists(st.tuples(st.sampled_from(["s1", "s2", "s4"]), st.sampled_from(["g1", "g2", "g3"]),
                          st.sampled_from(["x", "y"])), max_size=8))
def test_sequential_join_keeps_every_left_key(spark, left, right):
    df1 = spark.createDataFrame([(f"k{i}", s, g) for i, (s, g) in enumerate(left)], "key string, species string, genus string")
    df2 = spark.createDataFrame(right, "species string, genus string, trait string")
    out = T.sequential_join(df1, df2, ["species", "genus"], ["trait"]).collect()
    assert {r["key"] for r in out} == {f"k{i}" for i in range(len(left))}
