"""Spark queries against their DuckDB oracles on the smallest driver data."""

import pytest

from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [
    "flagship_top_feature", "n1_normalize_sample_id", "n4_collapse_counts", "u1_edna_index",
    "u2_edna_index_biol", "d1_stage_summary", "d4_subtract_contamination", "d6_low_read_samples",
    "d7_origin_stats", "d9_occurrence_fate", "d20_equal_width_bins", "d22_centroid_distance",
    "d23_tail_outliers", "u4_dissimilarity", "t1_sequential_join", "t10_contains_any",
    "t17_translate_filter", "t18_threshold_cascade", "d13_presence_pattern", "d15_occupancy_fit",
    "m3_presence_matrix", "m9_score_taxa", "m11_scenario_params", "m14_range_grid", "m24_rank_sum_test",
    "u5_transform_by_sample", "u7_rank_transform", "u9_permanova", "u20_box_stats",
    "u15_simper", "u10_constraint_moments", "m25_hodges_lehmann", "s1_read_runs", "entry2_prepare_model_data",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    ok, msg = compare(E.queries()[name](spark, SF), con, E.oracle_sql()[name])
    assert ok, msg


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["sample", "hash", "edna_index"]
