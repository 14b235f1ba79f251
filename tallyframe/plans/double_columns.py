"""Double-valued output columns of each oracle-checked query (generated from the
Spark schemas); both sides round them the same way before comparison."""

DOUBLE_COLUMNS = {
    "m10_bernoulli_mean": ['p', 'mean_presence'],
    "m12_scenario_draws": ['temperature', 'ph'],
    "m12_scenario_draws_std": ['temperature', 'ph'],
    "m7_score_equations": ['n', 'temperature', 'ph'],
    "m16_score_equations": ['n', 'temperature', 'ph'],
    "u9_permanova_p": ['F_obs', 'R2', 'p'],
    "u11_ordination_test": ['F', 'constrained', 'total', 'p'],
    "m18_cluster_prevalence_wide": ['1', '2', '3'],
    "entry2_prepare_model_data": ['temperature', 'ph', 'salinity', 'temperature_std', 'ph_std'],
    "d15_occupancy_fit": ['psi', 'p11', 'p10'],
    "d16_prob_occupancy": ['prob'],
    "d17_attempt_summary": ['mean', 'median', 'max'],
    "d18_broadcast_pattern_result": ['max'],
    "d20_equal_width_bins": ['lo', 'hi', 'weight_sum'],
    "d22_centroid_distance": ['distance'],
    "d22_within_bottle_pairs": ['bray'],
    "d23_tail_outliers": ['distance_to_centroid'],
    "d24_distance_classes": ['value'],
    "d3_contamination_vector": ['vector_contamination'],
    "d5_normal_fit": ['mean', 'sd'],
    "d7_origin_stats": ['positives', 'samples'],
    "flagship_top_feature": ['edna_index'],
    "m11_scenario_params": ['t_mean', 't_sd', 'ph_mean', 'ph_sd'],
    "m14_range_grid": ['temperature', 'ph'],
    "m15_group_ranges": ['temperature_min', 'temperature_max', 'ph_min', 'ph_max'],
    "m17_predict_cluster": ['temperature', 'ph'],
    "m18_cluster_prevalence": ['share'],
    "m19_richness_by_point": ['richness', 'total'],
    "m1_standardize_all": ['salinity_std'],
    "m1_standardize_by_area": ['temperature_std', 'ph_std'],
    "m20_relative_to_max": ['total_rel'],
    "m21_taxon_change": ['diff_AFRICA', 'diff_AMERICA', 'diff_ASIA', 'diff_EUROPE', 'diff_MIDDLE EAST', 'sum_abs'],
    "m23_grid_mean": ['temperature', 'ph', 'p'],
    "m24_rank_sum_test": ['W', 'z'],
    "m25_hodges_lehmann": ['hl'],
    "m26_group_median": ['median'],
    "m27_condition_share": ['mean_p', 'share'],
    "m2_to_from_std": ['temperature_std', 'temperature_back'],
    "m9_score_taxa": ['p'],
    "t14_planktonic_events": ['edna_index'],
    "t15_join_environment": ['edna_index', 'temperature', 'ph', 'salinity'],
    "t16_new_keys_append": ['threshold'],
    "t18_threshold_cascade": ['family_threshold', 'species_threshold'],
    "t19_merge_classifiers": ['threshold'],
    "t20_rank_counts": ['threshold', 'share_low'],
    "u10_constraint_moments": ['m', 'c', 'total_inertia'],
    "u14_cluster_profile": ['temperature', 'ph'],
    "u15_simper": ['average', 'sd', 'ratio', 'ava', 'avb', 'cusum'],
    "u17_top_k_signed": ['average', 'signed'],
    "u19_env_long": ['value'],
    "u1_edna_index": ['edna_index'],
    "u20_box_stats": ['q1', 'median', 'q3'],
    "u21_histogram": ['lo', 'ndensity'],
    "u2_edna_index_biol": ['edna_index'],
    "u3_densify": ['edna_index'],
    "u4_dissimilarity": ['bray', 'jaccard'],
    "u5_transform_by_sample": ['total', 'normalize', 'hellinger', 'pa', 'sqrt'],
    "u6_standardize": ['standardize'],
    "u6_transform_by_taxon": ['max', 'frequency', 'range'],
    "u7_rank_transform": ['rank', 'rrank'],
    "u8_chi_square_log": ['chi_square', 'log'],
    "u9_permanova": ['ss_total', 'ss_within', 'ss_between', 'F', 'R2'],
}
