"""The registered corpus queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import decontamination, dedup, infilling, language_id, nearest, packing, periodic_runs, privacy, quality, substrings, toxicity, url_rules, warc

QUERIES = {
    "op1_fm_decontamination": decontamination.op1_fm_decontamination,
    "op2_prob_minhash": dedup.op2_prob_minhash,
    "op3_byte_cnn_language": language_id.op3_byte_cnn_language,
    "op4_sum_of_squares_packing": packing.op4_sum_of_squares_packing,
    "op5_url_range_join": url_rules.op5_url_range_join,
    "op6_cumulative_link_toxicity": toxicity.op6_cumulative_link_toxicity,
    "op7_kmeans_tree_search": nearest.op7_kmeans_tree_search,
    "op8_warc_index_merge": warc.op8_warc_index_merge,
    "op9_information_sanitisation": privacy.op9_information_sanitisation,
    "op10_weak_label_quality": quality.op10_weak_label_quality,
    "op11_exception_index_infilling": infilling.op11_exception_index_infilling,
    "op12_branching_tandem_runs": periodic_runs.op12_branching_tandem_runs,
    "op13_suffix_array_dedup": substrings.op13_suffix_array_dedup,
}

ORACLES = {
    "op1_fm_decontamination": decontamination.ORACLE,
    "op5_url_range_join": url_rules.ORACLE,
    "op8_warc_index_merge": warc.ORACLE,
    "op11_exception_index_infilling": infilling.ORACLE,
}
