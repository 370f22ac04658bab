"""Configuration rules (IC-11): a whole configuration passes, and each rule has a change that breaks it and nothing else."""

import copy

import pytest

from amplispark.sources import config

CONFIG = {
    "schema_version": 1,
    "reaction": {"na_mM": 50.0, "mg_mM": 3.0, "dntp_mM": 0.8, "primer_nM": 400.0, "probe_nM": 200.0, "annealing_temp_C": 60.0, "tm_method": "santalucia", "salt_correction": "owczarzy"},
    "thresholds": {
        "primer": {
            "length_nt": {"pass_range": [18, 30], "fail_range": [15, 40]}, "gc_percent": {"pass_range": [40, 60], "fail_range": [30, 70]}, "tm_c": {"pass_range": [58.0, 66.0], "fail_range": [54.0, 70.0]},
            "gc_in_last5": {"min": 1, "max": 3}, "max_run": {"warn_at": 5, "fail_at": 7}, "max_g_run": {"warn_at": 4, "fail_at": 4},
        },
        "probe": {
            "length_nt": {"pass_range": [15, 30], "fail_range": [12, 40]}, "gc_percent": {"pass_range": [30, 80], "fail_range": [30, 80]}, "tm_minus_mean_primer_c": {"pass_range": [5.0, 12.0], "fail_range": [0.0, 15.0]},
            "max_run": {"warn_at": 5, "fail_at": 7}, "max_g_run": {"warn_at": 4, "fail_at": 6},
        },
        "pair": {"primer_tm_diff_c": {"warn_above": 3.0, "fail_above": 6.0}},
        "structures": {"warn_tm_c": 47.0, "fail_tm_c": None},
        "amplicon": {"length_bp": {"pass_range": [50, 150], "fail_range": [40, 300]}, "gc_percent": {"pass_range": [35, 65], "fail_range": [25, 75]}},
    },
    "ncbi": {"max_retries": 5, "backoff_base_s": 2.0, "blast_min_interval_s": 10, "poll_interval_s": 60, "resubmit_after_minutes": 90, "datasets_batch_size": 20, "cache_dir": None},
    "search": {"program": "blastn", "word_size": 7, "expect": 1000, "reward": 1, "penalty": -3, "hitlist_size": 5000, "result_format": "JSON2_S", "max_taxids_per_search": 20, "background_taxids": [9606]},
    "specificity": {
        "off_target_tiers": ["near_neighbours", "background", "exclusivity"], "tier_waivers": {"background": "none near"}, "max_sites_per_query": 2000, "window_padding_nt": 10, "max_amplicon_size": 2000,
        "max_amplicons": 500, "alignment": {"match": 1, "mismatch": -3, "gap_open": 5, "gap_extend": 2}, "probe_binds_if": "critical", "partner_scan_max_windows": 0, "probe_scan_max_products": 1000,
        "primer_site": {"critical": {"max_mismatches": 3, "max_gaps": 0, "min_clean_3prime_nt": 5}, "warning": {"max_mismatches": 5, "max_gaps": 1, "min_clean_3prime_nt": 3}},
        "probe_site": {"critical": {"max_mismatches": 3, "max_gaps": 0, "min_clean_3prime_nt": 0}, "warning": {"max_mismatches": 5, "max_gaps": 1, "min_clean_3prime_nt": 0}},
        "severity": {"primer_site_critical": "WARN", "amplicon_likely_detected": "FAIL"}, "cautious_tiers": ["near_neighbours"],
    },
    "organisms": {"source": "assay", "list_file": None},
    "inclusivity": {"lookback_years": 10, "warn_below_percent": 95, "fail_below_percent": 80, "verdict_window_years": 3, "min_genomes_for_verdict": 100, "max_undetermined_percent": 25, "status_axis": "release"},
    "variants": {
        "source": "datasets", "max_assemblies_per_run": 20000, "flank_nt": 50, "seed_length": 16, "seed_step": 2, "blast_max_records_per_run": 5000, "blast_records_per_search": 100, "probe_channels": "any",
        "multicopy_unassembled": "auto", "judge_from_parts": "detectable", "min_copy_identity": 0.75, "min_anchored_bases": 32, "min_context_bases": 32, "min_identity_anchored_bases": 16, "max_indel": 150,
    },
}

BROKEN = [
    ("thresholds.primer.tm_c", {"pass_range": [50, 66], "fail_range": [54, 70]}), ("thresholds.primer.gc_percent", {"pass_range": [60, 40], "fail_range": [30, 70]}),
    ("thresholds.probe.length_nt", {"pass_range": [15, 30], "fail_range": [20, 25]}), ("thresholds.amplicon.length_bp", {"pass_range": [50, 150], "fail_range": [300, 40]}),
    ("thresholds.amplicon.gc_percent", {"pass_range": [35], "fail_range": [25, 75]}), ("thresholds.probe.tm_minus_mean_primer_c", 5), ("thresholds.primer.max_run", {"warn_at": 7, "fail_at": 5}),
    ("thresholds.probe.max_g_run", {"warn_at": 4}), ("thresholds.pair.primer_tm_diff_c", {"warn_above": 7, "fail_above": 6}), ("thresholds.primer.gc_in_last5", {"min": 4, "max": 3}),
    ("reaction.na_mM", -1), ("reaction.mg_mM", -0.1), ("reaction.primer_nM", 0), ("reaction.probe_nM", -5), ("reaction.tm_method", "other"), ("schema_version", 2),
    ("ncbi.blast_min_interval_s", 9), ("ncbi.poll_interval_s", 59), ("ncbi.resubmit_after_minutes", -1), ("ncbi.max_retries", -1), ("ncbi.backoff_base_s", 0), ("ncbi.datasets_batch_size", 101),
    ("search.hitlist_size", 0), ("search.max_taxids_per_search", 0), ("search.reward", 0), ("search.penalty", 0), ("search.background_taxids", [9606, 0]), ("search.word_size", 8), ("search.result_format", "XML"),
    ("specificity.alignment.match", 0), ("specificity.alignment.mismatch", 0), ("specificity.alignment.gap_open", -1), ("specificity.alignment.gap_extend", 0),
    ("specificity.primer_site.warning.max_mismatches", 2), ("specificity.probe_site.critical.max_gaps", 2), ("specificity.primer_site.warning.min_clean_3prime_nt", 6),
    ("specificity.off_target_tiers", ["target"]), ("specificity.off_target_tiers", ["background", "background"]), ("specificity.cautious_tiers", ["x"]), ("specificity.tier_waivers", {"background": " "}),
    ("specificity.max_amplicons", 0), ("specificity.window_padding_nt", -1), ("specificity.partner_scan_max_windows", -1), ("specificity.probe_scan_max_products", -1), ("specificity.severity.amplicon_likely_detected", "BAD"),
    ("specificity.probe_binds_if", "minor"), ("organisms.source", "none"), ("inclusivity.lookback_years", 0), ("inclusivity.verdict_window_years", -1), ("inclusivity.min_genomes_for_verdict", 0),
    ("inclusivity.max_undetermined_percent", 101), ("inclusivity.fail_below_percent", 96), ("inclusivity.status_axis", "year"), ("variants.blast_max_records_per_run", 0), ("variants.blast_records_per_search", 0),
    ("variants.max_assemblies_per_run", 0), ("variants.flank_nt", -1), ("variants.seed_length", 7), ("variants.seed_step", 0), ("variants.min_copy_identity", 1.1), ("variants.min_context_bases", 0), ("variants.max_indel", 0),
    ("variants.source", "files"),
]


def test_a_whole_configuration_passes():
    assert config.cross_field_errors(CONFIG) == [] and config.cross_field_errors({}) == []
    assert config.cross_field_errors({"reaction": {"mg_mM": 0}}) == []


@pytest.mark.parametrize(("path", "value"), BROKEN)
def test_each_rule(path, value):
    broken = copy.deepcopy(CONFIG)
    *sections, last = path.split(".")
    at = broken
    for x in sections:
        at = at[x]
    at[last] = value
    (error,) = config.cross_field_errors(broken)
    assert path in error
