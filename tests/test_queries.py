"""Every registered query against its SQL on the smallest tables (rows only where SQL has none)."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from oracle import compare, connect

from plumbline.plans import load_all

# Queries SQL cannot state, and the test that checks their answers instead; a query in neither place fails.
TESTED_IN = {
    "o8_ipw_effect": "test_reports.py::test_propensities_of_a_saturated_model", "o8_overlap_histogram": "test_reports.py::test_propensities_of_a_saturated_model",
    "q2_mcdonald_omega": "test_reports.py::test_omega_recovers_a_one_factor_model", "d25_dictionary": "test_reports.py::test_dictionary_lists_values_ranges_and_codes",
    "d46_preview": "test_reports.py::test_preview_shows_ends_and_commonest", "d2_minimal_key_lineitem": "test_checks.py::test_key_search_and_missing_key",
    "s2_disciplined_slice": "test_checks.py::test_planted_cause_is_found_and_nothing_else", "a7_round_trip": "test_sources_streams.py::test_round_trip_names_the_changes",
    "a9_digest_manifest": "test_sources_streams.py::test_manifest_hashes_files", "a14_stale_outputs": "test_sources_streams.py::test_stale_outputs_tells_folders_apart",
    "c19_one_to_one": "test_linkage.py::test_assignment_is_optimal", "c20_multi_pass": "test_linkage.py::test_multi_pass_takes_easy_matches_first",
    "c21_tfidf_documents": "test_linkage.py::test_tfidf_equals_brute_force", "r1_tell_counts_all_families": "test_checks.py::test_tells_ignore_quotes_and_need_clusters",
    "r2_tell_clusters": "test_checks.py::test_tells_ignore_quotes_and_need_clusters",
    "n4_cr2": "test_regress.py::test_cr2_matches_definition", "n5_wild_cluster_bootstrap": "test_regress.py::test_wild_bootstrap_matches_refits",
    "n6_randomisation_inference": "test_regress.py::test_randomisation_of_clusters_against_all_assignments", "n6_randomisation_rows": "test_regress.py::test_randomisation_equals_refits",
    "n7_ladder_verdict": "test_regress.py::test_ladder_verdicts", "n9_cluster_bootstrap": "test_regress.py::test_unit_bootstrap_equals_weighted_refits",
    "n9_two_sample_bootstrap": "test_regress.py::test_two_sample_bootstrap_equals_weighted_refits", "m8_bootstrap_draws_usable": "test_regress.py::test_unusable_draws_are_counted",
    "n11_leave_one_cluster_out": "test_regress.py::test_leave_one_cluster_out", "n13_within_two_way": "test_regress.py::test_within_equals_dummies",
    "n16_benjamini_hochberg": "test_regress.py::test_benjamini_hochberg_both_paths", "n17_romano_wolf": "test_regress.py::test_romano_wolf_orders",
}
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def outcomes(spark):
    """Problems per query. Small jobs leave cores idle, so several queries run at once."""
    con = connect(FOLDER)

    def run(name):
        try:
            df = QUERIES[name](spark, FOLDER)
            if name in ORACLES:
                return compare(df, ORACLES[name], con.cursor())
            df.collect()
            where, _, test = TESTED_IN.get(name, "").partition("::")
            text = open(os.path.join(os.path.dirname(__file__), where)).read() if where else ""
            return [] if test and f"def {test}(" in text else ["neither SQL nor a test of its own"]
        except Exception as e:  # noqa: BLE001
            return [f"{type(e).__name__}: {str(e)[:600]}"]

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(QUERIES, pool.map(run, QUERIES)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(outcomes, name):
    assert outcomes[name] == []


def test_entry_points(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
