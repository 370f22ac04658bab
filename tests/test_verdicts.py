"""Every branch of the fragment verdict, and findings of small searches."""

from amplispark.operators import verdicts

YEARS = "run int, year int, detectable long, at_risk long, not_detected long, undetermined long"
RUNS = "run int, last int, undated long, with_region long, complete boolean"


def test_branches(spark):
    cases = {
        1: ([(2020, 97, 1, 2, 0), (2019, 99, 0, 1, 0)], (None, None, None, True), ("PASS", "PASS", "passes", 2019, 2020, 200, "")),
        2: ([(2020, 380, 5, 0, 0), (2019, 23, 5, 2, 0)], (None, None, None, True), ("WARN", "WARN", "year_below", 2019, 2020, 415, "2019")),
        3: ([(2020, 40, 5, 0, 0)], (None, None, None, True), ("INCOMPLETE", "INCOMPLETE", "too_few", 2020, 2020, 45, "")),
        4: ([(2020, 90, 0, 30, 0)], (None, None, None, False), ("INCOMPLETE", "FAIL", "below_fail", 2020, 2020, 120, "2020")),
        5: ([(2020, 90, 10, 0, 0)], (None, None, None, True), ("WARN", "WARN", "below_warn", 2020, 2020, 100, "")),
        6: ([(2020, 100, 0, 0, 40)], (None, None, None, True), ("INCOMPLETE", "INCOMPLETE", "undetermined", 2020, 2020, 100, "")),
        7: ([(2020, 100, 0, 0, 0)], (None, 30, 100, True), ("INCOMPLETE", "INCOMPLETE", "undated", 2020, 2020, 100, "")),
        8: ([], (None, None, None, True), ("INCOMPLETE", "INCOMPLETE", "no_genomes", None, None, 0, "")),
        9: ([(2020, 0, 0, 500, 0), (2018, 100, 0, 0, 0), (2014, 0, 0, 900, 0)], (2018, 0, 100, True), ("PASS", "PASS", "passes", 2018, 2018, 100, "")),
        10: ([(2021, 0, 0, 0, 0), (2020, 100, 0, 0, 0), (2017, 20, 0, 9, 0), (2016, 0, 0, 99, 0)], (None, None, None, True), ("WARN", "WARN", "below_warn", 2017, 2020, 129, "")),
    }
    years = [(run, *y) for run, (ys, _, _) in cases.items() for y in ys]
    runs = [(run, *r) for run, (_, r, _) in cases.items()]
    got = {r.run: r for r in verdicts.fragment_verdict(spark.createDataFrame(years, YEARS), spark.createDataFrame(runs, RUNS)).collect()}
    assert {run: (r.status, r.would_be, r.reason, r["first"], r["last"], r.n, r.years_below) for run, r in got.items()} == {run: c[2] for run, c in cases.items()}
    assert got[4].percent == 75.0 and got[6].low == round(100 * 100 / 140, 6) and got[6].high == 100.0 and got[7].undated_share == 30.0
    free = verdicts.fragment_verdict(spark.createDataFrame(years, YEARS), spark.createDataFrame(runs, RUNS), verdicts.Limits(hold_fail=False))
    assert {r.run: r.status for r in free.collect()}[4] == "FAIL"


def test_findings_of_an_empty_search(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    found = verdicts.Search(
        empty("site_id long, tier string, role string, level string, mismatches int, gaps int, clean3 int, accession string"), empty("tier string, left_id long, right_id long, probe_id long, pattern string"),
        empty("tier string, query string"), empty("tier string, query string, relevant long, assessed long"), empty("tier string, windows long"), empty("tier string"), empty("role string, hits long"),
    )
    got = verdicts.search_findings(found, spark.createDataFrame([("out_of_scope",)], "tier string"), ["near"], {}).collect()
    assert sorted((r.severity, r.code, r.tier, r.n) for r in got) == [("INCOMPLETE", "no_tier", None, 1), ("INCOMPLETE", "unsearched", "near", 1), ("INFO", "scope", None, 1)]


def test_findings_out_of_scope_are_for_information(spark):
    site = "site_id long, tier string, role string, level string, mismatches int, gaps int, clean3 int, accession string"
    sites = [(1, "near", "forward", "critical", 1, 0, 9, "a"), (2, "near", "reverse", "critical", 0, 0, 9, "a"), (3, "near", "forward", "critical", 2, 0, 9, "b"), (4, "out_of_scope", "forward", "warning", 2, 0, 9, "c"), (5, "near", "probe", "critical", 0, 0, 20, "a"), (6, "near", "probe", "minor", 9, 0, 0, "a")]
    found = verdicts.Search(
        spark.createDataFrame(sites, site), spark.createDataFrame([("near", 1, 2, 5, "x"), ("out_of_scope", 7, 8, None, "y")], "tier string, left_id long, right_id long, probe_id long, pattern string"),
        spark.createDataFrame([("out_of_scope", "q")], "tier string, query string"), spark.createDataFrame([("near", "q", 5, 5)], "tier string, query string, relevant long, assessed long"),
        spark.createDataFrame([("near", 2), ("near", 1)], "tier string, windows long"), spark.createDataFrame([("out_of_scope",)], "tier string"), spark.createDataFrame([("forward", 3), ("probe", 0)], "role string, hits long"),
    )
    got = verdicts.search_findings(found, spark.createDataFrame([("near",), ("out_of_scope",)], "tier string"), ["near"], {"near": "x", "human": "far"}).collect()
    assert {(r.severity, r.code, r.tier, r.about, r.n) for r in got} == {
        ("INFO", "scope", None, "near, out_of_scope", 2), ("INFO", "waived", "human", "far", 1), ("INFO", "saturated", "out_of_scope", "q", 1), ("INCOMPLETE", "fetch_failed", "near", None, 3),
        ("WARN", "primer_site_critical", "near", "2", 2), ("WARN", "primer_site_critical_no_product", "near", "3", 1), ("INFO", "primer_site_warning", "out_of_scope", "4", 1), ("INFO", "probe_site_critical", "near", "5", 1),
        ("FAIL", "product_detected", "near", "1 patterns", 1), ("INFO", "product_not_detected", "out_of_scope", "1 patterns", 1), ("INFO", "products_cut", "out_of_scope", None, 1), ("INFO", "primer_only", None, None, 2),
        ("WARN", "intended_target", None, "forward 3, probe 0, reverse 0", 2),
    }
