"""Costly queries deal their rows over tasks, whatever file they lie in."""

import os
import re

import pytest

from amplispark.operators import chemistry, groups, specificity, windows
from amplispark.plans import catalogue, synthetic
from amplispark.plans.sequences import _EIGHTS, _OLIGO_ROWS
from amplispark.plans.synthetic import SITES, view

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["described_changes", "pair_structures", "align_semiglobal", "run_length"])
def test_rows_are_dealt_over_tasks(spark, name):
    assert catalogue.queries()[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["seq_runs_gc", "gap_stats"])
def test_contigs_have_as_many_tasks_as_their_number_needs(spark, monkeypatch, name):
    monkeypatch.setattr(synthetic, "ROWS_A_TASK", 100)
    found = catalogue.queries()[name](spark, SF)
    assert found.rdd.getNumPartitions() == -(-found.count() // 100) > spark.sparkContext.defaultParallelism


def test_runs_of_one_base_are_not_taken_out(spark):
    rows = catalogue.queries()["seq_runs_gc"](spark, SF)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    patterns = re.findall(r"regexp_extract_all\(seq#\d+, (\S+), \d\)", plan)
    assert patterns and not any(re.fullmatch(p, "G") for p in patterns)  # three runs of four are of one base, and each would be a string
    assert "regexp_replace(" not in plan  # nor is each base removed by a match of its own


def test_oligos_and_their_pairs_are_dealt_over_tasks(spark):
    for sql in (_OLIGO_ROWS, _EIGHTS):
        assert view(spark, SF, sql, spread=True).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = chemistry.structures(view(spark, SF, _EIGHTS, spread=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RoundRobinPartitioning") >= 2  # the oligos and the pairs that the join makes


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_pairs_of_sites_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        sites = view(spark, SF, SITES)
        found = specificity.products(sites, per_tier=None, details=True)
        assert exchanges(found) == 3  # left, right and probe sites
        species = view(spark, SF, "SELECT CAST(s_suppkey AS BIGINT) AS taxid, s_name AS name FROM {supplier}")
        assert "left_id" not in "".join(x for x in groups.product_groups(found, sites, species)._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(left_id" in x)
        assert exchanges(groups.product_groups(found, sites, species)) <= 7  # products are grouped where they are; by taxid, species and record
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_cap_that_falls_between_and_within_records(spark):
    site = lambda i, name, role, strand, start: (i, role, "near", name, strand, start, start + 19, 0, 0, 9)
    rows = [site(i * 100, name, "forward", "+", 0) for i, name in enumerate("ABC")] + [site(i * 100 + j, name, "reverse", "-", 30 * j) for i, name in enumerate("ABC") for j in (1, 2, 3)] + [site(299, "C", "probe", "+", 75)]
    sites = spark.createDataFrame(rows, "site_id long, role string, tier string, accession string, orientation string, s_start long, s_end long, mismatches int, gaps int, clean3 int")
    whole = specificity.products(sites, per_tier=None)
    told = {m: tuple(windows.cut_products(whole, m).first()) for m in (1, 3, 5, 6, 8, 9)}
    assert told == {1: ("near", 9, 8, True, False), 3: ("near", 9, 6, True, False), 5: ("near", 9, 4, True, False), 6: ("near", 9, 3, True, False), 8: ("near", 9, 1, True, False), 9: ("near", 9, 0, False, True)}


def test_escape_reasons_are_of_contigs(spark):
    rows = catalogue.queries()["escape_reasons"](spark, SF).collect()
    assert rows and all(x.startswith("GCA_") for r in rows for x in r.examples.split(","))  # found in the contigs, not told by a table


def test_contigs_are_scanned_once_for_outcomes(spark):
    plan = catalogue.queries()["genome_outcome"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # both sides of the join read the sites as they were written


def test_reports_are_parsed_once(spark):
    plan = catalogue.queries()["blast_flatten"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "qseq:" not in plan.split("from_json(")[1].split("\n")[0]


def executed(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        return catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copies_are_dealt_once_by_record(spark):
    plan = executed(spark, "deduplicated_copies")
    assert plan.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in plan  # as many tasks as rows need, and not joined to a few


def test_partners_are_searched_once_and_where_their_anchors_are(spark):
    plan = executed(spark, "partner_scan")
    assert "hashpartitioning(role" not in plan  # two roles would make two tasks
    found = catalogue.queries()["partner_scan"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("MapInArrow") == 3  # anchors, what is known, and one search for partners
    assert found.count("zip_with(") == 1  # an alignment is measured once


def test_blocks_are_folded_where_their_contig_is_read(spark):
    assert "Exchange hashpartitioning(" not in executed(spark, "exact_blocks")


def test_records_are_read_once_around_hits(spark):
    plan = catalogue.queries()["partitioned_copies"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the search, and the scan of what it points to
