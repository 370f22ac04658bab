"""Queries over pairs, matrices and plans leave no row of their tables out."""

import os

from pyspark.sql import functions as F

from amplispark.functions import seq
from amplispark.operators import reports
from amplispark.plans import catalogue
from amplispark.plans.sequences import DEGENERATE
from amplispark.plans.synthetic import view

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def keys(spark):
    return [r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_partkey").cast("long")).collect()]


def run(spark, name):
    return catalogue.queries()[name](spark, SF)


def test_all_oligos_are_paired(spark):
    sizes = {}
    for k in keys(spark):
        sizes[k // 8] = sizes.get(k // 8, 0) + 1
    assert max(sizes.values()) <= 8
    assert run(spark, "qc_pairs").count() == sum(n * (n - 1) // 2 for n in sizes.values())


def test_all_oligos_are_in_the_matrix(spark):
    m = run(spark, "qc_pivot")
    checks = m.select("check").distinct().count()
    cells = sum(x is not None for r in m.select(*[str(i) for i in range(8)]).collect() for x in r)
    assert cells == checks * len(keys(spark))


def test_all_oligos_are_planned(spark):
    concrete = view(spark, SF, DEGENERATE).agg(F.sum(F.size(seq.expand(F.col("sequence"))))).first()[0]
    assert {r.searches for r in run(spark, "planned_searches").collect()} == {concrete}


def test_equal_sequences_of_two_oligos_are_two_requests(spark):
    oligos = spark.createDataFrame([("a", "ACGT"), ("b", "ACGN")], "oligo string, sequence string")
    tiers = spark.createDataFrame([("near", 1)], "tier string, taxid long")
    rows = reports.planned_searches(oligos, tiers).collect()
    assert sorted((r.label, r.sequence) for r in rows) == [("a", "ACGT"), ("b_v1", "ACGA"), ("b_v2", "ACGC"), ("b_v3", "ACGG"), ("b_v4", "ACGT")]
    assert len({r.key for r in rows}) == 5
