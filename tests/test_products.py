import os

from compare import oracle, rows

from amplispark.operators import specificity, windows
from amplispark.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_cut_sees_products_beyond_the_cap(spark):
    site = lambda i, role, strand, start: (i, role, "near", "A", strand, start, start + 19, 0, 0, 9)
    rows = [site(0, "forward", "+", 0), *(site(i, "reverse", "-", 30 + i) for i in range(1, 511)), site(999, "probe", "+", 515)]
    sites = spark.createDataFrame(rows, "site_id long, role string, tier string, accession string, orientation string, s_start long, s_end long, mismatches int, gaps int, clean3 int")
    whole = specificity.products(sites, per_tier=None)
    r = windows.cut_products(whole, 500).first()
    assert (r.products, r.cut, r.truncated, r.harmless) == (510, 10, True, False)  # the probe lies inside of the longest products only
    r = windows.cut_products(whole.where("probe_id IS NULL"), 400).first()
    assert (r.cut, r.truncated, r.harmless) == (84, True, True)
    r = windows.cut_products(whole, 510).first()
    assert (r.products, r.cut, r.truncated, r.harmless) == (510, 0, False, True)


def test_sites_that_share_an_id_are_looked_up_by_it(spark, tmp_path):
    lines = oracle(SF).sql("SELECT * REPLACE (CASE WHEN l_orderkey % 97 = 5 THEN min(l_extendedprice) OVER (PARTITION BY l_orderkey) ELSE l_extendedprice END AS l_extendedprice) FROM lineitem")
    lines.write_parquet(str(tmp_path / "lineitem.parquet"))
    for t in os.listdir(SF):
        if t != "lineitem.parquet":
            os.symlink(f"{SF}/{t}", tmp_path / t)
    got, want = (catalogue.queries()["products_by_species"](spark, str(tmp_path)).toPandas(), oracle(str(tmp_path)).sql(catalogue.oracle_sql()["products_by_species"]).df())
    assert rows(got) == rows(want)
