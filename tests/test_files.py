"""The cache's protocol, tables of Markdown files, and the audit of rules with a planted contradiction."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from amplispark.operators import audit, taxonomy
from amplispark.plans import catalogue
from amplispark.sources import cache, tables

def now(days=0):
    return F.expr(f"TIMESTAMP '2024-06-01 00:00:00' - INTERVAL {days} DAYS")


def rows(spark, *entries):
    return spark.createDataFrame(entries, "kind string, key string, text string")


def held(spark, root, days=None, *keys):
    return {(r.kind, r.key): r.text for r in cache.get(spark.createDataFrame([k for k in keys], "kind string, key string"), root, days, now()).collect()}


def test_newest_fresh_entry(spark, tmp_path):
    root, a, b = str(tmp_path / "c"), ("w", "a"), ("w", "b")
    assert held(spark, root, None, a) == {a: None}
    cache.put(rows(spark, ("w", "a", "old"), ("w", "b", "b"), ("w", "n", None)), root, now(9))
    cache.put(rows(spark, ("w", "a", "new"), ("x", "a", "other kind")), root, now(1))
    assert held(spark, root, None, a, b, ("w", "n")) == {a: "new", b: "b", ("w", "n"): None}
    assert held(spark, root, 5, a, b) == {a: "new", b: None} and held(spark, root, 0.5, a) == {a: None}


def test_a_writer_that_dies_leaves_nothing_to_see(spark, tmp_path):
    root = str(tmp_path / "c")
    cache.put(rows(spark, ("w", "a", "kept")), root, now())
    fails = F.udf(lambda t: 1 / 0 if t == "bad" else t)
    with pytest.raises(Exception, match="ZeroDivision"):
        cache.put(rows(spark, ("w", "a", "x"), ("w", "b", "bad")).repartition(2).withColumn("text", fails("text")), root, now())
    staged = cache.stage(rows(spark, ("w", "a", "never committed")), root, now())
    assert held(spark, root, None, ("w", "a"), ("w", "b")) == {("w", "a"): "kept", ("w", "b"): None}
    cache.commit(spark, staged)
    assert cache.entries(spark, root).count() == 2


def test_damaged_entries_are_misses(spark, tmp_path):
    root = str(tmp_path / "c")
    first = cache.put(rows(spark, ("w", "a", "cut")), root, now())
    second = cache.put(rows(spark, ("w", "b", "changed")), root, now())
    cache.put(rows(spark, ("w", "c", "whole")), root, now())
    for f in glob.glob(f"{first}/*.parquet"):
        os.truncate(f, os.path.getsize(f) // 2)
    changed = spark.read.parquet(second).withColumn("text", F.lit("forged")).collect()
    spark.createDataFrame(changed, cache.SCHEMA).write.mode("overwrite").parquet(second)
    for f in glob.glob(f"{root}/batch-*/.*.crc"):
        os.remove(f)
    assert held(spark, root, None, ("w", "a"), ("w", "b"), ("w", "c")) == {("w", "a"): None, ("w", "b"): None, ("w", "c"): "whole"}


def test_keys(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("a", None)], "x string, y string")
    got = [r.k for r in df.select(cache.content_key(F.col("x"), F.col("y")).alias("k")).collect()]
    assert got[0] == got[3] and len(set(got)) == 3


PAGE = r"""# Panel
| Name | Taxid | Note |
|:-----|:-----:|-----:|
| [Candida auris](https://x/y) | 498019 | **new** |
| a \| b | | `code` |
|Escherichia coli|562

no | table | here
more | text

Name | Group
--- | ---
Giardia_x | _p_ | too | many
# comment | x
"""


def test_markdown_tables(spark, tmp_path):
    (tmp_path / "p.md").write_text(PAGE)
    (tmp_path / "empty.md").write_text("")
    got = tables.read_markdown_tables(spark, str(tmp_path))
    assert sorted((r.table, r.row, r.cells) for r in got.collect()) == [
        (1, 1, {"Name": "Candida auris", "Taxid": "498019", "Note": "new"}), (1, 2, {"Name": "a | b", "Taxid": "", "Note": "code"}), (1, 3, {"Name": "Escherichia coli", "Taxid": "562"}),
        (2, 1, {"Name": "Giardia_x", "Group": "p"}), (2, 2, {"Name": "# comment", "Group": "x"}),
    ]
    names = tables.listed_names(got, "Name")
    known = spark.createDataFrame([("Candida auris", 498019), ("a | b", 1), ("a | b", 2)], "name string, taxid long")
    found = taxonomy.resolve_names(names, known, spark.createDataFrame([("Giardia_x", 7)], "name string, taxid long")).collect()
    assert {r.name: (r.status, r.taxid) for r in found} == {"Candida auris": ("resolved", 498019), "a | b": ("ambiguous", None), "Escherichia coli": ("unresolved", None), "Giardia_x": ("resolved", 7)}


def test_violations_are_found(spark):
    oligo = "GACCCCAAAATCAGCGAAAT"
    site = oligo[:16] + "T" + oligo[17:]
    hit = audit.partial_hits(spark.createDataFrame([(oligo, site), (oligo, oligo), (oligo, "T" + oligo[1:])], "oligo_seq string, site string")).collect()
    assert [(r.u5, r.u3, r.lower_bound) for r in hit] == [(0, 4, 1), (0, 0, 0), (1, 0, 1)]
    cases = [(1, "forward", oligo, "TT" + site + "GG", 4, 1), (2, "forward", oligo, "TT" + site + "GG", 4, 3), (3, "forward", oligo, "TT" + oligo + "GG", 4, 0), (4, "forward", oligo, "TT" + site + "GG", 4, 9), (5, "probe", oligo, None, 0, 0)]
    got = audit.rule_violations(spark.createDataFrame(cases, "id int, role string, oligo_seq string, window string, u3 int, lower_bound int")).collect()
    assert sorted((r.id, r.check) for r in got) == [(2, "lower_bound"), (3, "first_unaligned_base"), (4, "lower_bound"), (4, "ruled_out_but_relevant")]


def test_only_what_a_search_reports_is_audited(spark, tmp_path):
    # Orders whose contigs have chance sites beside a better one, with stretches that are too short to be relevant or hold no word of a search.
    keys = "249161L, 276691L, 355278L, 486087L, 640583L, 686340L, 791543L"
    orders = spark.sql(f"SELECT explode(array({keys})) AS o_orderkey, 1L AS o_custkey, TIMESTAMP '2020-01-01 00:00:00' AS o_orderdate, '1-URGENT' AS o_orderpriority")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    assert catalogue.queries()["rule_violations"](spark, str(tmp_path)).collect() == []
    oligo = "GACCCCAAAATCAGCGAAAT"
    short, wordless = "GACCCCAAAGACCCCAAAAT", "CACCCCACAATTAGCGAATA"
    hit = audit.partial_hits(spark.createDataFrame([(oligo, short), (oligo, wordless), (oligo, oligo)], "oligo_seq string, site string")).collect()
    assert [(r.site, r.identity) for r in hit] == [(short, 9), (oligo, 20)]


def test_a_relevant_hit_that_a_gap_completes_is_a_violation(spark):
    oligo = "GACCCCAAAATCAGCGAAAT"
    site = "GACCCCACAATCTGCGAATG"  # seven, four and five bases, then an A less
    rows = spark.createDataFrame([("forward", oligo, site, "TT" + site + "GG")], "role string, oligo_seq string, site string, window string")
    hit = audit.partial_hits(rows)
    assert [(r.identity, r.u5, r.u3) for r in hit.collect()] == [(16, 0, 2)]
    assert {r.check for r in audit.rule_violations(hit).collect()} == {"first_unaligned_base", "ruled_out_but_relevant"}
