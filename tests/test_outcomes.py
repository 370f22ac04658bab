import random

import pytest
from pyspark.sql import functions as F

from amplispark.functions import kernels
from amplispark.operators import alignment, chemistry, outcomes
from amplispark.sources import config


def test_structures(spark):
    oligos = [(1, "a", 0, "GGGGGCTTTTGCCCCC"), (1, "b", 1, "AAAAAAAAAAAA"), (2, "c", 0, "GCGCGCGCRC")]
    got = {(r.assay, r.kind, r.label): r for r in chemistry.structures(spark.createDataFrame(oligos, "assay int, oligo string, pos int, sequence string")).collect()}
    assert got[1, "hairpin", "a"].status == "FAIL" and got[1, "hairpin", "a"].tm > 60 and got[1, "hairpin", "a"].variant is None
    assert (got[1, "hairpin", "b"].found, got[1, "hairpin", "b"].status) == (False, "PASS")
    assert got[2, "self_dimer", "c"].variants == 2 and got[2, "self_dimer", "c"].variant is not None
    assert set(got) == {(1, k, x) for k in ("hairpin", "self_dimer") for x in "ab"} | {(1, "hetero_dimer", "a / b"), (2, "hairpin", "c"), (2, "self_dimer", "c")}


def test_changes(spark):
    cases = [
        ("ACGT", "ACGT", "none"), ("ACGT", "ACGA", "-1 T-T"), ("ACGTACGT", "AC--ACGT", "-6 to -5 deleted (2 bases)"), ("ACGTACGT", "A-GTACGT", "-7 deleted"),
        ("AC--GT", "ACTTGT", "2-base insertion between -3 and -2"), ("AC-GT", "ACTGT", "insertion between -3 and -2"), ("ACYT", "ACTN", "-2 Y=T, -1 T=N"), ("ACYT", "ACA.", "-2 Y/A, -1 unaligned"),
        ("A--CGT", "ATT-GT", "2-base insertion between -4 and -3, -3 deleted"),
    ]
    rows = spark.createDataFrame([c[:2] for c in cases], "q string, s string").select("q", "s", outcomes.described_changes(F.col("q"), F.col("s")).alias("c")).collect()
    assert [r.c for r in rows] == [c[2] for c in cases]


def test_probes_inside_products(spark):
    rng = random.Random(2)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    probe = dna(24)
    near = probe[:11] + {"A": "C", "C": "G", "G": "T", "T": "A"}[probe[11]] + probe[12:]
    seqs = [("x", dna(40) + probe + dna(60)), ("y", dna(70) + kernels.reverse_complement(near) + dna(30)), ("z", dna(124))]
    products = [("t", a, n, n + 100, 21, len(s) - 10, None) for n, (a, s) in enumerate(seqs)] + [("t", "x", 8, 9, 21, 100, 5)]
    got = outcomes.probe_in_products(
        spark.createDataFrame(products, "tier string, accession string, left_id long, right_id long, start long, end long, probe_id long"),
        spark.createDataFrame(seqs, "accession string, seq string"), spark.createDataFrame([("p", probe)], "oligo string, oligo_seq string"),
    ).collect()
    assert {(r.accession, r.strand, r.s_start, r.changes) for r in got} == {("x", "+", 20, 0), ("y", "-", 20, 1)}


def test_unknown_labels_are_errors(spark):
    oligos = spark.createDataFrame([("a", "probe"), ("b_v2", "forward")], "oligo string, role string")
    ask = lambda *x: {r.label: r.role for r in outcomes.role_of(spark.createDataFrame([(y,) for y in x], "label string"), oligos).collect()}
    assert ask("a", "a_v3", "b_v2") == {"a": "probe", "a_v3": "probe", "b_v2": "forward"}
    with pytest.raises(Exception, match="no oligo named q"):
        ask("q")


def test_missing_records(spark):
    there, lost = outcomes.scanned_records(spark.createDataFrame([("a",), ("b",), ("a",)], "accession string"), spark.createDataFrame([("a", "ACGT"), ("c", "A")], "accession string, seq string"))
    assert [tuple(r) for r in there.collect()] == [("a", "ACGT")] and [r.accession for r in lost.collect()] == ["b"]


def test_configuration():
    assert config.foreign_sections({"search": {}, "ncbi": {}}) == ["settings.ncbi: not a section that an assay may set"]
    defaults = {"search": {"word": 7, "taxa": []}, "reaction": {"primer_nM": 400, "na_mM": 50}, "report": {"taxa": 1}}
    assert config.unknown_keys({"search": {"word": 9, "primer_nM": 1, "taxa": 2}}, defaults) == ["search.primer_nM: unknown setting ('primer_nM' belongs under 'reaction:', check the indentation)"]
    assert config.unknown_keys({"reaction": {"taxa": 1, "zzz": 2}}, defaults) == ["reaction.taxa: unknown setting", "reaction.zzz: unknown setting"]


def test_no_row_is_lost_by_a_kernel(spark):
    rows = spark.createDataFrame([(1, None), (2, "ACGTACGTAC"), (2, "ACGTACGTAC")], "k int, sequence string")
    assert [r.k for r in alignment.hairpins(rows).orderBy("k").collect()] == [1, 2, 2] and alignment.hairpins(rows.limit(0)).count() == 0


def test_rationale(spark):
    rows = [(1, 90.0, 95.5, 4, 50.0, 200, 120, 3, 2, 1, 194), (2, 90.0, 90.01, 0, None, 0, 0, 0, 0, 5, 10), (3, 90.0, None, 1, 100.0, 8, 8, 0, 1, 0, 7)]
    figures = spark.createDataFrame(rows, "run int, percent double, alternative double, patterns int, pattern_percent double, genomes int, largest int, earlier int, undated int, not_read int, placed int")
    got = {(r.run, r.topic): r.line for r in outcomes.rationale_lines(figures).collect()}
    assert set(got) == {(1, "run_length"), (1, "patterns"), (1, "collection"), (3, "patterns"), (3, "collection")}
    assert "95.5%" in got[1, "run_length"] and got[1, "patterns"].endswith("60.0%") and got[1, "collection"] == "of 200 genomes 3 were collected before the first year and 2 have no usable date; of 1 it was not read yet"


def test_organism_list(spark):
    names = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "name string, taxid long")
    synonyms = spark.createDataFrame([("c", 4)], "name string, taxid long")
    got = {r.name: (r.status, r.taxid) for r in outcomes.organism_taxa(["a # first", "", "b", "c", "a", "d"], names, synonyms).collect()}
    assert got == {"a": ("resolved", 1), "b": ("ambiguous", None), "c": ("resolved", 4), "d": ("unresolved", None)}
