import json
import zipfile

import pytest
from pyspark.sql import functions as F

from amplispark.sources import assay, files, search_hits
from amplispark.streaming import store

SPEC = {
    "assay_name": "n1", "forward": "gacccc aaaatcagcgaaat", "reverse": "TCTGGTTACTGCCAGTTGAATCTG", "probe": "ACCCCGCATTACGTTTGGTGGACC",
    "probe_reporter": "FAM", "target": {"taxid": 2697049},
}


def test_assay(spark):
    a = assay.build_assay(SPEC)
    assert [o["role"] for o in a.oligos] == ["forward", "reverse", "probe"] and a.oligos[0]["sequence"] == "GACCCCAAAATCAGCGAAAT"
    assert a.channels == [{"name": "FAM", "dye": "FAM", "probes": ["probe"]}]
    assert a.frame(spark).count() == 3
    with pytest.raises(assay.AssayError, match="write T for U"):
        assay.build_assay(SPEC, {"forward": "GACCCCAAAAUCAGCGAAAU"})
    with pytest.raises(assay.AssayError, match="listed twice"):
        assay.build_assay(SPEC, {"exclusion_taxids": [5, 5]})
    with pytest.raises(assay.AssayError, match="unknown oligo"):
        assay.build_assay(SPEC, {"evidence": [{"oligo": "x"}]})


def test_config():
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert assay.deep_merge(base, {"a": {"c": 5}, "d": None}) == {"a": {"b": 1, "c": 5}, "d": None}
    assert assay.differing({"a": {"b": 1, "c": 5}, "d": 3}, base) == {"a.c": (2, 5)}
    assert assay.organism_names(["x # y", "", "z", "x"]) == ["x", "z"]


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">c1 first one\nACGT\nacg\n>pdb|1ABC|A\nNNN\n")
    got = {(r.contig, r.description, r.seq) for r in files.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {("c1", "first one", "ACGTACG"), ("pdb|1ABC|A", "", "NNN"), ("1ABC_A", "", "NNN")}
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.write(tmp_path / "a.fasta", "data/a.fna")
    zipped = files.read_zipped_fasta(spark, str(tmp_path / "g.zip")).collect()
    assert {(r.contig, r.seq) for r in zipped} == {(c, s) for c, _, s in got} and zipped[0].path.endswith("g.zip")
    (tmp_path / "t.xml").write_text("<TaxaSet><Taxon><TaxId>9</TaxId><ScientificName>s</ScientificName><Rank>species</Rank><LineageEx><Taxon><TaxId>1</TaxId><ScientificName>r</ScientificName><Rank>no rank</Rank></Taxon><Taxon><TaxId>5</TaxId><ScientificName>g</ScientificName><Rank>genus</Rank></Taxon></LineageEx></Taxon></TaxaSet>")
    taxa = files.read_taxa(spark, str(tmp_path / "t.xml")).where("taxid = 9").orderBy("depth").collect()
    assert [(r.ancestor, r["rank"]) for r in taxa] == [(9, "species"), (5, "genus"), (1, "no rank")]
    page = json.dumps({"reports": [{"accession": "GCA_1.1", "organism": {"tax_id": 7, "organism_name": "x"}, "assembly_info": {"assembly_level": "Contig", "release_date": "2024-05-06"}}]})
    row = files.assembly_listing(spark.createDataFrame([(page,)], "value string")).first()
    assert (row.accession, row.taxid, str(row.release_date)) == ("GCA_1.1", 7, "2024-05-06")
    roles = spark.createDataFrame([(json.dumps({"refseq_accession": "NC_1", "genbank_accession": "CP1", "role": "assembled"}),)], "value string")
    assert {r.accession for r in files.sequence_roles(roles).collect()} == {"NC_1", "CP1"}


def test_unreadable_reports(spark):
    with pytest.raises(Exception, match="unreadable search report"):
        search_hits.parse_reports(spark.createDataFrame([("{}",)], "value string")).collect()


def test_store(spark, tmp_path):
    schema = "key string, accession string, release_date string"
    for n, rows in enumerate(([("k", "a", "2020"), ("k", "b", "2021")], [("k", "b", "2021"), ("k", "c", "2022")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        store.collect(source, str(tmp_path / "store"), str(tmp_path / "cp"), budget=2)
        assert spark.read.parquet(str(tmp_path / "store")).count() == (2, 3)[n]
    dated = store.with_dates(spark.createDataFrame([("a", None), ("b", "2019")], "accession string, collected string"), spark.createDataFrame([("a", "2018", 1), ("a", "2017", 2)], "accession string, collected string, seq_no long"))
    assert {(r.accession, r.collected) for r in dated.collect()} == {("a", "2017"), ("b", "2019")}
    assert spark.range(1).select(F.length(store.store_key(F.lit(1)))).first()[0] == 64


def test_a_budget_is_resumed(spark, tmp_path):
    """Five genomes at two a run: newest first, and the runs after it take what the first left, though nothing new is listed."""
    schema = "key string, accession string, release_date string"
    rows = [("k", "a", "2020"), ("k", "b", "2021"), ("k", "c", "2021"), ("k", "d", "2022"), ("k", "e", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    at = [str(tmp_path / x) for x in ("store", "cp")]
    seen = []
    for _ in range(5):
        store.collect(source, *at, budget=2)
        seen.append(sorted(r.accession for r in spark.read.parquet(at[0]).collect()))
    assert seen == [["b", "d"], ["a", "b", "c", "d"], *[["a", "b", "c", "d", "e"]] * 3]
    spark.createDataFrame([("k", "a", "2020"), ("other", "a", "2020")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    store.collect(source, *at)
    assert spark.read.parquet(at[0]).count() == 6
    empty = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).where("key = 'none'")
    store.collect(empty, str(tmp_path / "store2"), str(tmp_path / "cp2"), budget=1)
    assert spark.read.parquet(str(tmp_path / "store2")).count() == 0


def test_hits_have_all_columns(spark, tmp_path):
    from amplispark.sources import sinks

    sites = spark.createDataFrame([("near", "q_v1", 3, [1, 4], 55.25, None, "not a column")], "tier string, query string, start int, defect_positions array<int>, duplex_tm_c double, title string, other string")
    sinks.write_hits(sites, str(tmp_path / "hits"))
    (row,) = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "hits")).collect()
    assert tuple(row.asDict()) == sinks.HIT_COLUMNS and len(sinks.HIT_COLUMNS) == 24
    assert (row.tier, row.start, row.defect_positions, row.duplex_tm_c, row.title, row.taxid) == ("near", "3", "1,4", "55.3", None, None)


def test_the_fingerprint_is_that_of_the_code(tmp_path):
    from amplispark.sources import sinks

    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.yaml").write_text("y: 2")
    first = sinks.code_fingerprint(tmp_path)
    (tmp_path / "__pycache__").mkdir()
    (tmp_path / "__pycache__" / "a.pyc").write_text("z")
    assert sinks.code_fingerprint(tmp_path) == first
    (tmp_path / "a.py").write_text("x = 2")
    assert sinks.code_fingerprint(tmp_path) != first and len(sinks.code_fingerprint()) == 64
