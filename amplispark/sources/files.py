"""Files that genomes, taxa and records come in (SRC-06 .. SRC-09, SRC-11, SRC-17, SRC-18)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: (contig, description, seq) of FASTA files, split at records."""
    return parse_fasta(spark.read.text(path, lineSep=">"))


def parse_fasta(records: DataFrame) -> DataFrame:
    """SRC-06: records (value) without their >; an id of three parts between pipes is also known as entry_chain. Other columns come along."""
    kept = [c for c in records.columns if c != "value"]
    head, body = F.split_part("value", F.lit("\n"), F.lit(1)), F.substring("value", F.instr("value", "\n") + 1, F.length("value"))
    r = records.where(F.trim("value") != "").select(*kept, F.trim(head).alias("head"), F.upper(F.regexp_replace(body, r"\s+", "")).alias("seq"))
    name = F.split_part("head", F.lit(" "), F.lit(1))
    parts = F.split(name, r"\|")
    names = F.when(F.size(parts) == 3, F.array(name, F.concat_ws("_", parts[1], parts[2]))).otherwise(F.array(name))
    return r.select(*kept, F.explode(names).alias("contig"), F.trim(F.expr("substr(head, instr(concat(head, ' '), ' ') + 1)")).alias("description"), "seq")


def read_zipped_fasta(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: (path, contig, description, seq) of the FASTA members of zip archives; a damaged archive is an error."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith((".fna", ".fasta", ".fa")):
                            rows = z.read(name).decode().split(">")[1:]
                            yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.string()), pa.array(rows, pa.string())], names=["path", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return parse_fasta(files.mapInArrow(unzip, "path string, value string"))


_ROLE = "struct<refseq_accession:string,genbank_accession:string,role:string,assigned_molecule_location_type:string>"


def sequence_roles(reports: DataFrame) -> DataFrame:
    """SRC-09: (accession, role, molecule) of JSON report lines (value), under both of a sequence's accessions."""
    r = reports.select(F.from_json("value", _ROLE).alias("r")).select("r.*")
    names = F.filter(F.array("refseq_accession", "genbank_accession"), lambda x: x.isNotNull() & (x != ""))
    return r.select(F.explode(names).alias("accession"), "role", F.col("assigned_molecule_location_type").alias("molecule"))


_LISTING = "struct<reports:array<struct<accession:string,organism:struct<tax_id:bigint,organism_name:string>,assembly_info:struct<assembly_level:string,release_date:string>>>,next_page_token:string,total_count:bigint>"


def assembly_listing(pages: DataFrame) -> DataFrame:
    """SRC-07: listed genomes of JSON pages (value)."""
    p = pages.select(F.explode(F.from_json("value", _LISTING)["reports"]).alias("r"))
    return p.select("r.accession", F.col("r.organism.tax_id").alias("taxid"), F.col("r.organism.organism_name").alias("organism"), F.col("r.assembly_info.assembly_level").alias("level"), F.to_date("r.assembly_info.release_date").alias("release_date"))


_TAXON = "TaxId BIGINT, ScientificName STRING, Rank STRING, LineageEx STRUCT<Taxon: ARRAY<STRUCT<TaxId: BIGINT, ScientificName: STRING, Rank: STRING>>>"


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: (taxid, ancestor, depth, rank, name) of taxonomy XML files; a taxon is its own ancestor at depth 0."""
    t = spark.read.format("xml").option("rowTag", "Taxon").schema(_TAXON).load(path).where("TaxId IS NOT NULL")
    up = F.reverse("LineageEx.Taxon")
    own = F.array(F.struct(F.col("TaxId"), F.col("ScientificName"), F.col("Rank")))
    line = F.concat(own, F.coalesce(up, F.filter(own, lambda _: F.lit(False))))
    return t.select(F.col("TaxId").alias("taxid"), F.posexplode(line).alias("depth", "a")).select("taxid", F.col("a.TaxId").alias("ancestor"), "depth", F.col("a.Rank").alias("rank"), F.col("a.ScientificName").alias("name"))


def record_date(created: Column) -> Column:
    """SRC-17: a date of the form YYYY/MM/DD, null otherwise."""
    found = F.regexp_extract(created, r"^(\d{4}/\d{2}/\d{2})", 1)
    return F.to_date(F.when(found != "", found), "yyyy/MM/dd")


def paired_value(names: Column, values: Column, wanted: str) -> Column:
    """SRC-18: the value of a name in two lists between pipes; null where their lengths differ."""
    n, v = F.split(names, r"\|"), F.split(values, r"\|")
    hits = F.filter(F.arrays_zip(n.alias("n"), v.alias("v")), lambda x: x["n"] == wanted)
    return F.when(F.size(n) == F.size(v), F.get(hits, F.lit(0))["v"])
