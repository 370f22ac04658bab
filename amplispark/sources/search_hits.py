"""Search reports in nested JSON (SRC-03 .. SRC-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HSP = "struct<num:int,bit_score:double,score:int,evalue:double,identity:int,query_from:int,query_to:int,hit_from:int,hit_to:int,hit_strand:string,align_len:int,gaps:int,qseq:string,hseq:string>"
_HIT = f"struct<num:int,description:array<struct<id:string,accession:string,title:string,taxid:bigint,sciname:string>>,len:int,hsps:array<{_HSP}>>"
_SEARCH = f"struct<query_title:string,query_len:int,hits:array<{_HIT}>,stat:struct<db_len:bigint,eff_space:double,kappa:double,lambda:double>>"
SCHEMA = f"struct<BlastOutput2:array<struct<report:struct<program:string,results:struct<search:{_SEARCH}>>>>>"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of whole report files."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def accession_version(pipe_id: Column, accession: Column) -> Column:
    """SRC-04: accession and version from an id of pipes, else the plain accession."""
    found = F.regexp_extract(pipe_id, r"\|([A-Za-z0-9_]+\.[0-9]+)\|", 1)
    return F.when(found != "", found).otherwise(accession)


def parse_reports(reports: DataFrame, labels: DataFrame | None = None, stretch: tuple[str, ...] | None = None) -> DataFrame:
    """SRC-03: a row per aligned stretch of (value) reports; ``labels`` (query) are the titles that may occur.

    ``stretch`` names the columns of a stretch that are wanted; the others are not read out of the text.

    A report that cannot be read, or one of an unknown query, is an error.
    """
    wanted = ",".join(x for x in _HSP.removeprefix("struct<").removesuffix(">").split(",") if stretch is None or x.split(":")[0] in stretch)
    schema = SCHEMA.replace(_HSP, f"struct<{wanted}>")
    unread = F.raise_error(F.lit("unreadable search report")).cast(schema)
    whole = F.coalesce(F.from_json("value", schema)["BlastOutput2"], unread["BlastOutput2"])
    # Parsed once a report: named once, and an outer generator, as for the other one a filter that parses as well would be put before it.
    search = reports.select(F.explode_outer(whole).alias("r")).where("r IS NOT NULL").select("r.report.results.search.*")
    if labels is not None:
        search = search.join(labels.select(F.col("query").alias("query_title"), F.lit(True).alias("_known")), "query_title", "left")
        search = search.where(F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown query "), "query_title")).cast("boolean")))
    hits = search.select(F.col("query_title").alias("query"), "query_len", F.explode("hits").alias("h"))
    first = F.get("h.description", F.lit(0))
    hits = hits.select("query", "query_len", F.col("h.num").alias("hit"), accession_version(first["id"], first["accession"]).alias("accession"), first["taxid"].alias("taxid"), F.explode("h.hsps").alias("s"))
    return hits.select("query", "query_len", "hit", "accession", "taxid", "s.*")


def effective_space(reports: DataFrame) -> DataFrame:
    """SRC-05: per query the reported search space, else the largest that its hits imply, else length times database."""
    search = reports.select(F.explode(F.from_json("value", SCHEMA)["BlastOutput2"]).alias("r")).select("r.report.results.search.*")
    hsps = F.flatten(F.transform("hits", lambda h: h["hsps"]))
    implied = F.array_max(F.transform(hsps, lambda s: s["evalue"] / (F.col("stat.kappa") * F.exp(-F.col("stat.lambda") * s["score"]))))
    reported = F.when(F.col("stat.eff_space") > 0, F.col("stat.eff_space"))
    space = F.coalesce(reported, implied, F.col("query_len") * F.col("stat.db_len").cast("double"))
    source = F.when(reported.isNotNull(), F.lit("reported")).when(implied.isNotNull(), F.lit("hits")).otherwise(F.lit("length"))
    return search.select(F.col("query_title").alias("query"), space.alias("space"), source.alias("source"))
