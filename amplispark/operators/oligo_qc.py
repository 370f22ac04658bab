"""Oligo quality checks (QC-01 .. QC-12): threshold rules in which the worst variant decides."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amplispark.functions import kernels, seq, thermo

# Pass and fail bands by role and check; run limits as (warn, fail).
BANDS = {
    ("primer", "length"): (18, 30, 15, 40),
    ("primer", "gc"): (40, 60, 30, 70),
    ("primer", "tm"): (58, 66, 54, 70),
    ("probe", "length"): (15, 30, 12, 40),
    ("probe", "gc"): (30, 80, 20, 90),
}
RUN, G_RUN = (5, 7), (4, 6)
PRIMER_TM_DIFF = (3, 6)
#: Bases that a task scans at once, about; a longer contig is scanned by itself.
BASES_AT_ONCE = 4_000_000
RANKS = ("INFO", "PASS", "WARN", "FAIL")


def rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in RANKS]), status)


def status_of(rank_col: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in RANKS]), (rank_col - 1).cast("int"))


def band_status(x: Column, lo: Column, hi: Column, fail_lo: Column, fail_hi: Column) -> Column:
    """QC-01: PASS inside the pass range, FAIL outside of the fail range, WARN between."""
    return F.when(x.between(lo, hi), F.lit("PASS")).when(x.between(fail_lo, fail_hi), F.lit("WARN")).otherwise(F.lit("FAIL"))


def limit_status(x: Column, warn: float, fail: float, strict: bool = False) -> Column:
    """QC-01: from a limit on (``strict``: only above it)."""
    above = (lambda c, v: c > v) if strict else (lambda c, v: c >= v)
    return F.when(above(x, F.lit(fail)), F.lit("FAIL")).when(above(x, F.lit(warn)), F.lit("WARN")).otherwise(F.lit("PASS"))


def variant_checks(oligos: DataFrame) -> DataFrame:
    """QC-03, QC-04: (oligo, role, check, value, status) of every concrete variant of (oligo, role, sequence)."""
    v = oligos.select("oligo", "role", F.explode(seq.expand(F.col("sequence"))).alias("v"))
    kind = F.when(F.col("role") == "probe", F.lit("probe")).otherwise(F.lit("primer"))
    values = {
        "length": F.length("v").cast("double"),
        "gc": seq.gc_percent(F.col("v")),
        "tm": F.when(kind == "primer", thermo.melting_temp(F.col("v"), 400.0)).otherwise(thermo.melting_temp(F.col("v"), 200.0)),
        "run": seq.longest_run(F.col("v")).cast("double"),
        "g_run": seq.longest_run(F.col("v"), "G").cast("double"),
    }
    rows = v.select("oligo", "role", kind.alias("kind"), F.explode(F.array(*[F.struct(F.lit(k).alias("check"), x.alias("value")) for k, x in values.items()])).alias("c"))
    rows = rows.select("oligo", "role", "kind", "c.check", "c.value")
    status = F.when(F.col("check") == "run", limit_status(F.col("value"), *RUN)).when(F.col("check") == "g_run", limit_status(F.col("value"), *G_RUN))
    for (k, check), band in BANDS.items():
        status = status.when((F.col("kind") == k) & (F.col("check") == check), band_status(F.col("value"), *map(F.lit, band)))
    return rows.select("oligo", "role", "check", "value", status.otherwise(F.lit("INFO")).alias("status"))


def worst_checks(variants: DataFrame) -> DataFrame:
    """QC-02: per oligo and check the worst status, the range of values and the value farthest from its middle."""
    w = Window.partitionBy("oligo", "check")
    mid = (F.min("value").over(w) + F.max("value").over(w)) / 2
    placed = variants.withColumn("_r", rank(F.col("status"))).withColumn("_far", F.round(F.abs(F.col("value") - mid), 6))
    return (
        placed.groupBy("oligo", "role", "check")
        .agg(F.max("_r").alias("_r"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", F.struct("_r", "_far", "value")).alias("worst_value"), F.count("*").alias("n_variants"))
        .select("oligo", "role", "check", status_of(F.col("_r")).alias("status"), "low", "high", "worst_value", "n_variants")
    )


def pair_checks(checks: DataFrame) -> DataFrame:
    """QC-06: the largest Tm difference between a forward and a reverse primer of (oligo, role, check, low, high)."""
    tm = checks.where(F.col("check") == "tm")
    f, r = (tm.where(F.col("role") == x).agg(F.min("low").alias(f"{x}_low"), F.max("high").alias(f"{x}_high")) for x in ("forward", "reverse"))
    diff = F.greatest(F.abs(F.col("forward_high") - F.col("reverse_low")), F.abs(F.col("reverse_high") - F.col("forward_low")))
    return f.crossJoin(F.broadcast(r)).select(diff.alias("tm_diff"), limit_status(diff, *PRIMER_TM_DIFF, strict=True).alias("status"))  # one row each


def oligo_pairs(oligos: DataFrame) -> DataFrame:
    """QC-07: each unordered pair of oligos of one assay once (a theta self-join on their order), with FN-10 at equal lengths."""
    a, b = (oligos.select("assay", *[F.col(c).alias(f"{c}_{x}") for c in ("oligo", "pos", "sequence")]) for x in "ab")
    return a.join(b, "assay").where("pos_a < pos_b").select("assay", "oligo_a", "oligo_b", "sequence_a", "sequence_b")


def role_spread(checks: DataFrame) -> DataFrame:
    """QC-09: the Tm range of roles that several oligos share."""
    tm = checks.where(F.col("check") == "tm")
    return tm.groupBy("role").agg(F.countDistinct("oligo").alias("n"), (F.max("high") - F.min("low")).alias("spread")).where("n > 1")


def matrix(checks: DataFrame, oligos: list[str], by: tuple[str, ...] = ("check",)) -> DataFrame:
    """QC-12: statuses, a row per check (of each assay, where ``by`` names it) and a column per oligo."""
    return checks.groupBy(*by).pivot("oligo", oligos).agg(F.first("status"))


def overall(checks: DataFrame) -> DataFrame:
    """QC-11: the worst status of all."""
    return checks.agg(status_of(F.max(rank(F.col("status")))).alias("status"), F.count("*").alias("n_checks"))


def find_sites(contigs: DataFrame, oligos: tuple[tuple[str, str], ...], most: int) -> DataFrame:
    """AL-06: (accession, oligo, strand, start, mismatches, site) of every window with at most ``most`` mismatches.

    ``site`` is in the oligo's orientation; starts count from 0 on the forward
    strand; N in a sequence matches nothing. Narrow: no shuffle, whole contigs.
    """

    def located(names: list[str], seqs: list[str]) -> pa.RecordBatch:
        width, out = dict(oligos), []
        for k, oligo, strand, start, m in kernels.find_sites_in(list(oligos), seqs, most):
            site = seqs[k][start : start + len(width[oligo])]
            out.append((names[k], oligo, strand, start, m, kernels.reverse_complement(site) if strand == "-" else site))
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        columns = zip(*out, strict=True) if out else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["accession", "oligo", "strand", "start", "mismatches", "site"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seqs, bases = [], [], 0
        for b in batches:
            for accession, s in zip(b.column(0), b.column(1), strict=True):
                names.append(accession.as_py())
                seqs.append(s.as_py() or "")
                bases += len(seqs[-1])
                if bases >= BASES_AT_ONCE:
                    yield located(names, seqs)
                    names, seqs, bases = [], [], 0
        if names:
            yield located(names, seqs)

    return contigs.select("accession", "seq").mapInArrow(run, "accession string, oligo string, strand string, start int, mismatches int, site string")


def best_sites(sites: DataFrame) -> DataFrame:
    """AS-03: of each oligo and genome the site with the fewest mismatches, then on +, then leftmost."""
    key = F.struct("mismatches", (F.col("strand") != "+").alias("minus"), "start")
    best = F.min_by(F.struct("strand", "start", "mismatches", "site"), key)
    return sites.groupBy("accession", "oligo").agg(best.alias("b")).select("accession", "oligo", "b.*")


def geometry(best: DataFrame) -> DataFrame:
    """QC-10: (accession, product_length, probe_inside, orientation) where both primers have a site; lengths as on the sense strand."""
    sites = best.select("accession", "oligo", "strand", "start", (F.col("start") + F.length("site")).alias("end"))
    one = lambda name: F.max(F.when(F.col("oligo") == name, F.struct("strand", "start", "end"))).alias(name)
    g = sites.groupBy("accession").agg(one("forward"), one("probe"), one("reverse")).where("forward IS NOT NULL AND reverse IS NOT NULL")
    left, right = F.least("forward.start", "reverse.start"), F.greatest("forward.end", "reverse.end")
    facing = F.when(F.col("forward.strand") == F.col("reverse.strand"), F.lit("FAIL")).otherwise(F.lit("PASS"))
    inside = F.col("probe").isNotNull() & (F.col("probe.start") >= left) & (F.col("probe.end") <= right)
    return g.select("accession", (right - left).alias("product_length"), inside.alias("probe_inside"), facing.alias("orientation"))
