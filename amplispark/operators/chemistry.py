"""Oligo checks beyond the bands: 3' ends, probes, dyes and structures (QC-03 .. QC-05, QC-07, QC-08, VD-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amplispark.functions import seq, thermo
from amplispark.operators import alignment
from amplispark.operators.oligo_qc import band_status

# G or C among the last five bases; probe Tm above the primers' mean (pass and fail ranges); structure limits in degrees; dyes that a 5' G quenches.
GC_LAST5 = (1, 3)
PROBE_TM_DIFF = (5, 12, 0, 15)
STRUCTURE_WARN, STRUCTURE_FAIL = 47.0, 60.0
G_SENSITIVE = ("FAM", "FITC")


def end_checks(oligos: DataFrame) -> DataFrame:
    """QC-03, QC-04: (oligo, role, check, value, status) of every concrete variant of (oligo, role, sequence).

    Primers: G and C among the last five bases, and their stacking energy,
    which is for information. Probes: by how many G outnumber C.
    """
    v = oligos.select("oligo", "role", F.explode(seq.expand(F.col("sequence"))).alias("v"))
    count = lambda s, of: F.length(F.regexp_replace(s, f"[^{of}]", ""))
    last5, probe = F.substring(F.col("v"), -5, 5), F.col("role") == "probe"
    gc, excess = count(last5, "GC"), count(F.col("v"), "G") - count(F.col("v"), "C")
    one = lambda check, value, status: F.struct(F.lit(check).alias("check"), value.cast("double").alias("value"), status.alias("status"))
    primer_rows = F.array(
        one("gc_last5", gc, F.when(gc.between(*GC_LAST5), F.lit("PASS")).otherwise(F.lit("WARN"))),
        one("three_prime_dg", thermo.nn_dg37(last5), F.lit("INFO")),
    )
    probe_rows = F.array(one("g_minus_c", excess, F.when(excess > 0, F.lit("WARN")).otherwise(F.lit("PASS"))))
    return v.select("oligo", "role", F.explode(F.when(probe, probe_rows).otherwise(primer_rows)).alias("c")).select("oligo", "role", "c.*")


def probe_tm_difference(tms: DataFrame) -> DataFrame:
    """QC-04: (assay, oligo, low, high, status) of each probe: its Tm less the mean of the primers', over all variants.

    Tms are (assay, oligo, role, low, high, unreliable); of a probe whose
    modifications make its Tm unreliable a failure is a warning.
    """
    of = lambda role, f, c: f(F.when(F.col("role") == role, F.col(c)))
    primers = tms.groupBy("assay").agg(*[of(r, f, c).alias(f"{r}_{c}") for r in ("forward", "reverse") for f, c in ((F.min, "low"), (F.max, "high"))])
    j = tms.where("role = 'probe'").join(primers, "assay")
    low = F.col("low") - (F.col("forward_high") + F.col("reverse_high")) / 2
    high = F.col("high") - (F.col("forward_low") + F.col("reverse_low")) / 2
    rank = lambda x: F.array_position(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), band_status(x, *map(F.lit, PROBE_TM_DIFF)))
    worst = F.greatest(rank(low), rank(high))
    status = F.when(worst == 1, "PASS").when((worst == 2) | F.col("unreliable"), "WARN").otherwise("FAIL")
    return j.where(low.isNotNull()).select("assay", "oligo", low.alias("low"), high.alias("high"), status.alias("status"))


def five_prime_g(probes: DataFrame) -> DataFrame:
    """QC-05: (oligo, bases, status) of (oligo, sequence, reporter): a 5' G beside a dye that it quenches, or beside an unknown one, warns; beside others it is for information."""
    p = probes.select("oligo", "reporter", seq.expand(F.col("sequence")).alias("v"))
    bases = F.array_sort(F.array_distinct(F.transform("v", lambda x: F.substring(x, 1, 1))))
    dye = F.upper(F.trim(F.coalesce("reporter", F.lit(""))))
    quenched = (dye == "") | F.array_contains(F.transform(F.array(*map(F.lit, G_SENSITIVE)), lambda x: F.contains(dye, x)), True)
    status = F.when(~F.array_contains(bases, "G"), "PASS").when(quenched, "WARN").otherwise("INFO")
    return p.select("oligo", F.array_join(bases, "/").alias("bases"), status.alias("status"))


def structure_status(tm: Column, warn: float = STRUCTURE_WARN, fail: float = STRUCTURE_FAIL) -> Column:
    """QC-08: by its Tm; no structure passes."""
    return F.when(tm >= fail, F.lit("FAIL")).when(tm >= warn, F.lit("WARN")).otherwise(F.lit("PASS"))


def worst_structures(found: DataFrame) -> DataFrame:
    """VD-16: per (assay, kind, label) the variant with the highest Tm of (…, variant, tm, dg), its status and how many variants there are; the variant is named where there are several."""
    top = F.max_by(F.struct("tm", "dg", "variant"), F.struct(F.coalesce("tm", F.lit(float("-inf"))).alias("t"), "variant"))
    per = found.groupBy("assay", "kind", "label").agg(top.alias("w"), F.count("*").alias("variants"))
    named = F.when((F.col("variants") > 1) & F.col("w.tm").isNotNull(), F.col("w.variant"))
    return per.select("assay", "kind", "label", F.col("w.tm").isNotNull().alias("found"), "w.tm", "w.dg", structure_status(F.col("w.tm")).alias("status"), named.alias("variant"), "variants")


def structures(oligos: DataFrame) -> DataFrame:
    """QC-07, QC-08, VD-16: the worst hairpin and self-dimer of each oligo and the worst dimer of each pair of an assay's (assay, oligo, pos, sequence)."""
    v = oligos.select("assay", "oligo", "pos", F.explode(seq.expand(F.col("sequence"))).alias("sequence"))
    hair = alignment.hairpins(v).select("assay", F.lit("hairpin").alias("kind"), F.col("oligo").alias("label"), F.col("sequence").alias("variant"), F.col("hairpin_tm").alias("tm"), F.col("hairpin_dg").alias("dg"))
    a, b = (v.select("assay", *[F.col(c).alias(f"{c}_{x}") for c in ("oligo", "pos", "sequence")]) for x in "ab")
    pairs = a.join(b, "assay").where("pos_a < pos_b OR pos_a = pos_b AND sequence_a = sequence_b")  # an assay's own oligos, a handful
    named = pairs.select(
        "assay", F.when(F.col("pos_a") == F.col("pos_b"), "self_dimer").otherwise("hetero_dimer").alias("kind"),
        F.when(F.col("pos_a") == F.col("pos_b"), F.col("oligo_a")).otherwise(F.concat_ws(" / ", "oligo_a", "oligo_b")).alias("label"),
        F.concat_ws(" / ", "sequence_a", "sequence_b").alias("variant"), F.col("sequence_a").alias("seq_a"), F.col("sequence_b").alias("seq_b"),
    )
    # As many tasks as the oligos came in, by number, as the join leaves what is small in bytes to few of them.
    named = named.repartition(max(oligos.rdd.getNumPartitions(), oligos.sparkSession.sparkContext.defaultParallelism))
    dimers = alignment.pair_structures(named).drop("seq_a", "seq_b")
    return worst_structures(hair.unionByName(dimers))
