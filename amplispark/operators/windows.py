"""Site windows, flanks, axes and summaries (SP-07, 08, 09, 19..21, LC-12, 13, 18, 20, AS-01, 02, 05, JN-05, 10, TW-08, VD-03, 07, 11, 12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amplispark.functions import seq

PAD = 10


def footprint(start: Column, end: Column, u5: Column, u3: Column, strand: Column) -> Column:
    """SP-07: struct<lo, hi> of the whole oligo on the record, from the aligned stretch and its unaligned ends."""
    plus = strand == "+"
    return F.struct((start - F.when(plus, u5).otherwise(u3)).alias("lo"), (end + F.when(plus, u3).otherwise(u5)).alias("hi"))


def window_of(lo: Column, hi: Column, length: Column, pad: int = PAD) -> Column:
    """SP-07: a footprint with ``pad`` bases around it, inside of the record."""
    return F.struct(F.greatest(lo - pad, F.lit(1)).alias("start"), F.least(hi + pad, length).alias("stop"))


def worst_case(q: Column, aligned: Column, u5: Column, u3: Column) -> Column:
    """SP-08: the site of a stretch whose ends were not seen: dots for the unaligned bases on either side."""
    return F.struct(q.alias("q_aln"), F.concat(F.repeat(F.lit("."), u5), aligned, F.repeat(F.lit("."), u3)).alias("s_aln"))


def off_target_site(s_aln: Column) -> Column:
    """SP-09: off the target N says nothing, so it counts as a base that was not seen."""
    return F.translate(s_aln, "N", ".")


def searched_taxa(searches: DataFrame) -> DataFrame:
    """SP-19: per tier its searches and the taxa they were restricted to, each once, in order."""
    t = searches.groupBy("tier").agg(F.count("*").alias("searches"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("taxa")))).alias("taxa"))
    return t.select("tier", "searches", F.array_join(F.transform("taxa", lambda x: x.cast("string")), ",").alias("taxa"))


def any_saturated(saturation: DataFrame, target: str = "target") -> DataFrame:
    """SP-20: whether any list but the target's own is saturated."""
    return saturation.where(F.col("tier") != target).agg(F.coalesce(F.bool_or("saturated"), F.lit(False)).alias("saturated"))


def gapped_probe_binds(sites: DataFrame) -> DataFrame:
    """SP-21: per tier whether a probe site with a gap is above minor."""
    probe = sites.where("role = 'probe'")
    return probe.groupBy("tier").agg(F.bool_or((F.col("gaps") > 0) & (F.col("level") != "minor")).alias("binds"))


def _best_whole(copies: DataFrame) -> DataFrame:
    """LC-12: (accession, c) with each genome's best whole copy, by anchored bases, identity and place."""
    order = F.struct("anchored", "identity", (-F.col("start")).alias("s"))
    return copies.where("NOT cut").groupBy("accession").agg(F.max_by(F.struct("contig", "strand", "start", "end", "region", "region_start"), order).alias("c"))


def _around(s: Column, start: Column, end: Column, size: int) -> tuple[Column, Column]:
    lo = F.greatest(start - size, F.lit(0))
    return F.substring(s, lo + 1, start - lo).alias("left"), F.substring(s, end + 1, F.lit(size)).alias("right")


def flanks(copies: DataFrame, size: int) -> DataFrame:
    """LC-12: (accession, left, right) of each genome's best whole copy, out of its region, which must reach ``size`` bases beyond it."""
    at = lambda x: F.col(f"c.{x}") - F.col("c.region_start")
    return _best_whole(copies).select("accession", *_around(F.col("c.region"), at("start"), at("end"), size))


def flanks_in(copies: DataFrame, contigs: DataFrame, size: int = 1000) -> DataFrame:
    """LC-12: the same out of the contigs themselves, for the copies of a few genomes."""
    j = contigs.join(F.broadcast(_best_whole(copies)), "accession").where(F.col("contig") == F.col("c.contig"))
    s = F.when(F.col("c.strand") == "-", seq.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return j.select("accession", *_around(s, F.col("c.start"), F.col("c.end"), size))


def cut_fragment(contigs: DataFrame, forward: str, reverse: str) -> DataFrame:
    """LC-13: the fragment between exact primer sites, on either strand; null where there is none."""
    other = seq.reverse_complement(F.lit(reverse))

    def on(s: Column) -> Column:
        a = F.locate(forward, s)
        b = F.instr(F.substring(s, a, F.length(s)), reverse.translate(str.maketrans("ACGT", "TGCA"))[::-1])
        return F.when((a > 0) & (b > 0), F.substring(s, a, b + F.length(other) - 1))

    return contigs.select("accession", F.coalesce(on(F.col("seq")), on(seq.reverse_complement(F.col("seq")))).alias("fragment"))


def oligo_windows(sites: DataFrame) -> DataFrame:
    """AS-01: per role and genome the window that its placed alternatives span, on the strand of the first of them."""
    first = F.min_by("strand", F.struct("start", "oligo"))
    with_first = sites.join(sites.groupBy("accession", "role").agg(first.alias("on")), ["accession", "role"]).where("strand = on")
    return with_first.groupBy("accession", "role").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("oligos"))


def best_copies(copies: DataFrame) -> DataFrame:
    """AS-05: of each genome the copy with the fewest failing, then undetermined sites, then defects, then the longest clean ends, then the first."""
    order = Window.partitionBy("accession").orderBy("fails", "undetermined", "defects", F.desc("clean3"), "copy")
    return copies.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def deduplicated(copies: DataFrame, within: int = 20) -> DataFrame:
    """LC-18: copies of one record and strand that start within ``within`` bases of the one before, as one."""
    order = Window.partitionBy("accession", "strand").orderBy("start", "end")
    opens = F.when(F.col("start") - F.lag("start").over(order) <= within, 0).otherwise(1)
    places = copies.groupBy("accession", "strand", "start", "end").agg(F.count("*").alias("n"))
    islands = places.withColumn("_o", opens).withColumn("_i", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("accession", "strand", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_i")


def in_lineage(sites: DataFrame, closure: DataFrame, taxon: int) -> DataFrame:
    """JN-05: sites in records of a lineage, for notes on it."""
    return sites.join(closure.where(F.col("ancestor") == taxon).select("taxid"), "taxid", "left_semi")


def cut_products(products: DataFrame, most: int) -> DataFrame:
    """JN-04, JN-10: per tier its products, how many of them a cap of ``most`` cuts, and whether none of those would be detected.

    Takes the products before any cap. They are counted by record; of a tier's
    first ``most`` records, which hold what is within the cap, only the one where
    the cap falls is ranked product by product, so that no task ranks a tier.
    """
    records = products.groupBy("tier", "accession").agg(F.count("*").alias("n"), F.count("probe_id").alias("detected"))
    per = records.groupBy("tier").agg(F.sum("n").alias("products"), F.sum("detected").alias("_all"))
    by_name = Window.partitionBy("tier").orderBy("accession")
    first = records.withColumn("_r", F.row_number().over(by_name)).where(F.col("_r") <= most)
    first = first.withColumn("_to", F.sum("n").over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
    whole = first.where(F.col("_to") <= most).select("tier", "n", "detected")
    split = first.where((F.col("_to") > most) & (F.col("_to") - F.col("n") < most)).select("tier", "accession", (most - F.col("_to") + F.col("n")).alias("_left"))
    order = Window.partitionBy("tier").orderBy("start", "end", "left_id", "right_id")
    ranked = products.join(F.broadcast(split), ["tier", "accession"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).where("_n <= _left")  # a record a tier
    kept = whole.unionByName(ranked.select("tier", F.lit(1).cast("long").alias("n"), F.when(F.col("probe_id").isNotNull(), 1).otherwise(0).cast("long").alias("detected")))
    within = kept.groupBy("tier").agg(F.sum("n").alias("_kept"), F.sum("detected").alias("_within"))
    cut = F.col("products") - F.col("_kept")
    return per.join(within, "tier").select("tier", "products", cut.alias("cut"), (cut > 0).alias("truncated"), (F.col("_all") == F.col("_within")).alias("harmless"))


def axis_rows(release: DataFrame, collection: DataFrame, axis: str) -> DataFrame:
    """TW-08: the yearly rows that the status rests on."""
    if axis not in ("release", "collection"):
        raise ValueError(f"no axis {axis!r}")
    return release if axis == "release" else collection


def too_many_unavailable(assessed: Column, unavailable: Column, most: float = 0.05) -> Column:
    """VD-11: more of a listing could not be read than its verdict can bear."""
    return unavailable > most * (assessed + unavailable)


def scan_findings(scans: DataFrame) -> DataFrame:
    """VD-03: what a partner scan left open, as INFO where the floor bounds it and as INCOMPLETE otherwise."""
    left = F.col("windows") - F.col("scanned")
    return scans.where(left > 0).select(F.when(F.col("bounded"), F.lit("INFO")).otherwise(F.lit("INCOMPLETE")).alias("severity"), "tier", left.alias("n"))


def channels_shown(channels: DataFrame) -> DataFrame:
    """VD-07: channels are shown when there are several, or one with signals outside of the target."""
    n = channels.agg(F.count("*").alias("n"), F.coalesce(F.max("signals"), F.lit(0)).alias("signals"))
    return n.select(((F.col("n") > 1) | (F.col("signals") > 0)).alias("shown"))


def checked(frames: dict[str, DataFrame]) -> DataFrame:
    """VD-12: how many rows each part of a record rests on, empty parts too."""
    out = None
    for name, rows in sorted(frames.items()):
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
