"""What a search is certain to report: score floors by tier and by taxon group, and what follows from them (SP-16, SP-17, VD-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amplispark.operators.specificity import MIN_IDENTICAL, always_reported

# How the size of a search space is known, from the most direct to the least; mismatches that a probe binds with, and one with a minor-groove binder.
SOURCES = ("reported", "from_hits", "upper_bound")
PROBE_LIMIT, MGB_LIMIT = 2, 1
#: Why the absence of a probe site is no evidence, in the order in which it is looked for.
REASONS = ("gapped", "unknown", "cut", "mismatches", "short")


def taxon_group(taxids: Column) -> Column:
    """The taxa of a search as text, in the order of the search."""
    return F.array_join(F.transform(taxids, lambda x: x.cast("string")), ",")


def floors(searches: DataFrame) -> DataFrame:
    """SP-16: per (tier, query) the floor of its least sensitive search, which search and taxa set it, and what else weakens it.

    Searches are (search, tier, query, length, floor, source, list_full, taxids),
    the floor null where the report has no statistics. ``per_group`` has the
    floor of each group of taxa (null where none is known), by group;
    ``space_source`` is the least direct source of a known floor.
    """
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    s = searches.withColumns({"group": taxon_group(F.col("taxids")), "_known": F.col("floor").isNotNull()})
    groups = s.groupBy("tier", "query", "group").agg(
        F.max("floor").alias("floor"), F.max("length").alias("length"), F.count("*").alias("searches"), F.count_if(~F.col("_known")).alias("unknown"), F.bool_or("list_full").alias("list_full"),
        F.max(F.when(F.col("_known"), rank)).alias("source"), F.max(F.when(F.col("_known"), F.struct("floor", (-F.col("search")).alias("minus")))).alias("top"),
    )
    per = groups.groupBy("tier", "query").agg(
        F.max("length").alias("length"), F.max("floor").alias("floor"), F.sum("searches").alias("searches"), F.sum("unknown").alias("without_statistics"), F.bool_or("list_full").alias("list_full"),
        F.get(F.array(*map(F.lit, SOURCES)), F.coalesce(F.max("source"), F.lit(1)).cast("int") - 1).alias("space_source"), F.max(F.struct("top", "group")).alias("top"),
        F.array_sort(F.collect_list(F.struct("group", "floor"))).alias("per_group"),
    )
    known = F.col("floor").isNotNull()
    return per.select(
        "tier", "query", "length", "floor", F.when(known, always_reported(F.col("length"), F.col("floor"))).alias("always"), "searches", "without_statistics", "list_full", "space_source",
        F.when(known, -F.col("top.top.minus")).alias("set_by"), F.when(known, F.col("top.group")).alias("set_by_group"), "per_group",
    )


def probe_bound(tiers: DataFrame, probes: DataFrame, found: DataFrame, truncated: DataFrame, least: int = MIN_IDENTICAL) -> DataFrame:
    """SP-17: (tier, bounded, reason, query): whether a probe site that could give signal would have been reported, else the first condition that fails.

    Tiers are (tier, gapped_can_bind), probes an assay's own (query, length,
    mgb), truncated (tier, query) whose assessment was cut. The conditions in
    order: no gapped site can bind in the tier; and of each probe, by name, a
    floor is known for all searches, no list or assessment was cut, sites with
    as many mismatches as it binds with are always reported, and it is long
    enough for such a site to be relevant.
    """
    limit = F.when(F.col("mgb"), MGB_LIMIT).otherwise(PROBE_LIMIT)
    cut = truncated.select("tier", "query", F.lit(True).alias("_cut")).distinct()
    each = tiers.crossJoin(F.broadcast(probes.withColumnRenamed("length", "probe_length")))  # an assay's own probes, a handful
    j = each.join(found.select("tier", "query", "floor", "always", "without_statistics", "list_full"), ["tier", "query"], "left").join(cut, ["tier", "query"], "left")
    reason = (
        F.when(F.col("floor").isNull() | (F.col("without_statistics") > 0), "unknown")
        .when(F.col("list_full") | F.col("_cut").isNotNull(), "cut")
        .when(F.col("always") < limit, "mismatches")
        .when(F.col("probe_length") - 4 * limit < least, "short")
    )
    failing = j.select("tier", F.struct("query", reason.alias("reason")).alias("f")).where("f.reason IS NOT NULL").groupBy("tier").agg(F.min("f").alias("f"))
    out = tiers.join(failing, "tier", "left")
    gapped = F.col("gapped_can_bind")
    told = F.when(gapped, F.lit("gapped")).otherwise(F.col("f.reason"))
    return out.select("tier", told.isNull().alias("bounded"), told.alias("reason"), F.when(~gapped, F.col("f.query")).alias("query"))


def floor_findings(found: DataFrame) -> DataFrame:
    """VD-14: (tier, severity, topic, oligos, line, per_search) of every tier: for information, up to how many mismatches each oligo's sites are certain to be reported.

    ``per_search`` has, where a tier was searched in several groups of taxa, the
    lowest and highest floor of each over the oligos.
    """
    note = F.when(F.col("list_full"), " unless cut from the full list").otherwise("")
    source = F.when(F.col("space_source") == "reported", "").otherwise(F.concat(F.lit(" ("), F.col("space_source"), F.lit(")")))
    words = (
        F.when(F.col("floor").isNull(), F.concat("query", F.lit(": not known")))
        .when(F.col("always") < 0, F.concat_ws("", "query", F.lit(": score "), F.col("floor").cast("string"), F.lit(", no site is certain")))
        .otherwise(F.concat_ws("", "query", F.lit(": score "), F.col("floor").cast("string"), F.lit(", up to "), F.col("always").cast("string"), F.lit(" mismatches"), note, source))
    )
    lines = found.groupBy("tier").agg(F.count("*").alias("oligos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query", words.alias("w")))), lambda x: x["w"]), "; ").alias("line"))
    groups = found.select("tier", F.explode("per_group").alias("g")).groupBy("tier", F.col("g.group").alias("group")).agg(F.min("g.floor").alias("low"), F.max("g.floor").alias("high"))
    span = F.when(F.col("low").isNull(), "no statistics").when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", F.col("low").cast("string"), F.col("high").cast("string")))
    told = groups.groupBy("tier").agg(F.array_sort(F.collect_list(F.concat(F.lit("["), "group", F.lit("]: "), span))).alias("s"))
    per = told.select("tier", F.when(F.size("s") > 1, F.array_join("s", "; ")).alias("per_search"))
    return lines.join(per, "tier", "left").select("tier", F.lit("INFO").alias("severity"), F.lit("search").alias("topic"), "oligos", "line", "per_search")
