"""Tiers, lineages and exclusivity (TX-*), and the planning of searches (PL-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: TX-02: the tiers, the most specific first.
TIERS = ("near", "background", "other")


def ancestors(taxa: DataFrame) -> DataFrame:
    """E26: (taxid, ancestor, depth) closure of (taxid, parent), itself at depth 0."""
    return taxa.sparkSession.sql(
        """WITH RECURSIVE up(taxid, ancestor, depth) AS (
             SELECT taxid, taxid, 0 FROM {t}
             UNION ALL SELECT u.taxid, t.parent, u.depth + 1 FROM up u JOIN {t} t ON u.ancestor = t.taxid WHERE t.parent IS NOT NULL)
           SELECT taxid, ancestor, depth FROM up""",
        t=taxa,
    )


def tier_rank() -> Column:
    """The place of a tier in TIERS."""
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))


def dedupe_tiers(listed: DataFrame) -> DataFrame:
    """TX-01, TX-02: each taxon in its most specific tier, with the number of tiers that name it."""
    each = listed.select("tier", "taxid").distinct()
    return each.groupBy("taxid").agg(F.min_by("tier", tier_rank()).alias("tier"), F.count("*").alias("named"))


def lineage_rules(tiers: DataFrame, closure: DataFrame, target: int) -> DataFrame:
    """TX-03: what a tier's taxon has to do with the target: refused, exclude_target or plain, and how many more specific taxa it must exclude."""
    above_target = closure.where(F.col("taxid") == target).select(F.col("ancestor").alias("taxid"), F.lit(True).alias("above"))
    inside = closure.where(F.col("ancestor") == target).select("taxid", F.lit(True).alias("inside"))
    own = tiers.join(above_target, "taxid", "left").join(inside, "taxid", "left")
    ranked = tiers.select(F.col("taxid").alias("other"), tier_rank().alias("other_rank"))
    below = closure.where("depth > 0").join(ranked, F.col("taxid") == F.col("other")).select(F.col("ancestor"), "other", "other_rank")
    more = tiers.withColumn("r", tier_rank()).join(below, F.col("taxid") == F.col("ancestor")).where("other_rank < r").groupBy("taxid").agg(F.count("*").alias("excluded"))
    rule = F.when(F.col("inside"), F.lit("refused")).when(F.col("above"), F.lit("exclude_target")).otherwise(F.lit("plain"))
    return own.join(more, "taxid", "left").select("taxid", "tier", rule.alias("rule"), F.coalesce("excluded", F.lit(0)).alias("excluded"))


def outside(taxids: DataFrame, closure: DataFrame, target: int) -> DataFrame:
    """TX-04: taxids that are not in the target's lineage."""
    return taxids.join(closure.where(F.col("ancestor") == target).select("taxid"), "taxid", "left_anti")


def resolve_names(asked: DataFrame, names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """TX-05: a name with one taxid is resolved, with more ambiguous; without any its synonyms are tried; never a guess."""
    def found(table: DataFrame, suffix: str) -> DataFrame:
        return table.groupBy("name").agg(F.countDistinct("taxid").alias(f"n{suffix}"), F.min("taxid").alias(f"id{suffix}"))

    j = asked.join(found(names, "1"), "name", "left").join(found(synonyms, "2"), "name", "left")
    n, taxid = F.coalesce("n1", "n2", F.lit(0)), F.coalesce("id1", "id2")
    status = F.when(n == 0, F.lit("unresolved")).when(n == 1, F.lit("resolved")).otherwise(F.lit("ambiguous"))
    return j.select("name", status.alias("status"), F.when(n == 1, taxid).alias("taxid"))


def lineage(taxa: DataFrame, closure: DataFrame) -> DataFrame:
    """TX-06: species, genus and family of each taxon; the nearest of each rank."""
    named = closure.join(taxa.select(F.col("taxid").alias("ancestor"), "rank", "name"), "ancestor")
    of = lambda r: F.min_by(F.when(F.col("rank") == r, F.col("name")), F.when(F.col("rank") == r, F.col("depth"))).alias(r)
    return named.groupBy("taxid").agg(of("species"), of("genus"), of("family"))


def rollup(sites: DataFrame, lineages: DataFrame) -> DataFrame:
    """TX-07: sites per species, genus and family, and over all, by grouping sets."""
    j = sites.join(lineages, "taxid", "left").select("family", "genus", "species")
    return j.sparkSession.sql(
        "SELECT family, genus, species, count(*) AS n, CAST(grouping_id(family, genus, species) AS INT) AS g FROM {j} GROUP BY GROUPING SETS ((family, genus, species), (family, genus), (family), ())", j=j
    )


def in_tier(hits: DataFrame, tier_taxa: DataFrame, closure: DataFrame) -> DataFrame:
    """SP-02: hits with ``inside``: their taxon is below one of the tier's; a taxon without lineage counts as inside."""
    below = closure.join(tier_taxa.select("tier", F.col("taxid").alias("ancestor")), "ancestor").select("tier", "taxid", F.lit(True).alias("below")).distinct()
    known = closure.select("taxid", F.lit(True).alias("known")).distinct()
    j = hits.join(below, ["tier", "taxid"], "left").join(known, "taxid", "left")
    return j.withColumn("inside", F.coalesce("below", F.lit(False)) | F.col("known").isNull()).withColumn("checkable", F.col("known").isNotNull()).drop("below", "known")


def exclusivity(listed: DataFrame, sites: DataFrame, closure: DataFrame) -> DataFrame:
    """TX-08, TX-09: sites of each listed organism: a site counts for its most specific listed ancestor; rows without sites stay."""
    of_site = sites.join(closure, "taxid").join(listed.select(F.col("taxid").alias("ancestor")), "ancestor")
    nearest = of_site.groupBy("site_id").agg(F.min_by("ancestor", F.struct("depth", (-F.col("ancestor")).alias("a"))).alias("listed"), F.first("level_rank").alias("level_rank"), F.first("defects").alias("defects"))
    counted = nearest.groupBy("listed").agg(F.count("*").alias("n"), F.max_by("site_id", F.struct("level_rank", (-F.col("defects")).alias("d"), (-F.col("site_id")).alias("s"))).alias("best"))
    return listed.join(counted, F.col("taxid") == F.col("listed"), "left").select("taxid", F.coalesce("n", F.lit(0)).alias("n"), "best")


def membership(taxids: DataFrame, roles: DataFrame, closure: DataFrame) -> DataFrame:
    """TX-13: the role of the first listed taxon, by position, that a taxid lies in; unknown without one."""
    j = taxids.join(closure, "taxid", "left").join(roles.select(F.col("taxid").alias("ancestor"), "role", "pos"), "ancestor", "left")
    return j.groupBy("taxid").agg(F.coalesce(F.min_by("role", "pos"), F.lit("unknown")).alias("role"))


def not_searched(required: DataFrame, searched: DataFrame, waived: DataFrame) -> DataFrame:
    """TX-11: tiers that are required, not waived and not searched."""
    return required.select("tier").subtract(searched.select("tier")).subtract(waived.select("tier"))


def chunks(rows: DataFrame, size: int, key: str, order: str) -> DataFrame:
    """PL-03: the rows of each key in chunks of near-equal size, at most ``size``, in order; the first ones are the larger."""
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(key))).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    k = F.ceil(F.col("_n") / size)
    small, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    cut = extra * (small + 1)
    chunk = F.when(F.col("_r") < cut, F.floor(F.col("_r") / (small + 1))).otherwise(extra + F.floor((F.col("_r") - cut) / small))
    return counted.withColumn("chunk", (chunk + 1).cast("int")).drop("_n", "_r")


def batches(lengths: DataFrame, most: int, key: str, order: str, length: str) -> DataFrame:
    """PL-02: (key, batch numbers) of queries put one after another into batches of at most ``most`` bases; a key's queries are few."""
    row = F.sort_array(F.collect_list(F.struct(order, F.col(length).cast("int").alias("len"))))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        full = (acc["used"] + x["len"] > most) & (F.size(acc["out"]) > 0)
        batch = acc["batch"] + F.when(full, 1).otherwise(0)
        return F.struct(F.when(full, x["len"]).otherwise(acc["used"] + x["len"]).alias("used"), batch.alias("batch"), F.concat(acc["out"], F.array(batch)).alias("out"))

    return lengths.groupBy(key).agg(row.alias("_rows")).select(key, F.array_join(F.transform(F.aggregate("_rows", start, step)["out"], lambda b: b.cast("string")), ",").alias("batches"))
