"""Rows of reports: products and sites by species, variants of an oligo by class (AG-17, AG-18, AG-21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _named(rows: DataFrame, species: DataFrame) -> DataFrame:
    """With the species of each taxid; without one a row is of an unknown species."""
    return rows.join(species.select("taxid", F.col("name").alias("species")), "taxid", "left").withColumn("species", F.coalesce("species", F.lit("unknown")))


def product_groups(products: DataFrame, sites: DataFrame, species: DataFrame) -> DataFrame:
    """AG-17: (tier, species, products, records, detected, shortest, longest, pairs, best_left, best_right, best_defects) by tier and species.

    Products are (tier, accession, start, end, length, left_id, right_id,
    left_role, right_role, probe_id); those of :func:`specificity.products` with
    details need no look at the sites again (of sites that share an id if they are
    :func:`specificity.told_by_id`). Equal ones of a record, place, pair of roles
    and tier count once. The best has the fewest defects of both primer sites,
    then a probe inside, then the lowest ids.
    """
    place = ["tier", "accession", "start", "end", "left_role", "right_role"]
    if "left_defects" in products.columns:
        j, place = products, [*place, "bin"]  # the start tells the bin; pairs are dealt by it, and stay where they are
    else:
        s = sites.select("site_id", "taxid", (F.col("mismatches") + F.col("gaps")).alias("d"))
        j = products.join(s.withColumnsRenamed({"site_id": "left_id", "d": "left_defects"}), "left_id").join(s.select(F.col("site_id").alias("right_id"), F.col("d").alias("right_defects")), "right_id")
    # What tells products apart comes first, so that of equal ones only the best goes on.
    order = F.struct((F.col("left_defects") + F.col("right_defects")).alias("defects"), F.col("probe_id").isNull().alias("silent"), "left_id", "right_id")
    once = j.groupBy(*place).agg(F.min(order).alias("o"), F.min("length").alias("length"), F.min("taxid").alias("taxid"), F.bool_or(F.col("probe_id").isNotNull()).alias("detected"))
    pair = F.concat_ws("/", "left_role", "right_role")
    g = _named(once, species).groupBy("tier", "species")
    return g.agg(
        F.count("*").alias("products"), F.count_distinct("accession").alias("records"), F.count_if("detected").alias("detected"), F.min("length").alias("shortest"), F.max("length").alias("longest"),
        F.array_join(F.array_sort(F.collect_set(pair)), ",").alias("pairs"), F.min("o").alias("o"),
    ).select("tier", "species", "products", "records", "detected", "shortest", "longest", "pairs", F.col("o.left_id").alias("best_left"), F.col("o.right_id").alias("best_right"), F.col("o.defects").alias("best_defects"))


def site_groups(sites: DataFrame, species: DataFrame) -> DataFrame:
    """AG-18: (tier, species, sites, records, critical, warning, closest, defects) of the (…, level) sites above minor, by tier and species."""
    s = _named(sites.where("level <> 'minor'"), species)
    order = F.struct((F.col("mismatches") + F.col("gaps")).alias("defects"), (-F.col("clean3")).alias("minus"), "site_id")
    g = s.groupBy("tier", "species").agg(F.count("*").alias("sites"), F.count_distinct("accession").alias("records"), F.count_if(F.col("level") == "critical").alias("critical"), F.count_if(F.col("level") == "warning").alias("warning"), F.min(order).alias("o"))
    return g.select("tier", "species", "sites", "records", "critical", "warning", F.col("o.site_id").alias("closest"), F.col("o.defects").alias("defects"))


def oligo_view(variants: DataFrame, top_tolerated: int = 5, least: int = 2, kinds: int = 3) -> DataFrame:
    """AG-21: (oligo, part, grade, variant, variants, records, kinds) of (oligo, variant, grade, n, kind) variants.

    Part ``perfect`` sums up the perfect ones. Part ``listed`` has a row for each
    variant of a worse grade that at least ``least`` records show, and for the
    ``top_tolerated`` most frequent tolerated ones. Part ``lumped`` sums up the
    other tolerated ones, part ``singles`` the rare ones of each grade, with the
    kinds that most of them are of.
    """
    grade = F.coalesce("grade", F.lit("not_classified"))
    v = variants.withColumn("grade", grade)
    order = Window.partitionBy("oligo", "grade").orderBy(F.desc("n"), "variant")
    tolerated = F.col("grade") == "tolerated"
    top = v.where(tolerated).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_tolerated).select("oligo", "variant", F.lit(True).alias("_top"))
    v = v.join(top, ["oligo", "variant"], "left")
    part = F.when(F.col("grade") == "perfect", "perfect").when(tolerated, F.when(F.col("_top"), "listed").otherwise("lumped")).when(F.col("n") < least, "singles").otherwise("listed")
    v = v.withColumn("part", part)
    text = F.lit(None).cast("string")
    listed = v.where("part = 'listed'").select("oligo", "part", "grade", "variant", F.lit(1).cast("long").alias("variants"), F.col("n").cast("long").alias("records"), text.alias("kinds"))
    per = v.where("part <> 'listed'").groupBy("oligo", "part", "grade", F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("c"), F.sum("n").alias("k"))
    told = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("minus"), "kind"))), 1, kinds), lambda x: F.concat(x["kind"], F.lit("="), (-x["minus"]).cast("string")))
    summed = per.groupBy("oligo", "part", "grade").agg(F.sum("c").alias("variants"), F.sum("k").alias("records"), F.array_join(told, ",").alias("kinds"))
    summed = summed.withColumn("kinds", F.when(F.col("part") == "singles", F.col("kinds")))
    return listed.unionByName(summed.select("oligo", "part", "grade", F.lit(None).cast(variants.schema["variant"].dataType).alias("variant"), "variants", "records", "kinds"))
