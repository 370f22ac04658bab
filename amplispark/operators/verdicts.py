"""The status of a whole fragment over years, and the findings of an off-target search (VD-01, VD-05)."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amplispark.operators.assess import bracket, hold_back


class Limits(NamedTuple):
    """Years before the last one that count, genomes that a window and a year need, percentages, and whether a failure waits for complete coverage."""

    window_years: int = 3
    least: int = 100
    least_year: int = 30
    fail: float = 80.0
    warn: float = 95.0
    open_share: float = 25.0
    hold_fail: bool = True


def fragment_verdict(years: DataFrame, runs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """VD-05: (run, status, would_be, reason, first, last, n, percent, with_risk, low, high, undetermined_share, undated_share, years_below) of every run.

    Years are (run, year, detectable, at_risk, not_detected, undetermined), runs
    (run, last, undated, with_region, complete): the year the window ends (null:
    the last with genomes), genomes without a usable date of those with the
    region (null where years are release years), and whether all genomes are
    assessed. The pooled share decides; where it passes, a single year of the
    window with enough genomes that lies below the failing limit makes a warning.
    ``would_be`` is the status that incomplete coverage holds back.
    """
    counted = F.col("detectable") + F.col("at_risk") + F.col("not_detected")
    y = years.withColumn("n_y", counted).join(runs.select("run", "last"), "run")
    ends = y.groupBy("run").agg(F.coalesce(F.max("last"), F.max(F.when(F.col("n_y") + F.col("undetermined") > 0, F.col("year")))).alias("end"))
    inside = y.join(ends, "run").where((F.col("year") <= F.col("end")) & (F.col("year") >= F.col("end") - limits.window_years))
    below = (F.col("n_y") >= limits.least_year) & (100.0 * F.col("detectable") < limits.fail * F.col("n_y"))
    pooled = inside.groupBy("run").agg(
        F.min("year").alias("first"), F.max("end").alias("end"), *[F.sum(x).alias(x) for x in ("detectable", "at_risk", "not_detected", "undetermined")], F.sum("n_y").alias("n"),
        F.array_sort(F.collect_list(F.when(below, F.col("year")))).alias("below"),
    )
    j = runs.join(pooled, "run", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = lambda a, b: F.round(F.try_divide(F.lit(100.0) * a, b), 6)
    pct, open_share, undated = share(F.col("detectable"), F.col("n")), share(F.col("undetermined"), F.col("n") + F.col("undetermined")), share(F.col("undated"), F.col("with_region"))
    reason = (
        F.when(F.coalesce(F.col("n") + F.col("undetermined"), F.lit(0)) == 0, "no_genomes").when(F.col("n") < limits.least, "too_few").when(open_share > limits.open_share, "undetermined")
        .when(undated > limits.open_share, "undated").when(pct < limits.fail, "below_fail").when(pct < limits.warn, "below_warn").when(F.size("below") > 0, "year_below").otherwise("passes")
    )
    status_of = {"no_genomes": "INCOMPLETE", "too_few": "INCOMPLETE", "undetermined": "INCOMPLETE", "undated": "INCOMPLETE", "below_fail": "FAIL", "below_warn": "WARN", "year_below": "WARN", "passes": "PASS"}
    status = F.create_map(*[F.lit(x) for kv in status_of.items() for x in kv])[F.col("reason")]
    j = j.withColumn("reason", reason).withColumn("would_be", status)
    b = bracket(F.col("detectable"), F.col("at_risk") + F.col("not_detected"), F.col("undetermined"))
    return j.select(
        "run", hold_back(F.col("would_be"), F.col("complete"), limits.hold_fail).alias("status"), "would_be", "reason", "first", F.col("end").alias("last"), "n", pct.alias("percent"), share(F.col("detectable") + F.col("at_risk"), F.col("n")).alias("with_risk"),
        b["low"].alias("low"), b["high"].alias("high"), open_share.alias("undetermined_share"), undated.alias("undated_share"), F.coalesce(F.array_join("below", ","), F.lit("")).alias("years_below"),
    )


#: Findings of this tier are for information.
OUT_OF_SCOPE = "out_of_scope"
# What each kind of finding weighs by default.
SEVERITY = {
    "primer_site_critical": "WARN", "primer_site_critical_no_product": "WARN", "primer_site_warning": "WARN", "probe_site_critical": "INFO", "probe_site_warning": "INFO", "product_detected": "FAIL",
    "product_not_detected": "WARN",
}


class Search(NamedTuple):
    """What a search has left, as DataFrames; all but the sites and products are small."""

    sites: DataFrame  # site_id, tier, role, level, mismatches, gaps, clean3, accession
    products: DataFrame  # tier, left_id, right_id, probe_id, pattern
    saturated: DataFrame  # tier, query
    counts: DataFrame  # tier, query, relevant, assessed
    failed: DataFrame  # tier, windows
    cut: DataFrame  # tier
    perfect: DataFrame  # role, hits: of the intended target; no rows where it was not searched


def search_findings(found: Search, searched: DataFrame, required: list[str], waivers: Mapping[str, str], severity: Mapping[str, str] = SEVERITY) -> DataFrame:
    """VD-01: (severity, topic, code, tier, about, n): every finding of a search, one union of aggregates over whole tables.

    Searched are the (tier) that were assessed. Codes: scope, unsearched, waived,
    no_tier, saturated, assessment_cut, fetch_failed, the kinds of sites and
    products, products_cut, primer_only and intended_target. ``about`` names the
    oligos, the closest site, the number of product patterns or the reason.
    """
    spark = searched.sparkSession
    judged = lambda s, tier="tier": F.when(F.col(tier) == OUT_OF_SCOPE, "INFO").otherwise(s if isinstance(s, Column) else F.lit(s))
    text = F.lit(None).cast("string")

    def line(rows: DataFrame, topic: str, code: Column | str, sev: Column | str, about: Column = text, n: Column | str = "n", tier: Column | str = "tier") -> DataFrame:
        named = lambda x: F.lit(x) if isinstance(x, str) else x
        of = F.col(tier) if isinstance(tier, str) else tier
        return rows.select(named(sev).alias("severity"), F.lit(topic).alias("topic"), named(code).alias("code"), of.alias("tier"), about.alias("about"), (F.col(n) if isinstance(n, str) else n).cast("long").alias("n"))

    tiers = searched.select("tier").distinct()
    names = tiers.agg(F.array_join(F.array_sort(F.collect_set("tier")), ", ").alias("names"), F.count("*").alias("n"), F.count_if(F.col("tier") != OUT_OF_SCOPE).alias("judged"))
    listed = spark.createDataFrame([(t,) for t in required if t not in waivers], "tier string").join(tiers, "tier", "left_anti").withColumn("n", F.lit(1))
    waived = spark.createDataFrame([*waivers.items()], "tier string, why string").join(tiers, "tier", "left_anti").withColumn("n", F.lit(1))
    full = found.saturated.groupBy("tier").agg(F.array_join(F.array_sort(F.collect_set("query")), ", ").alias("names"), F.count_distinct("query").alias("n"))
    short = found.counts.where("assessed < relevant")
    out = [
        line(names, "search", "scope", "INFO", F.col("names"), tier=text),
        line(listed, "search", "unsearched", "INCOMPLETE"),
        line(waived, "search", "waived", "INFO", F.col("why")),
        line(names.where("judged = 0"), "search", "no_tier", "INCOMPLETE", tier=text),
        line(full, "search", "saturated", judged("INCOMPLETE"), F.col("names")),
        line(short, "search", "assessment_cut", judged("INCOMPLETE"), F.col("query"), F.col("relevant") - F.col("assessed")),
        line(found.failed.groupBy("tier").agg(F.sum("windows").alias("n")).where("n > 0"), "search", "fetch_failed", judged("INCOMPLETE")),
    ]
    ends = found.products.select(F.explode(F.array("left_id", "right_id")).alias("site_id")).distinct().withColumn("_in", F.lit(True))
    sites = found.sites.where("level <> 'minor'").join(ends, "site_id", "left")
    probe, inside = F.col("role") == "probe", F.coalesce("_in", F.lit(False))
    code = F.concat(F.when(probe, "probe_site_").otherwise("primer_site_"), "level", F.when(~probe & (F.col("level") == "critical") & ~inside, "_no_product").otherwise(""))
    weight = F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])
    closest = F.min_by("site_id", F.struct(F.col("mismatches") + F.col("gaps"), -F.col("clean3"), F.col("site_id")))
    groups = sites.groupBy("tier", code.alias("code")).agg(F.count("*").alias("n"), closest.cast("string").alias("closest"))
    out.append(line(groups, "sites", F.col("code"), judged(weight[F.col("code")]), F.col("closest")))
    kinds = found.products.groupBy("tier", F.when(F.col("probe_id").isNotNull(), "product_detected").otherwise("product_not_detected").alias("code")).agg(F.count("*").alias("n"), F.count_distinct("pattern").alias("patterns"))
    out.append(line(kinds, "products", F.col("code"), judged(weight[F.col("code")]), F.concat(F.col("patterns").cast("string"), F.lit(" patterns"))))
    out.append(line(found.cut.distinct().withColumn("n", F.lit(1)), "products", "products_cut", judged("INCOMPLETE")))
    lonely = sites.where(~probe & ~inside).agg(F.count("*").alias("n")).where("n > 0")
    out.append(line(lonely, "products", "primer_only", "INFO", tier=text))
    roles = spark.createDataFrame([("forward",), ("probe",), ("reverse",)], "role string")
    hits = roles.join(found.perfect.groupBy("role").agg(F.sum("hits").alias("hits")), "role", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    told = F.array_join(F.array_sort(F.collect_list(F.concat("role", F.lit(" "), F.col("hits").cast("string")))), ", ")
    target = hits.agg(told.alias("told"), F.count_if(F.col("hits") == 0).alias("n")).join(found.perfect.limit(1).select(F.lit(1).alias("_s")), F.lit(True), "inner")  # one row each
    out.append(line(target, "search", "intended_target", F.when(F.col("n") > 0, "WARN").otherwise("INFO"), F.col("told"), tier=text))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def exclusivity_verdict(tiers: DataFrame, sites: DataFrame, products: DataFrame, severity: Mapping[str, str] = SEVERITY) -> DataFrame:
    """TX-10: (tier, verdict, severities, organisms, resolved) of every (tier, searched, organisms, resolved).

    The worst of what the tier's sites and products weigh; a tier that was not
    searched is incomplete, and so is one with organisms that no taxon was found
    for, unless it fails already. Sites are (tier, site_id, role, level), products
    (tier, left_id, right_id, probe_id).
    """
    weight = F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])
    ends = products.select(F.explode(F.array("left_id", "right_id")).alias("site_id")).distinct().withColumn("_in", F.lit(True))
    probe = F.col("role") == "probe"
    code = F.when(probe, F.when(F.col("level") == "critical", "probe_site_critical")).when(F.col("level") == "warning", "primer_site_warning").when(F.col("_in"), "primer_site_critical").otherwise("primer_site_critical_no_product")
    of_sites = sites.where("level <> 'minor'").join(ends, "site_id", "left").select("tier", code.alias("code"))
    of_products = products.select("tier", F.when(F.col("probe_id").isNotNull(), "product_detected").otherwise("product_not_detected").alias("code"))
    kinds = of_sites.unionByName(of_products).where("code IS NOT NULL").groupBy("tier", "code").agg(F.count("*").alias("n"))
    told = kinds.groupBy("tier").agg(F.array_sort(F.collect_set(weight[F.col("code")])).alias("s"))
    j = tiers.join(told, "tier", "left").withColumn("s", F.coalesce("s", F.array().cast("array<string>")))
    has = lambda x: F.array_contains("s", x)
    verdict = F.when(~F.col("searched"), "INCOMPLETE").when(has("FAIL"), "FAIL").when(F.col("resolved") < F.col("organisms"), "INCOMPLETE").when(has("WARN"), "WARN").otherwise("PASS")
    return j.select("tier", verdict.alias("verdict"), F.array_join("s", ",").alias("severities"), "organisms", "resolved")
