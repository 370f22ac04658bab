"""Assessment of listed genomes (AS-*, AG-*, TW-*, VD-*) beyond the yearly table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amplispark.operators.inclusivity import count_if, percent

# Verdicts with their exit codes, the least concerning first.
VERDICTS = (("PASS", 0), ("WARN", 10), ("INCOMPLETE", 30), ("FAIL", 20))


def unassembled(calls: DataFrame, least: int = 5) -> DataFrame:
    """AS-12: incomplete genomes that miss a target which complete ones hold in several copies.

    The median copy number of at least ``least`` complete genomes must be 2 or
    more, the draft hold fewer than half of it, and its pattern not be one that
    complete genomes fail with.
    """
    complete = calls.where("level = 'complete'")
    median = complete.agg(F.median("copies").alias("median"), F.count("*").alias("n"))
    real = complete.where("detectable = 0").select("pattern").distinct()
    drafts = calls.where("level <> 'complete' AND detectable = 0").join(F.broadcast(median)).where((F.col("n") >= least) & (F.col("median") >= 2) & (F.col("copies") * 2 < F.col("median")))
    return drafts.join(real, "pattern", "left_anti").select("accession", "copies")


def from_parts(sites: DataFrame, wanted: list[str]) -> DataFrame:
    """AS-06: of every genome and oligo the best site over its cut copies; a genome counts when all oligos have one that is ok."""
    best = sites.groupBy("accession", "oligo").agg(F.min_by("ok", F.struct("mismatches", "copy")).alias("ok"))
    return best.groupBy("accession").agg((F.count("*") == len(wanted)).alias("complete"), F.bool_and("ok").alias("all_ok")).select("accession", (F.col("complete") & F.col("all_ok")).alias("detectable"))


def year_stats(sites: DataFrame) -> DataFrame:
    """AG-07: per oligo and year how many sites are perfect, have one or more mismatches, and where the mismatches stand."""
    per = sites.groupBy("oligo", "year").agg(count_if(F.size("positions") == 0).alias("perfect"), count_if(F.size("positions") == 1).alias("one"), count_if(F.size("positions") > 1).alias("more"), F.first("length").alias("length"))
    at = sites.select("oligo", "year", F.explode("positions").alias("p")).groupBy("oligo", "year", "p").agg(F.count("*").cast("int").alias("n"))
    at = at.groupBy("oligo", "year").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("m"))
    j = per.join(at, ["oligo", "year"], "left")
    histogram = F.transform(F.sequence(F.lit(1), F.col("length")), lambda i: F.coalesce(F.col("m")[i], F.lit(0)))
    return j.select("oligo", "year", "perfect", "one", "more", F.array_join(F.transform(histogram, lambda x: x.cast("string")), ",").alias("histogram"))


def collection_bucket(year: Column, read: Column, first: Column) -> Column:
    """TW-04: the year, -1 if earlier than the first shown, -2 if undated, -3 if not read."""
    return F.when(~read, F.lit(-3)).when(year.isNull(), F.lit(-2)).when(year < first, F.lit(-1)).otherwise(year)


def collection_axis(genomes: DataFrame, first: int) -> DataFrame:
    """TW-05: genomes by collection year, with labelled rows for what has none."""
    b = genomes.withColumn("bucket", collection_bucket(F.col("year"), F.col("read"), F.lit(first)))
    label = F.when(F.col("bucket") == -1, F.lit("earlier")).when(F.col("bucket") == -2, F.lit("undated")).when(F.col("bucket") == -3, F.lit("not read")).otherwise(F.col("bucket").cast("string"))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("detectable").alias("detectable")).select(label.alias("label"), "n", "detectable", percent(F.col("detectable"), F.col("n")).alias("percent"))


def shown_years(years: DataFrame, lookback: int, run_year: int) -> DataFrame:
    """TW-02: the last ``lookback`` years up to the run's own, those without genomes with 0."""
    spine = years.sparkSession.range(run_year - lookback + 1, run_year + 1).select(F.col("id").cast("int").alias("year"))
    return spine.join(years, "year", "left").select("year", F.coalesce("listed", F.lit(0)).alias("listed"))


def newest_first(rows: DataFrame, when: str, budget: int) -> DataFrame:
    """The ``budget`` newest rows by ``when`` (null is oldest), then by accession.

    Rows are counted by ``when`` first; those of the one value in which the
    budget runs out are ordered, up to what is left of it, and no others.
    """
    order = Window.orderBy(F.desc_nulls_last(when)).rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(when).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(order))  # a row a year or day
    cut = counts.where(F.col("upto") > budget).orderBy("upto").first()
    if cut is None:
        return rows
    newer = F.col(when).isNotNull() if cut[when] is None else F.coalesce(F.col(when) > F.lit(cut[when]), F.lit(False))
    at = rows.where(F.col(when).eqNullSafe(F.lit(cut[when]))).orderBy("accession").limit(budget - (cut["upto"] - cut["n"]))
    return rows.where(newer).unionByName(at)


def budgeted(listing: DataFrame, done: DataFrame, budget: int) -> DataFrame:
    """SRC-19, TW-07, ST-02: what a run processes of what the store lacks, newest year first."""
    return newest_first(listing.join(done, "accession", "left_anti"), "year", budget).select("accession", "year")


def channel_results(calls: DataFrame) -> DataFrame:
    """AG-13: signals of each channel in target, other and unknown genomes."""
    is_ = lambda r: F.col("role") == r
    return calls.groupBy("channel").agg(
        count_if(is_("target") & (F.col("state") == "ok")).alias("detected"), count_if(is_("target") & (F.col("state") == "fail")).alias("missed"), count_if(is_("target") & (F.col("state") == "undetermined")).alias("undetermined"),
        count_if(is_("nontarget") & (F.col("state") == "ok")).alias("signals"), count_if(is_("nontarget") & (F.col("state") != "ok")).alias("silent"), count_if(is_("out_of_scope")).alias("out_of_scope"), count_if(is_("unknown")).alias("unknown"),
    )


def channel_verdicts(results: DataFrame, fail: float = 80, warn: float = 95) -> DataFrame:
    """VD-06: a signal outside of the target fails at once; else the share of target genomes detected."""
    pct = F.try_divide(F.lit(100.0) * F.col("detected"), F.col("detected") + F.col("missed"))
    status = F.when(F.col("signals") > 0, F.lit("FAIL")).when(pct.isNull(), F.lit("INCOMPLETE")).when(pct < fail, F.lit("FAIL")).when(pct < warn, F.lit("WARN")).otherwise(F.lit("PASS"))
    return results.select("channel", F.round(pct, 6).alias("percent"), status.alias("status"))


def combined_verdict(sections: DataFrame, required: list[str]) -> DataFrame:
    """VD-02, VD-09: FAIL over INCOMPLETE over WARN over PASS; INFO passes, a required section that is missing is incomplete."""
    names = [v for v, _ in VERDICTS]
    rank = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in names]), F.col("status")), F.lit(0))
    found = sections.groupBy("run").agg(F.max(F.when(F.col("status") == "INFO", F.lit(1)).otherwise(rank)).alias("r"), F.size(F.array_except(F.array(*[F.lit(x) for x in required]), F.collect_set("section"))).alias("missing"))
    r = F.when(F.col("missing") > 0, F.greatest(F.col("r"), F.lit(3))).otherwise(F.col("r"))
    return found.select("run", F.get(F.array(*[F.lit(v) for v in names]), (r - 1).cast("int")).alias("verdict"), F.get(F.array(*[F.lit(c) for _, c in VERDICTS]), (r - 1).cast("int")).alias("code"), "missing")


def hold_back(status: Column, complete: Column, hold_fail: bool = True) -> Column:
    """VD-05, VD-06: a warning waits for complete coverage, a failure unless it is told not to, and a pass is incomplete without it."""
    waits = ["WARN", "PASS", *(["FAIL"] if hold_fail else [])]
    return F.when(~complete & status.isin(waits), F.lit("INCOMPLETE")).otherwise(status)


def bracket(detected: Column, failed: Column, undetermined: Column) -> Column:
    """VD-08: struct<low, high>: the share if all undetermined genomes failed, and if none did."""
    n = detected + failed + undetermined
    return F.struct(percent(detected, n).alias("low"), percent(detected + undetermined, n).alias("high"))


def progress(log: DataFrame) -> DataFrame:
    """ST-08: an ordered fold of (job, line, stage, detail): the highest stage so far and the last detail."""
    so_far = Window.partitionBy("job").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("job", "line", F.max("stage").over(so_far).alias("stage"), F.last("detail", ignorenulls=True).over(so_far).alias("detail"))


def newest_runs(runs: DataFrame) -> DataFrame:
    """SRC-16: of each assay the newest run."""
    order = Window.partitionBy("assay").orderBy(F.desc("generated_at"), F.desc("run"))
    return runs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def shown_rows(rows: DataFrame, most: int) -> DataFrame:
    """AG-19, AG-20: by group how many rows show, those that always do and the first ``most`` of the others, and what the hidden ones sum to.

    What is hidden is all less what shows, so that only the first rows of a
    group are ranked, wherever they lie.
    """
    order = Window.partitionBy("grp").orderBy(F.desc("n"), "k")
    first = rows.where(~F.col("always")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    kept = first.groupBy("grp").agg(F.count("*").alias("_k"), F.sum("n").alias("_s"))
    own = F.col("always")
    per = rows.groupBy("grp").agg(F.count("*").alias("_all"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), F.count(F.when(own, 1)).alias("_a"), F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("_an"))
    j = per.join(kept, "grp", "left")
    shown = F.col("_a") + F.coalesce("_k", F.lit(0))
    return j.select("grp", shown.alias("shown"), (F.col("_all") - shown).alias("hidden"), (F.col("_n") - F.col("_an") - F.coalesce("_s", F.lit(0))).alias("hidden_n"))


def findings(sites: DataFrame, tiers: DataFrame) -> DataFrame:
    """VD-01, VD-14: findings by topic and tier: primer and probe sites above minor, and tiers without any search."""
    of_sites = sites.where("level <> 'minor'").groupBy("tier", F.when(F.col("role") == "probe", F.lit("probe site")).otherwise(F.lit("primer site")).alias("topic")).agg(F.count("*").alias("n"))
    severity = F.when(F.col("topic") == "probe site", F.lit("INFO")).otherwise(F.lit("WARN"))
    of_sites = of_sites.select(severity.alias("severity"), "topic", "tier", "n")
    empty = tiers.join(sites.select("tier").distinct(), "tier", "left_anti").select(F.lit("INCOMPLETE").alias("severity"), F.lit("unsearched").alias("topic"), "tier", F.lit(0).cast("long").alias("n"))
    return of_sites.unionByName(empty)
