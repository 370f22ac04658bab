"""Tables of a report and the smaller steps between (parts of FN-*, PL-*, SP-*, LC-*, AS-*, AG-*, VD-*, OP-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amplispark.functions import seq
from amplispark.functions.session import fixed
from amplispark.operators.inclusivity import count_if, percent

SEVERITIES = ("INFO", "WARN", "INCOMPLETE", "FAIL")


def site_changes(q: Column, s: Column) -> Column:
    """FN-14: what differs in an alignment, as "-3 C-A" (position from the 3' end, oligo base, complement of the site's), gaps as "-3 del" or "-3 ins"."""
    n = F.length(q)

    def named(i: Column) -> Column:
        a, b = F.substring(q, i, F.lit(1)), F.substring(s, i, F.lit(1))
        pos = F.length(F.regexp_replace(F.substring(q, i, n), "-", "")).cast("string")
        what = F.when(b == "-", F.lit("del")).when(a == "-", F.lit("ins")).otherwise(F.concat(a, F.lit("-"), seq.complement(b)))
        return F.when(a != b, F.concat(F.lit("-"), pos, F.lit(" "), what))

    return F.array_join(F.filter(F.transform(F.sequence(F.lit(1), n), named), lambda x: x.isNotNull()), ", ")


def search_terms(tiers: DataFrame, excluded: DataFrame | None = None, taxa_per_search: int = 20) -> DataFrame:
    """PL-04: (tier, chunk, term): the taxa of each chunk of a tier, without the (tier, taxid) taxa that other tiers or the target have of it."""
    any_of = lambda c: F.array_join(F.transform(c, lambda t: F.concat(F.lit("txid"), t.cast("string"), F.lit("[ORGN]"))), " OR ")
    order = F.row_number().over(Window.partitionBy("tier").orderBy("taxid")) - 1
    chunks = tiers.withColumn("chunk", F.floor(order / taxa_per_search)).groupBy("tier", "chunk").agg(F.sort_array(F.collect_list("taxid")).alias("taxa"))
    chunks = chunks.select("tier", "chunk", any_of(F.col("taxa")).alias("term"))
    if excluded is None:
        return chunks
    # A chunk leaves out all that its tier leaves out, as any of its taxa may hold it.
    without = excluded.groupBy("tier").agg(any_of(F.sort_array(F.collect_set("taxid"))).alias("_without"))
    j = chunks.join(without, "tier", "left")
    term = F.when(F.col("_without").isNull(), F.col("term")).otherwise(F.concat(F.lit("("), "term", F.lit(") NOT ("), "_without", F.lit(")")))
    return j.select("tier", "chunk", term.alias("term"))


def planned_searches(oligos: DataFrame, tiers: DataFrame, taxa_per_search: int = 20, excluded: DataFrame | None = None) -> DataFrame:
    """PL-01, PL-04, PL-05: a search for each concrete oligo, tier and chunk of taxa, with its query text and key; all of them a plan's size.

    A key is of the whole request, whose query names its oligo as a FASTA record
    does: equal sequences of two oligos are two requests.
    """
    grown = oligos.select("oligo", seq.expand(F.col("sequence")).alias("all")).withColumn("n", F.size("all"))
    # There is always a variant; without outer a test for one would expand every oligo again, where the table is read.
    variants = grown.select("oligo", "n", F.posexplode_outer("all").alias("v", "sequence"))
    label = F.when(F.col("n") > 1, F.concat("oligo", F.lit("_v"), (F.col("v") + 1).cast("string"))).otherwise(F.col("oligo"))
    query = F.concat(F.lit(">"), "label", F.lit("\n"), "sequence", F.lit("\n"))
    chunks = search_terms(tiers, excluded, taxa_per_search)
    every = variants.select(label.alias("label"), "sequence").crossJoin(F.broadcast(chunks))  # both sides are an assay's own
    return every.select("label", "sequence", "tier", "chunk", "term", F.sha2(F.concat_ws("|", query, "term"), 256).alias("key"))


def fetch_windows(asked: DataFrame, contigs: DataFrame) -> DataFrame:
    """SRC-13: the stretch of each (accession, start, stop), from 1 and inclusive; null where the record is not there."""
    cut = F.substring(F.col("seq"), F.col("start"), F.col("stop") - F.col("start") + 1)
    return asked.join(contigs.select("accession", "seq"), "accession", "left").withColumn("window", cut).drop("seq")


def fresh(cache: DataFrame, now: Column, days: int) -> DataFrame:
    """SRC-14: the newest entry of each key that is not older than ``days``; unreadable entries (null) count as none."""
    ok = cache.where(F.col("value").isNotNull() & (F.col("created") > now - F.expr(f"INTERVAL {days} DAYS")))
    return ok.groupBy("key").agg(F.max_by("value", "created").alias("value"), F.max("created").alias("created"))


def acts(grade: Column, level: Column, cautious: Column) -> Column:
    """SP-10: whether a site can act, by its grade and level: a likely failure never, a good one always, the others by level in cautious tiers."""
    return F.when(grade == "likely_failure", F.lit(False)).when(grade.isin("perfect", "tolerated"), F.lit(True)).when(cautious, level != "minor").otherwise(level == "critical")


def perfect_hits(hsps: DataFrame) -> DataFrame:
    """SP-13: per query the hits with a full-length stretch without mismatch or gap."""
    full = (F.col("identity") == F.col("query_len")) & (F.col("gaps") == 0)
    per = hsps.groupBy("query", "hit").agg(F.bool_or(full).alias("perfect"))
    return per.groupBy("query").agg(count_if(F.col("perfect")).alias("perfect"), F.count("*").alias("hits"))


def hits_per_query(hsps: DataFrame, tiers: list[str]) -> DataFrame:
    """SP-18: relevant hits, a row per query and a column per tier."""
    return hsps.groupBy("query").pivot("tier", tiers).agg(F.countDistinct("hit")).na.fill(0)


def majority_plasmid(sequences: DataFrame) -> DataFrame:
    """LC-17: per genome whether at least half of its target copies lie on a plasmid, by role or else by title."""
    on = F.coalesce(F.col("role") == "plasmid", seq.is_plasmid(F.col("title")))
    return sequences.groupBy("accession").agg((F.avg(on.cast("double")) >= 0.5).alias("on_plasmid"), F.count("*").alias("copies"))


def cut_kinds(genomes: DataFrame) -> DataFrame:
    """AS-08, AG-05: why the copies of genomes are cut, with how many of them are complete assemblies."""
    kind = (
        F.when(F.col("anchored") == 0, F.lit("not_assembled")).when(F.size("seen") == 0, F.lit("no_site")).when(~F.col("sites_ok"), F.lit("sites_fail"))
        .otherwise(F.concat(F.lit("site_cut_ok:"), F.array_join(F.sort_array("lost"), ",")))
    )
    return genomes.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("genomes"), count_if(F.col("level") == "complete").alias("complete"))


def channel_states(sites: DataFrame) -> DataFrame:
    """AS-04, AS-09: per genome and channel the best state over its copies; a copy's is its worst site's."""
    rank = F.when(F.col("state") == "ok", 0).when(F.col("state") == "undetermined", 1).otherwise(2)
    copy = sites.groupBy("accession", "channel", "copy").agg(F.max(rank).alias("r"))
    state = F.get(F.array(F.lit("ok"), F.lit("undetermined"), F.lit("fail")), F.col("r"))
    return copy.groupBy("accession", "channel").agg(F.min("r").alias("r"), F.count("*").alias("copies")).select("accession", "channel", state.alias("state"), "copies")


def run_lengths(labels: DataFrame, most: int = 5) -> DataFrame:
    """AS-10, AG-03: per level the most common run-length labels, equal counts in the order of first appearance."""
    n = labels.groupBy("level", "label").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy("level").orderBy(F.desc("n"), "first")
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("level", "label", "n", "rank")


def alternative_share(genomes: DataFrame) -> DataFrame:
    """AG-11, AG-12, AS-14: detected genomes as judged and if bulges counted as failures, over the same genomes, with pair lines."""
    j = genomes.where("outcome <> 'undetermined'")
    ok = F.col("outcome") == "detectable"
    return j.agg(
        F.count("*").alias("judged"), percent(count_if(ok), F.count("*")).alias("percent"), percent(count_if(ok & ~F.col("bulge")), F.count("*")).alias("without_bulges"),
        count_if((F.col("f") >= 2) & (F.col("r") >= 2)).alias("two_and_two"), count_if((F.col("f") == 0) & (F.col("r") >= 3)).alias("reverse_only"),
    )


def tier_overview(sites: DataFrame, products: DataFrame) -> DataFrame:
    """AG-22, AG-24: per tier its closest primer site and its products, tiers without either kept."""
    primers = sites.where("role <> 'probe'").withColumn("defects", F.col("mismatches") + F.col("gaps"))
    closest = primers.groupBy("tier").agg(F.count("*").alias("sites"), F.min("defects").alias("closest"))
    made = products.groupBy("tier").agg(F.count("*").alias("products"), F.countDistinct("accession").alias("records"), count_if(F.col("probe_id").isNotNull()).alias("detected"))
    return closest.join(made, "tier", "full").na.fill(0)


def decision_lines(findings: DataFrame) -> DataFrame:
    """VD-13: findings of one severity and topic as one line with their tiers."""
    return findings.groupBy("severity", "topic").agg(F.array_join(F.array_distinct(F.sort_array(F.collect_list("tier"))), ", ").alias("tiers"), F.sum("n").alias("n"))


def findings_verdict(findings: DataFrame) -> DataFrame:
    """VD-02, TX-10: FAIL over INCOMPLETE over WARN; PASS where nothing but INFO was found."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    worst = F.coalesce(F.max(rank), F.lit(1))
    return findings.agg(F.when(worst == 1, F.lit("PASS")).otherwise(F.get(F.array(*[F.lit(s) for s in SEVERITIES]), (worst - 1).cast("int"))).alias("verdict"), F.count("*").alias("n"))


def set_aside(descriptions: DataFrame, most: int = 5) -> DataFrame:
    """TX-12, VD-04: per tier how many descriptions lie inside, and the most common organisms of the others."""
    n = descriptions.groupBy("tier", "inside", "organism").agg(F.count("*").alias("n"))
    order = Window.partitionBy("tier").orderBy(F.desc("n"), "organism")
    top = n.where("NOT inside").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    named = top.groupBy("tier").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "organism"))), lambda x: x["organism"]), ", ").alias("others"))
    counts = n.groupBy("tier").agg(F.coalesce(F.sum(F.when(F.col("inside"), F.col("n"))), F.lit(0)).alias("inside"), F.coalesce(F.sum(F.when(~F.col("inside"), F.col("n"))), F.lit(0)).alias("outside"))
    return counts.join(named, "tier", "left")


def evidence_use(sites: DataFrame, evidence: DataFrame) -> DataFrame:
    """AG-27, AG-28: how many sites each laboratory result speaks about, unused ones with 0."""
    n = sites.groupBy("oligo", "site").agg(F.count("*").alias("n"))
    return evidence.join(n, ["oligo", "site"], "left").select("oligo", "site", "observed", F.coalesce("n", F.lit(0)).alias("n"))


def merged_patterns(variants: DataFrame) -> DataFrame:
    """AG-25, AG-21: variants with the same mismatching positions as one, under the most common of them."""
    return variants.groupBy("oligo", "pattern").agg(F.sum("n").alias("n"), F.count("*").alias("variants"), F.min_by("site", F.struct((-F.col("n")).alias("m"), "site")).alias("site"))


def borderline(copies: DataFrame) -> DataFrame:
    """OP-06: candidates near the limits of the copy rule."""
    low = (F.col("anchored") < 32) & (F.col("identity") >= 0.60)
    return copies.where(low | F.col("anchored").between(24, 31)).select("accession", "anchored", "identity")


def spread_sample(rows: DataFrame, n: int, order: str) -> DataFrame:
    """OP-07: ``n`` rows evenly spread over an order, always the same; all where there are fewer.

    Places are counted by ranges of the order, so that no task sees all rows; the
    ranges are written down first, as two readings would draw them differently.
    """
    parts = fixed(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(order).withColumn("_i", F.monotonically_increasing_id() % F.lit(1 << 33)))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))  # a row a partition
    placed = parts.join(F.broadcast(starts), "_part").withColumn("_p", F.col("_start") + F.col("_i"))
    hit = F.floor(F.col("_p") * n / F.col("_all")) != F.floor((F.col("_p") - 1) * n / F.col("_all"))
    return placed.where((F.col("_all") <= n) | (F.col("_p") == 0) | hit).drop("_part", "_i", "_start", "_all", "_p")
