"""Coverage over genomes, by oligo, role and probe channel, and the view of fragment combinations (AG-01, AG-06, AG-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXAMPLES = 20


def _examples(rows: DataFrame, keys: list[str], name: str, most: int = EXAMPLES) -> DataFrame:
    """(keys, examples): of each group the first ``most`` names, joined by commas; cut before they are gathered."""
    order = Window.partitionBy(*keys).orderBy(name)
    few = rows.select(*keys, name).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("examples"))


def copy_totals(calls: DataFrame, bulges: bool = False) -> DataFrame:
    """AG-01: one row of counts over genome calls.

    Calls are (accession, copies, best_is_first, detectable, detectable_other,
    from_parts, outcome): copies that are detectable under the homopolymer rule
    in use and under the other one, and an outcome of detected, not_detected,
    undetermined, unassembled or from_parts.
    """
    c = F.count_if
    configured, other = c(F.col("detectable") > 0), c(F.col("detectable_other") > 0)
    of = lambda x: c(F.col("outcome") == x)
    return calls.agg(
        F.count("*").alias("genomes"), c(F.col("copies") > 1).alias("multi_copy"), F.coalesce(F.max("copies"), F.lit(0)).cast("long").alias("max_copies"), c(~F.col("best_is_first")).alias("best_copy_not_first"),
        configured.alias("with_detectable_copy"), (other if bulges else configured).alias("with_detectable_copy_strict"), (configured if bulges else other).alias("with_detectable_copy_bulges"),
        c("from_parts").alias("from_parts"), F.coalesce(F.bool_or(F.col("from_parts") & (F.col("detectable") > 0)), F.lit(False)).alias("from_parts_counted"),
        of("not_detected").alias("escapes"), of("unassembled").alias("unassembled"), of("undetermined").alias("undetermined"),
    )


def outcome_examples(calls: DataFrame) -> DataFrame:
    """AG-01: (outcome, genomes, examples) of what is not detected, by outcome, with the first ``EXAMPLES`` accessions."""
    rows = calls.where("outcome IN ('not_detected', 'undetermined', 'unassembled')")
    return rows.groupBy("outcome").agg(F.count("*").alias("genomes")).join(_examples(rows, ["outcome"], "accession"), "outcome")


def _judged(calls: DataFrame) -> DataFrame:
    """Genomes that the figures of oligos and channels are of: those judged from cut copies alone are left out, as of the whole fragment's."""
    return calls.where("outcome <> 'from_parts'").select("accession")


def oligo_coverage(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """AG-01: (role, oligo, reporter, covered, only): genomes in which an oligo is good, and in which it is the only good one of its role.

    Sites are (accession, role, oligo, reporter, good), a row for each oligo of a genome.
    """
    s = sites.join(_judged(calls), "accession", "left_semi")
    names = sites.groupBy("role", "oligo").agg(F.max("reporter").alias("reporter"))
    covered = s.where("good").groupBy("role", "oligo").agg(F.count_distinct("accession").alias("covered"))
    # An oligo alone in its genome and role is the least and the greatest of the good ones.
    alone = s.where("good").groupBy("accession", "role").agg(F.min("oligo").alias("oligo"), F.max("oligo").alias("_last")).where("oligo = _last")
    only = alone.groupBy("role", "oligo").agg(F.count("*").alias("only"))
    out = names.join(covered, ["role", "oligo"], "left").join(only, ["role", "oligo"], "left")
    return out.select("role", "oligo", F.when(F.col("role") == "probe", F.col("reporter")).alias("reporter"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("covered", "only")])


def role_gaps(calls: DataFrame, sites: DataFrame, states: DataFrame) -> DataFrame:
    """AG-01: (role, none, undetermined, examples): genomes without a good oligo of a role, and how many of them are undetermined there.

    States are (accession, role, state).
    """
    roles = sites.select("role").distinct()
    good = sites.where("good").select("accession", "role").distinct()
    open_ = _judged(calls).crossJoin(F.broadcast(roles)).join(good, ["accession", "role"], "left_anti").join(states, ["accession", "role"], "left")  # three roles
    undetermined = F.coalesce(F.col("state") == "undetermined", F.lit(False))
    open_ = open_.select("accession", "role", undetermined.alias("undetermined"))
    counts = open_.groupBy("role").agg(F.count_if(~F.col("undetermined")).alias("none"), F.count_if("undetermined").alias("undetermined"))
    out = roles.join(counts, "role", "left").join(_examples(open_.where("NOT undetermined"), ["role"], "accession"), "role", "left")
    return out.select("role", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("none", "undetermined")], F.coalesce("examples", F.lit("")).alias("examples"))


def channel_coverage(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """AG-01: (reporter, probes, covered, any_channel, all_channels): genomes with a good probe of a channel, of any, and of all of them."""
    probes = sites.where("role = 'probe'").withColumn("reporter", F.coalesce("reporter", F.lit("unspecified")))
    names = probes.groupBy("reporter").agg(F.array_join(F.array_sort(F.collect_set("oligo")), ",").alias("probes"))
    good = probes.where("good").join(_judged(calls), "accession", "left_semi").select("accession", "reporter").distinct()
    covered = good.groupBy("reporter").agg(F.count("*").alias("covered"))
    n = names.agg(F.count("*").alias("_channels"))
    per = good.groupBy("accession").agg(F.count("*").alias("k")).crossJoin(n)  # one row
    totals = per.agg(F.count("*").alias("any_channel"), F.count_if(F.col("k") == F.col("_channels")).alias("all_channels"))
    return names.join(covered, "reporter", "left").withColumn("covered", F.coalesce("covered", F.lit(0))).crossJoin(totals)  # one row


def located_totals(genomes: DataFrame) -> DataFrame:
    """AG-06: one row of what became of the genomes of a target.

    Genomes are (accession, state, masked, beside, located, by_fallback,
    from_parts, molecule): state found, not_found or contig_break; masked where N
    hides a site; beside tells of related regions; located says whether the
    search read the record at all.
    """
    c = F.count_if
    found = F.col("state") == "found"
    return genomes.agg(
        F.count("*").alias("genomes"), c(found).alias("found"), c((F.col("state") == "not_found") & F.col("located")).alias("not_found"), c(~F.col("located")).alias("not_located"),
        c(F.col("state") == "contig_break").alias("cut"), c(found & F.col("masked")).alias("masked"), c(found & ~F.col("masked")).alias("assessed"),
        c(F.col("beside") == "related").alias("related"), c(F.col("beside") == "beside").alias("beside"), c(F.col("beside") == "flanked").alias("flanked"),
        c(found & F.col("by_fallback")).alias("by_fallback"), c("from_parts").alias("from_parts"), c(found & (F.col("molecule") == "plasmid")).alias("on_plasmid"),
    )


#: Outcomes from the worst on; the last is no matter of attention.
OUTCOMES = ("not_detected", "undetermined", "unassembled", "at_risk", "not_classified", "detectable")


def fragment_view(combos: DataFrame, per_outcome: int = 5, cap: int = 30, top: int = 10, kinds: int = 3) -> DataFrame:
    """AG-20: (part, outcome, combo, combos, records, kinds) of (combo, outcome, n, kind) combinations.

    Part ``attention`` lists up to ``cap`` combinations that are not detectable:
    the ``per_outcome`` most frequent of each outcome, then the most frequent of
    the rest. Part ``folded`` has a row for each outcome of what is left, part
    ``detectable`` the ``top`` most frequent, part ``rest`` one row of the others.
    Records of all parts add up to those of the input. Only the head of each
    outcome is ever ordered across outcomes.
    """
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    by_n = Window.partitionBy("outcome").orderBy(F.desc("n"), "combo")
    heads = combos.withColumn("_r", F.row_number().over(by_n)).where(F.col("_r") <= F.when(F.col("outcome") == "detectable", top).otherwise(per_outcome + cap))
    attention = heads.where("outcome <> 'detectable'")
    quota = F.row_number().over(Window.orderBy(F.col("_r") > per_outcome, F.when(F.col("_r") > per_outcome, 0).otherwise(rank), F.when(F.col("_r") > per_outcome, -F.col("n")).otherwise(F.col("_r")), "combo"))
    chosen = attention.withColumn("_q", quota).where(F.col("_q") <= cap)  # a few heads of each outcome
    shown = chosen.select("combo", "outcome", "n").unionByName(heads.where("outcome = 'detectable'").select("combo", "outcome", "n"))
    rest = combos.join(F.broadcast(shown.select("combo")), "combo", "left_anti")  # cap + top rows
    per_kind = rest.groupBy("outcome", "kind").agg(F.sum("n").alias("k"), F.count("*").alias("c"))
    told = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("minus"), "kind"))), 1, kinds), lambda x: F.concat(x["kind"], F.lit("="), (-x["minus"]).cast("string")))
    folded = per_kind.groupBy("outcome").agg(F.sum("c").alias("combos"), F.sum("k").alias("records"), F.array_join(told, ",").alias("kinds"))
    one = shown.select(F.when(F.col("outcome") == "detectable", "detectable").otherwise("attention").alias("part"), "outcome", "combo", F.lit(1).cast("long").alias("combos"), F.col("n").cast("long").alias("records"), F.lit(None).cast("string").alias("kinds"))
    left = folded.select(F.when(F.col("outcome") == "detectable", "rest").otherwise("folded").alias("part"), "outcome", F.lit(None).cast(combos.schema["combo"].dataType).alias("combo"), "combos", "records", "kinds")
    return one.unionByName(left)
