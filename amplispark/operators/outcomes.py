"""Why genomes are missed, what a run covered, and labels (AS-13, FN-14, FN-28, FN-32, TW-06, SP-06, TX-14, TX-15, SRC-21, AG-29, PL-06, PL-07, LC-19, LC-21, JN-07, VD-10, VD-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amplispark.functions import seq
from amplispark.operators import alignment, taxonomy
from amplispark.operators.assess import VERDICTS
from amplispark.sources.assay import organism_names

#: AS-13: kinds of reasons, the most telling first.
ESCAPES = ("gap", "mismatch", "pair", "run_length")
AMPLICON_ROLES = ("forward", "probe", "reverse")
#: TX-14: ids that are asked for at once.
ASKED_AT_ONCE = 200


def escape_kinds(sites: DataFrame) -> DataFrame:
    """AS-13: (accession, kind) of the genomes whose best copy fails.

    Sites are (accession, role, state, alone_ok, mismatches, gaps, by_run,
    rescued). A site that would do alone fails with its partner; one read by run
    length without a mismatch fails by that; then a gap, then mismatches. A
    genome that bulges would rescue fails by run length only.
    """
    kind = F.when(F.col("alone_ok"), "pair").when(F.col("by_run") & (F.col("mismatches") == 0), "run_length").when(F.col("gaps") > 0, "gap").otherwise("mismatch")
    rank = F.array_position(F.array(*map(F.lit, ESCAPES)), kind)
    per = sites.where("state = 'fail'").groupBy("accession").agg(F.min(rank).alias("r"), F.bool_or("rescued").alias("rescued"))
    return per.select("accession", F.when(F.col("rescued"), "run_length").otherwise(F.get(F.array(*map(F.lit, ESCAPES)), (F.col("r") - 1).cast("int"))).alias("kind"))


def described_changes(q: Column, s: Column) -> Column:
    """FN-14: the changes of an alignment from its 5' end on, "none" without any.

    "-3 C-A" is a mismatch by its place from the 3' end, oligo base and template
    base; "-9 Y=T" a match through a code, "-9 Y/A" a code that does not match,
    "-2 unaligned" an unseen base; runs of gaps are told once.
    """
    n = F.length(q)
    base = lambda x, i: F.substring(x, i, F.lit(1))
    rest = lambda i: F.length(F.regexp_replace(F.substring(q, i, n), "-", ""))  # noqa: E731  # oligo bases from here on
    marks = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(base(q, i) == "-", "I").when(base(s, i) == "-", "D").otherwise(".")), "")

    def opens(gaps: Column, i: Column) -> Column:
        return (base(gaps, i) != ".") & ((i == 1) | (base(gaps, i - 1) != base(gaps, i)))

    def named(gaps: Column, i: Column) -> Column:
        a, b, gap = base(q, i), base(s, i), base(gaps, i)
        run = F.length(F.regexp_extract(F.substring(gaps, i, n), "^(I+|D+)", 1))
        at = rest(i).cast("string")
        inserted = F.concat(F.when(run == 1, "insertion").otherwise(F.concat(run.cast("string"), F.lit("-base insertion"))), F.lit(" between -"), (rest(i) + 1).cast("string"), F.lit(" and -"), at)
        deleted = F.when(run == 1, F.concat(F.lit("-"), at, F.lit(" deleted"))).otherwise(
            F.concat(F.lit("-"), at, F.lit(" to -"), (rest(i) - run + 1).cast("string"), F.lit(" deleted ("), run.cast("string"), F.lit(" bases)"))
        )
        plain = a.rlike("^[ACGT]$") & b.rlike("^[ACGT]$")
        what = F.when(b == ".", F.lit(" unaligned")).when(plain, F.concat(F.lit(" "), a, F.lit("-"), seq.complement(b)))
        what = F.coalesce(what, F.concat(F.lit(" "), a, F.when(seq.compatible(a, b), "=").otherwise("/"), b))
        return F.when(gap == "I", inserted).when(gap == "D", deleted).otherwise(F.concat(F.lit("-"), at, what))

    def told(gaps: Column) -> Column:
        changed = F.filter(F.sequence(F.lit(1), n), lambda i: opens(gaps, i) | ((base(gaps, i) == ".") & (base(q, i) != base(s, i))))
        return F.array_join(F.transform(changed, lambda i: named(gaps, i)), ", ")

    # Inside an array of one, the marks are made once an alignment, and only places with a change are put in words.
    line = F.get(F.transform(F.array(marks), told), 0)
    return F.get(F.transform(F.array(line), lambda x: F.when(x == "", "none").otherwise(x)), 0)


def year_coverage(listing: DataFrame, stored: DataFrame, unavailable: DataFrame) -> DataFrame:
    """TW-06: per year of (accession, year) how many are listed, assessed, and, of those that are not, unavailable."""
    j = listing.join(stored.select("accession").distinct().withColumn("done", F.lit(1)), "accession", "left").join(unavailable.select("accession").distinct().withColumn("lost", F.lit(1)), "accession", "left")
    return j.groupBy("year").agg(F.count("*").alias("listed"), F.count("done").alias("assessed"), F.count(F.when(F.col("done").isNull(), F.col("lost"))).alias("unavailable"))


def worth_realigning(lower_bound: Column, u3: Column, most: Column, clean3: Column, graded: bool = False) -> Column:
    """SP-06: whether a partial hit can be above minor: few enough mismatches at best, and, where sites are not graded, an end that can be clean.

    The first base beyond a search's alignment is a mismatch, so ``u3``
    unaligned bases at the 3' end leave ``u3 - 1`` clean ones at most.
    """
    near = lower_bound <= most
    return near if graded else near & ~((u3 > 0) & (u3 - 1 < clean3))


def species_label(species: Column, scientific: Column, organism: Column) -> Column:
    """TX-15"""
    given = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(given(species), given(scientific), given(organism), F.lit("unknown organism"))


def missing_ids(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """TX-14: (batch, taxids) of the taxids that no cache entry has, in batches of ``ASKED_AT_ONCE``, dealt by hash of the batch count."""
    lacking = wanted.select("taxid").where("taxid IS NOT NULL").distinct().join(cached.select("taxid"), "taxid", "left_anti")
    counted = lacking.crossJoin(lacking.agg(F.count("*").alias("_n")))  # one row
    parts = F.greatest(F.ceil(F.col("_n") / F.lit(ASKED_AT_ONCE // 2)), F.lit(1))
    rows = counted.groupBy(F.pmod(F.pmod(F.xxhash64("taxid"), F.lit(1 << 20)), parts).alias("part")).agg(F.sort_array(F.collect_list("taxid")).alias("ids"))
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / ASKED_AT_ONCE)), lambda i: F.slice("ids", (i * ASKED_AT_ONCE + 1).cast("int"), F.lit(ASKED_AT_ONCE))))
    return rows.select("part", cut.alias("n", "taxids")).select(F.concat_ws("-", "part", "n").alias("batch"), "taxids")


def amplicon_order(role: Column) -> Column:
    """AG-29: a sort key: forward, probe, reverse."""
    return F.array_position(F.array(*map(F.lit, AMPLICON_ROLES)), role)


def role_of(labels: DataFrame, oligos: DataFrame) -> DataFrame:
    """FN-28: (label, role) of query labels by (oligo, role); a label without an oligo is an error."""
    named = labels.withColumn("_name", seq.oligo_of(F.col("label")))
    j = named.join(oligos.select(F.col("oligo").alias("_own"), F.col("role").alias("_r1")), F.col("label") == F.col("_own"), "left")
    j = j.join(oligos.select(F.col("oligo").alias("_name"), F.col("role").alias("_r2")), "_name", "left")
    role = F.coalesce("_r1", "_r2")
    return j.select("label", F.when(role.isNull(), F.raise_error(F.concat(F.lit("no oligo named "), F.col("label"))).cast("string")).otherwise(role).alias("role"))


def year_term(term: Column, year: Column) -> Column:
    """PL-07: a search term limited to the records of a year."""
    y = year.cast("string")
    return F.concat(term, F.lit(" AND "), y, F.lit("/01/01:"), y, F.lit("/12/31[PDAT]"))


def retry_batches(failed: DataFrame) -> DataFrame:
    """LC-19: (batch, members) of batches that failed, each in halves; a single member that failed is left out, as it is what failed."""
    half = F.ceil(F.size("members") / 2).cast("int")
    halves = F.array(F.slice("members", F.lit(1), half), F.slice("members", half + 1, F.size("members")))
    return failed.where(F.size("members") > 1).select("batch", F.posexplode(halves).alias("h", "members")).select(F.concat_ws(".", "batch", "h").alias("batch"), "members")


def scanned_records(asked: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LC-21: (accession, seq) of the asked records that are there, and (accession, reason) of those that are not, to be counted as failures."""
    j = asked.select("accession").distinct().join(contigs.select("accession", "seq"), "accession", "left")
    return j.where("seq IS NOT NULL"), j.where("seq IS NULL").select("accession", F.lit("no sequence returned").alias("reason"))


def probe_in_products(products: DataFrame, contigs: DataFrame, probes: DataFrame, most: int = 5) -> DataFrame:
    """JN-07: the best site of each (oligo, oligo_seq) probe, on either strand, inside the products whose probe the search has not found.

    Products are (tier, accession, left_id, right_id, start, end, probe_id),
    from 1 and inclusive; sites with more than ``most`` changes are left out.
    """
    bare = products.where("probe_id IS NULL").select("tier", "accession", "left_id", "right_id", "start", "end")
    cut = F.substring(F.col("seq"), F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    inside = bare.join(contigs.select("accession", "seq"), "accession").select("tier", "accession", "left_id", "right_id", cut.alias("w"))
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col("w").alias("window")), F.struct(F.lit("-").alias("strand"), seq.reverse_complement(F.col("w")).alias("window")))
    each = inside.select("tier", "accession", "left_id", "right_id", F.explode(strands).alias("s")).select("tier", "accession", "left_id", "right_id", "s.*")
    found = alignment.semi_global(each.crossJoin(probes.select("oligo", "oligo_seq")).where("length(window) >= length(oligo_seq)"))  # an assay's own probes, a handful
    m = alignment.measure(F.col("q_aln"), F.col("s_aln"))
    near = found.withColumn("m", m).withColumn("changes", F.col("m.mismatches") + F.col("m.gaps")).where(F.col("changes") <= most)
    best = F.min_by(F.struct("strand", "s_start", "q_aln", "s_aln", "changes"), F.struct("changes", (F.col("strand") != "+").alias("minus"), "s_start"))
    return near.groupBy("tier", "accession", "left_id", "right_id", "oligo").agg(best.alias("b")).select("tier", "accession", "left_id", "right_id", "oligo", "b.*")


def overall_verdict(sections: DataFrame, gaps: DataFrame) -> DataFrame:
    """VD-10: (run, verdict, code, gaps): the worst section of (run, section, status), incomplete over a pass or a warning where (run, gap) names anything that was required and not done."""
    names = [v for v, _ in VERDICTS]
    rank = F.greatest(F.array_position(F.array(*map(F.lit, names)), F.col("status")), F.lit(1))  # INFO counts as a pass
    worst = sections.groupBy("run").agg(F.max(rank).alias("r"))
    j = worst.join(gaps.groupBy("run").agg(F.array_join(F.sort_array(F.collect_set("gap")), "; ").alias("gaps")), "run", "left")
    r = F.when(F.col("gaps").isNotNull(), F.greatest("r", F.lit(names.index("INCOMPLETE") + 1))).otherwise(F.col("r"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (r - 1).cast("int"))
    return j.select("run", pick(names).alias("verdict"), pick([c for _, c in VERDICTS]).alias("code"), F.coalesce("gaps", F.lit("")).alias("gaps"))


def organism_taxa(lines: list[str], names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """SRC-21: (name, status, taxid) of an organism list's lines, in TX-05's terms; what does not resolve to one taxid is never guessed."""
    asked = names.sparkSession.createDataFrame([(n,) for n in organism_names(lines)], "name string")
    return taxonomy.resolve_names(asked, names, synonyms)


def search_key(assay: Column, inputs: Column) -> Column:
    """PL-06: where the state of an assay's searches is kept: by its slug and the head of the hash of all inputs."""
    return F.concat(seq.slug(assay), F.lit("/search-"), F.substring(F.sha2(inputs, 256), 1, 8))


def needs_submission(cached: Column, state: Column, alive: Column, waited: Column, longest: float) -> Column:
    """PL-06: whether a search would be sent: nothing cached, and not under way, or under way for ``longest`` minutes and more."""
    under_way = state.isin("submitted", "ready") & alive
    return ~cached & (~under_way | ((state == "submitted") & (waited >= longest)))


def site_description(role: Column, accession: Column, organism: Column, mismatches: Column, gaps: Column, clean3: Column, unaligned: Column) -> Column:
    """FN-32: a site in one line."""
    head = F.format_string("%s on %s (%s): %d mismatch(es), %d gap(s), %d clean at the 3' end", role, accession, F.coalesce(organism, F.lit("unknown organism")), mismatches, gaps, clean3)
    return F.when(unaligned > 0, F.concat(head, F.format_string(", %d unaligned (worst case)", unaligned))).otherwise(head)


def rationale_lines(figures: DataFrame) -> DataFrame:
    """VD-15: (run, topic, line) of what a status leaves out, for information.

    Figures are (run, percent, alternative, patterns, pattern_percent, genomes,
    largest, earlier, undated, not_read, placed): the share detected with and
    without run-length differences, the distinct patterns, and the genomes by
    collection date. A line is left out where it has nothing to tell.
    """
    n = F.col("placed") + F.col("earlier") + F.col("undated") + F.col("not_read")
    share = lambda a, b: F.format_string("%.1f%%", F.round(F.lit(100.0) * a / b, 1))
    other = F.when(F.abs(F.col("alternative") - F.col("percent")) >= 0.05, F.format_string("%.1f%% detected under the other run-length setting, %.1f%% under this one", F.round("alternative", 1), F.round("percent", 1)))
    distinct = F.when(F.col("patterns") > 0, F.concat(F.format_string("%d patterns in %d genomes, %.1f%% of the patterns detected; the commonest is in ", "patterns", "genomes", F.round("pattern_percent", 1)), share(F.col("largest"), F.col("genomes"))))
    dates = F.when((F.col("earlier") > 0) | (F.col("undated") > 0), F.concat(F.format_string("of %d genomes %d were collected before the first year and %d have no usable date", n, "earlier", "undated"), F.when(F.col("not_read") > 0, F.format_string("; of %d it was not read yet", "not_read")).otherwise("")))
    lines = F.array(*[F.struct(F.lit(t).alias("topic"), x.alias("line")) for t, x in (("run_length", other), ("patterns", distinct), ("collection", dates))])
    return figures.select("run", F.explode(lines).alias("l")).select("run", "l.topic", "l.line").where("line IS NOT NULL")
