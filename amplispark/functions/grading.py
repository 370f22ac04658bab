"""Graded classes of binding sites (GR-01 .. GR-15) as Column expressions.

An alignment is a pair of equally long strings, the oligo's and the site's, in
the oligo's orientation; ``-`` is a gap and ``.`` a site base that was not seen.
Positions count from the 3' end of the oligo, from 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amplispark.functions import seq

# The classes in the order of concern, and the groups of primer-template mismatches.
CLASSES = ("perfect", "tolerated", "at_risk", "likely_failure", "indeterminate")
PERFECT, TOLERATED, AT_RISK, FAILURE, INDETERMINATE = range(5)
GROUP_1 = ("A-A", "A-G", "G-A", "G-G", "C-C")
GROUP_2 = ("T-T", "T-C", "C-T")
GROUP_3 = ("C-A", "A-C", "G-T", "T-G")
REGION = 16
LAST = 5


def class_of(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CLASSES]), rank.cast("int"))


def rank_of(name: Column) -> Column:
    """GR-13: the order perfect < tolerated < at_risk < likely_failure < indeterminate."""
    return (F.array_position(F.array(*[F.lit(c) for c in CLASSES]), name) - 1).cast("int")


def columns_of(q: Column, s: Column) -> Column:
    """GR-01: array<struct<pos, a, b, gap, ambiguous, mismatch, kind>> of the alignment's columns, in order.

    A gap of the site at either end is a mismatch of unknown type, as is an
    unseen base; only gaps within count as gaps.
    """
    masks = F.create_map(*[F.lit(x) for kv in seq.MASKS.items() for x in kv])
    n, lead, trail = F.length(q), F.length(F.regexp_extract(s, "^(-*)", 1)), F.length(F.regexp_extract(s, "(-*)$", 1))

    def column(i: Column) -> Column:
        a, b = F.substring(q, i, F.lit(1)), F.substring(s, i, F.lit(1))
        pos = F.length(F.regexp_replace(F.substring(q, i, n), "-", ""))
        end = (b == "-") & ((i <= lead) | (i > n - trail))
        gap = ~end & ((a == "-") | (b == "-"))
        share = F.coalesce(masks[a].bitwiseAND(masks[b]), F.lit(0)) != 0
        concrete = a.rlike("^[ACGT]$") & b.rlike("^[ACGT]$")
        ambiguous = share & ~b.rlike("^[ACGT]$")
        mismatch = ~gap & (end | (b == ".") | ~share)
        return F.struct(
            pos.alias("pos"), a.alias("a"), b.alias("b"), gap.alias("gap"), (~gap & ~end & ambiguous).alias("ambiguous"), mismatch.alias("mismatch"),
            F.when(concrete, F.concat(a, F.lit("-"), seq.complement(b))).alias("kind"),
        )

    return F.transform(F.sequence(F.lit(1), n), column)


def single(pos: Column, kind: Column) -> Column:
    """GR-02, GR-03: the rank of one primer mismatch alone; an unknown type counts as group 1."""
    third, second = F.coalesce(kind.isin(*GROUP_3), F.lit(False)), F.coalesce(kind.isin(*GROUP_2), F.lit(False))
    at_end = F.when(third, TOLERATED).when(second, AT_RISK).otherwise(FAILURE)
    return F.when(pos == 1, at_end).when((pos == 2) & ~second & ~third, AT_RISK).otherwise(TOLERATED)


def primer_rank(mismatches: Column, adjacency: bool = True) -> Column:
    """GR-02 .. GR-05: struct<rank, rule> of the mismatches (array<struct<pos, kind>>) of a primer."""
    inner, outer = F.filter(mismatches, lambda x: x["pos"] <= REGION), F.filter(mismatches, lambda x: x["pos"] > REGION)
    m, o = F.size(inner), F.size(outer)
    last = F.filter(inner, lambda x: x["pos"] <= LAST)
    at_end = F.exists(inner, lambda x: x["pos"] == 1)
    adjacent = F.array_max(F.transform(inner, lambda x: x["pos"])) - F.array_min(F.transform(inner, lambda x: x["pos"])) == 3
    singles = F.coalesce(F.array_max(F.transform(last, lambda x: single(x["pos"], x["kind"]))), F.lit(TOLERATED))
    four = (m == 4) & adjacent & (F.size(last) == 0) & (o == 0)
    several = F.when(at_end & (F.size(last) >= 2), FAILURE).when(m == 2, F.greatest(F.lit(AT_RISK), singles)).when(four, AT_RISK).otherwise(FAILURE)
    first = F.get(inner, F.lit(0))
    of_inner = F.when(m == 0, PERFECT).when(m == 1, single(first["pos"], first["kind"])).otherwise(several)
    inner_rule = F.when(m == 0, F.lit("")).when((m == 1) & (first["pos"] <= LAST), F.lit("R1")).when(m == 1, F.lit("R2")).otherwise(F.lit("R3"))
    rank = F.when(o == 0, of_inner).when(m == 0, F.when(o <= 4, TOLERATED).otherwise(AT_RISK)).otherwise(F.greatest(of_inner, F.lit(AT_RISK)))
    rule = F.when(o == 0, inner_rule).when(m == 0, F.lit("R3b")).otherwise(F.concat(inner_rule, F.lit("+R3b")))
    return F.struct(rank.cast("int").alias("rank"), rule.alias("rule"))


def probe_rank(mismatches: Column, mgb: Column) -> Column:
    """GR-10: struct<rank, rule> of the mismatches of a probe."""
    n, pos = F.size(mismatches), F.get(mismatches, F.lit(0))["pos"]
    with_mgb = F.when(n == 0, PERFECT).when((n == 1) & (pos > 7), INDETERMINATE).otherwise(FAILURE)
    plain = F.when(n == 0, PERFECT).when((n == 1) & (pos > LAST), TOLERATED).when(n <= 2, AT_RISK).otherwise(FAILURE)
    return F.struct(F.when(mgb, with_mgb).otherwise(plain).cast("int").alias("rank"), F.when(n == 0, F.lit("")).otherwise(F.lit("R9")).alias("rule"))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def grade(q: Column, s: Column, role: Column, mgb: Column) -> Column:
    """GR-01 .. GR-10: struct<class, rule, mismatches> of a site."""
    probe = role == "probe"

    def judged(cols: Column) -> Column:
        kept = lambda f: F.transform(F.filter(cols, f), lambda c: F.struct(c["pos"].alias("pos"), F.when(c["ambiguous"], F.lit(None).cast("string")).otherwise(c["kind"]).alias("kind")))
        sure = kept(lambda c: c["mismatch"])
        both = kept(lambda c: c["mismatch"] | (c["ambiguous"] & (probe | (c["pos"] <= REGION))))
        of = lambda m: F.when(probe, probe_rank(m, mgb)).otherwise(primer_rank(m))
        return _let(F.struct(of(sure).alias("sure"), of(both).alias("both"), F.size(sure).alias("n")), lambda g: ruled(cols, g))

    def ruled(cols: Column, g: Column) -> Column:
        gaps = F.filter(cols, lambda c: c["gap"])
        deleted, inserted = F.size(F.filter(gaps, lambda c: c["b"] == "-")), F.size(F.filter(gaps, lambda c: c["a"] == "-"))
        low, high = g["sure"]["rank"], g["both"]["rank"]
        unsure = low != high
        plain = F.when(unsure, F.lit(INDETERMINATE)).otherwise(low)
        # a gap: the class stands if it is at_risk or worse, else nothing can be said
        stands = F.when(plain.isin(AT_RISK, FAILURE), plain).otherwise(F.lit(INDETERMINATE))
        # a bulge of one in a run of three equal bases or more, which ends before the last three
        gap = F.get(gaps, F.lit(0))
        base = F.coalesce(F.when(gap["b"] == "-", gap["a"]).otherwise(gap["b"]), F.lit("-"))
        own = F.regexp_replace(q, "-", "")
        place = F.length(own) - F.coalesce(gap["pos"], F.lit(0)) + 1
        before, after = F.substring(own, F.lit(1), place - 1), F.substring(own, place, F.length(own))
        ahead = F.length(after) - F.length(F.ltrim(after, base))
        run = F.length(before) - F.length(F.rtrim(before, base)) + ahead
        bulge = ~probe & (F.size(gaps) == 1) & (run >= 3)
        bulge_rank = F.greatest(plain, F.when(F.length(after) - ahead >= 3, F.lit(AT_RISK)).otherwise(F.lit(FAILURE)))
        # a deletion in the template under a probe
        deletion = probe & (deleted > 0) & (inserted == 0)
        deletion_rank = F.when((plain == FAILURE) | (deleted >= 6) | (g["n"] >= 3), F.lit(FAILURE)).otherwise(F.lit(AT_RISK))
        gapped = F.size(gaps) > 0
        rank = F.when(bulge, bulge_rank).when(deletion, deletion_rank).when(gapped, stands).otherwise(plain)
        rule = F.when(bulge, F.lit("R5b")).when(deletion, F.lit("R5c")).when(gapped, F.lit("R5")).when(unsure, F.lit("R6")).otherwise(g["sure"]["rule"])
        return F.struct(class_of(rank).alias("class"), rule.alias("rule"), g["n"].alias("mismatches"))

    return _let(columns_of(q, s), judged)


def pair_fails(forward: Column, reverse: Column) -> Column:
    """GR-11 (R8): both primers together have too many mismatches in their regions."""
    hi, lo = F.greatest(forward, reverse), F.least(forward, reverse)
    return ((hi >= 3) & (lo >= 2)) | ((hi >= 4) & (lo >= 1))


def with_evidence(graded: Column, observed: Column) -> Column:
    """GR-12: a laboratory result overrules the grade: detected is tolerated, not detected a failure."""
    return F.when(observed == "detected", F.lit("tolerated")).when(observed == "not_detected", F.lit("likely_failure")).otherwise(graded)


def site_state(cls: Column, gap: Column) -> Column:
    """GR-15: ok, fail or undetermined; a site with an unexplained gap fails."""
    return F.when(gap, F.lit("fail")).when(cls.isin("perfect", "tolerated", "at_risk"), F.lit("ok")).when(cls == "indeterminate", F.lit("undetermined")).otherwise(F.lit("fail"))


# Outcomes of a genome, the most concerning first.
OUTCOMES = ("likely_failure", "at_risk", "undetermined", "detectable")


def combined(classes: list[Column], pair_failed: Column) -> Column:
    """GR-14: the most concerning of the sites' outcomes and the pair rule."""
    each = [F.when(c == "likely_failure", 0).when(c == "at_risk", 1).when(c == "indeterminate", 2).otherwise(3) for c in classes]
    worst = F.least(*each, F.when(pair_failed, F.lit(0)).otherwise(F.lit(3)))
    return F.get(F.array(*[F.lit(x) for x in OUTCOMES]), worst)
