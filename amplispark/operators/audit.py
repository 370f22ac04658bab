"""The engine checked against itself (OP-08): what a search's partial hits rule out, against the whole alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amplispark.operators import alignment, specificity
from amplispark.operators.outcomes import worth_realigning

#: What may be wrong: more defects promised than there are, an end cleaner than the first unaligned base allows, a site ruled out that counts.
CHECKS = ("lower_bound", "first_unaligned_base", "ruled_out_but_relevant")


def rule_violations(candidates: DataFrame, graded: bool = False) -> DataFrame:
    """OP-08: (…, check, defects, clean3, level) of candidates that contradict a rule; no row where all hold.

    Candidates are (id, role, oligo_seq, window, u3, lower_bound): partial hits
    with the stretch around them, on the oligo's strand, which are relevant
    (SP-01): nothing is ruled out by the rules of others. A candidate without a
    window is not checked.
    """
    found = alignment.semi_global(candidates).withColumn("m", alignment.measure(F.col("q_aln"), F.col("s_aln")))
    found = found.where("q_aln IS NOT NULL").select(*candidates.columns, "m.mismatches", "m.gaps", "m.clean3")
    site = found.withColumns({"level": specificity.level(), "defects": F.col("mismatches") + F.col("gaps")})
    limits = lambda k: F.when(F.col("role") == "probe", specificity.LEVELS["probe"]["warning"][k]).otherwise(specificity.LEVELS["primer"]["warning"][k])
    fetched = worth_realigning(F.col("lower_bound"), F.col("u3"), limits(0) + limits(1), limits(2), graded)
    problems = (F.col("defects") < F.col("lower_bound"), (F.col("u3") > 0) & (F.col("clean3") > F.col("u3") - 1), ~fetched & (F.col("level") != "minor"))
    named = F.filter(F.array(*[F.when(p, F.lit(c)) for p, c in zip(problems, CHECKS, strict=True)]), lambda x: x.isNotNull())
    return site.select(*candidates.columns, F.explode(named).alias("check"), "defects", "clean3", "level")


def partial_hits(sites: DataFrame, word: int = 7) -> DataFrame:
    """Of each ungapped site (oligo_seq, site) the stretch that a search would report, +1 for a match and -3 for a mismatch: u5, u3, its identical bases and the lower bound of defects (SP-03).

    A search starts from ``word`` bases in a row that agree and reports nothing without them.
    """
    n = F.length("oligo_seq")
    scores = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.substring("oligo_seq", i, F.lit(1)) == F.substring("site", i, F.lit(1)), 1).otherwise(-3))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(0).alias("from"), F.lit(0).alias("best"), F.lit(0).alias("a"), F.lit(0).alias("b"))

    def step(acc, x):
        run = F.when(acc["run"] > 0, acc["run"] + x).otherwise(x)
        first = F.when(acc["run"] > 0, acc["from"]).otherwise(acc["i"])
        better = run > acc["best"]
        return F.struct(
            (acc["i"] + 1).alias("i"), run.alias("run"), first.alias("from"), F.when(better, run).otherwise(acc["best"]).alias("best"), F.when(better, first).otherwise(acc["a"]).alias("a"), F.when(better, acc["i"] + 1).otherwise(acc["b"]).alias("b"),
        )

    # As a generated row it is folded once a site; as a column each test of it would fold it again.
    hit = sites.select("*", F.explode(F.array(F.aggregate(scores, start, step))).alias("_h")).where("_h.best > 0")
    told = F.array_join(F.transform(F.slice(scores, F.col("_h.a") + 1, F.col("_h.b") - F.col("_h.a")), lambda x: F.when(x > 0, "=").otherwise("x")), "")
    hit = hit.withColumn("_s", told).where(F.col("_s").contains("=" * word))
    identity = F.length(F.replace("_s", F.lit("x"), F.lit("")))
    inside = F.length("_s") - identity
    quarter = lambda x: F.ceil(x / 4).cast("int")
    u5, u3 = F.col("_h.a"), n - F.col("_h.b")
    return hit.withColumns({"u5": u5, "u3": u3, "identity": identity, "lower_bound": inside + quarter(u5) + quarter(u3)}).drop("_h", "_s")
