"""The partner primer next to an off-target primer site (JN-06): an as-of join with sequential acceptance.

A search reports a site only where its score passes a floor. A product needs two
sites, so beside each reported one the stretch that a product could span is
searched for the other: the best alignment of each partner oligo in it, if it
acts and faces its anchor. Anchors come in the order of their levels and ids,
and a site that overlaps a known one, or one that an earlier anchor has added,
is not new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amplispark.functions import seq
from amplispark.operators import alignment
from amplispark.operators.specificity import MAX_PRODUCT, level

#: What tells known sites apart: sites of one oligo on one strand of a record, tiers by themselves.
SITE_KEYS = ("tier", "accession", "oligo", "orientation")
_RANK = {"critical": 0, "warning": 1, "minor": 2}


def order_of(level_col: Column, id_col: Column) -> Column:
    """Anchors by level and then by id."""
    rank = F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv])
    return F.struct(rank[level_col].alias("rank"), id_col.alias("id"))


def scanned_anchors(anchors: DataFrame, contigs: DataFrame, reach: int = MAX_PRODUCT, budget: int | None = None) -> DataFrame:
    """The anchors with ``state``, ``turn`` (their order), ``lo`` and ``part``, the stretch beyond their first base that a product of at most ``reach`` bases could span.

    The state is scanned, no_accession (a record without a name), not_scanned
    (beyond the ``budget`` first ones) or failed (no such record, or nothing
    beyond the anchor). Anchors are (tier, accession, site_id, role, orientation,
    s_start, s_end, level), from 1 and inclusive.
    """
    a = anchors.withColumn("turn", order_of(F.col("level"), F.col("site_id")))
    named = F.coalesce(F.col("accession") != "unknown", F.lit(False))
    within = a.where(named) if budget is None else a.where(named).orderBy("turn").limit(budget)
    plus = F.col("orientation") == "+"
    lo = F.when(plus, F.col("s_start") + 1).otherwise(F.greatest(F.col("s_end") - reach + 1, F.lit(1)))
    hi = F.when(plus, F.least(F.col("s_start") + reach - 1, F.length("seq"))).otherwise(F.least(F.col("s_end"), F.length("seq")) - 1)
    part = F.substring(F.col("seq"), lo.cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int"))
    j = within.join(contigs.select("accession", "seq"), "accession", "left")
    j = j.withColumns({"lo": lo, "part": part}).drop("seq")
    told = j.withColumn("state", F.when(F.length("part") > 0, "scanned").otherwise("failed"))
    rest = a.where(~named).withColumn("state", F.lit("no_accession"))
    if budget is not None:
        rest = rest.unionByName(a.where(named).join(within.select("site_id"), "site_id", "left_anti").withColumn("state", F.lit("not_scanned")))
    return told.unionByName(rest, allowMissingColumns=True)


def facing_sites(scanned: DataFrame, oligos: DataFrame, acts: Column | None = None) -> DataFrame:
    """Of each anchor and partner oligo the site of the best variant, if one acts and faces the anchor.

    Oligos are an assay's own (oligo, role, oligo_seq) variants, a handful. A
    base that the record does not tell is no evidence of binding. ``acts`` is a
    test of role, mismatches, gaps and clean3; by default a level above minor.
    """
    a = scanned.where("state = 'scanned'").select(
        "tier", "accession", "turn", F.col("site_id").alias("anchor_id"), F.col("s_start").alias("a_start"), F.col("s_end").alias("a_end"), "lo", "part",
        F.when(F.col("role") == "forward", "reverse").otherwise("forward").alias("role"), F.when(F.col("orientation") == "+", "-").otherwise("+").alias("orientation"),
    )
    minus = F.col("orientation") == "-"
    windows = a.withColumn("window", F.when(minus, seq.reverse_complement(F.col("part"))).otherwise(F.col("part"))).drop("part")
    found = alignment.semi_global(windows.join(F.broadcast(oligos), "role").where("length(window) >= length(oligo_seq)"))
    start = F.when(minus, F.col("lo") + F.length("window") - F.col("s_end")).otherwise(F.col("lo") + F.col("s_start"))
    end = F.when(minus, F.col("lo") + F.length("window") - F.col("s_start")).otherwise(F.col("lo") + F.col("s_end")) - 1
    # A generator's row: tests of the level are made on the numbers, not on measuring once more for each of them.
    found = found.select("*", F.explode(F.array(alignment.measure(F.col("q_aln"), F.col("s_aln"), unobserved_matches=False))).alias("m"))
    site = found.select(*SITE_KEYS, "role", "turn", "anchor_id", "a_start", "a_end", "oligo_seq", "q_aln", "s_aln", start.alias("s_start"), end.alias("s_end"), "m.mismatches", "m.gaps", "m.clean3")
    site = site.withColumn("level", level())
    faces = F.when(F.col("orientation") == "-", (F.col("a_start") < F.col("s_start")) & (F.col("a_end") < F.col("s_end"))).otherwise((F.col("s_start") < F.col("a_start")) & (F.col("s_end") < F.col("a_end")))
    site = site.where(faces & ((F.col("level") != "minor") if acts is None else acts))
    best = F.min_by(F.struct("s_start", "s_end", "q_aln", "s_aln", "mismatches", "gaps", "clean3", "level", "role", "turn"), F.struct(F.col("mismatches") + F.col("gaps"), -F.col("clean3"), F.col("oligo_seq")))
    return site.groupBy(*SITE_KEYS, "anchor_id").agg(best.alias("b")).select(*SITE_KEYS, "anchor_id", "b.*")


def accepted(sites: DataFrame, keys: tuple[str, ...] = SITE_KEYS, turn: str = "turn") -> DataFrame:
    """Of the sites of one key those that overlap none accepted before them, taken by ``turn``.

    Equal stretches are one, of the first turn. Sites that no chain of overlaps
    connects do not touch each other, so each run of overlapping ones is folded
    by itself.
    """
    columns = sites.columns
    rest = [c for c in columns if c not in (*keys, turn, "s_start", "s_end")]
    first = sites.groupBy(*keys, "s_start", "s_end").agg(F.min(F.struct(turn, *rest)).alias("_x")).select(*keys, "s_start", "s_end", "_x.*")
    along = Window.partitionBy(*keys).orderBy("s_start", "s_end")
    before = F.max("s_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = first.withColumn("_opens", F.when(before.isNull() | (F.col("s_start") > before), 1).otherwise(0))
    runs = runs.withColumn("_run", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct(turn, "s_start", "s_end", *rest)
    per = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(row)).alias("_all"))
    meets = lambda x, y: (x["s_start"] <= y["s_end"]) & (y["s_start"] <= x["s_end"])
    none = F.slice("_all", 1, 0)
    kept = F.aggregate("_all", none, lambda acc, x: F.when(F.exists(acc, lambda y: meets(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return per.select(*keys, F.explode(kept).alias("_k")).select(*keys, "_k.*").select(*columns)


def _unknown(found: DataFrame, known: DataFrame, reach: int) -> DataFrame:
    """Sites that overlap no known one of their ``SITE_KEYS``; each lies in a window of at most ``reach`` bases, so it stands in the bin of its start and is made once."""
    to_bin = lambda at: F.floor(at / reach)
    bins = F.explode(F.sequence(to_bin(F.col("s_start") - reach), to_bin(F.col("s_end"))))
    k = known.select(*(F.col(c).alias(f"_k_{c}") for c in (*SITE_KEYS, "s_start", "s_end")), bins.alias("_k_bin"))
    same = [F.col(c) == F.col(f"_k_{c}") for c in SITE_KEYS]
    meets = (F.col("s_start") <= F.col("_k_s_end")) & (F.col("_k_s_start") <= F.col("s_end")) & (F.col("_bin") == F.col("_k_bin"))
    return found.withColumn("_bin", to_bin(F.col("s_start"))).join(k, [*same, meets], "left_anti").drop("_bin")


def partner_scan(anchors: DataFrame, contigs: DataFrame, oligos: DataFrame, known: DataFrame, reach: int = MAX_PRODUCT, budget: int | None = None, acts: Column | None = None) -> DataFrame:
    """JN-06: the new partner sites beside anchors, with the anchor that found each; known are (tier, accession, oligo, orientation, s_start, s_end)."""
    found = facing_sites(scanned_anchors(anchors, contigs, reach, budget), oligos, acts)
    return accepted(_unknown(found, known, reach)).drop("turn")
