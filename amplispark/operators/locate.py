"""Copies of a fragment in genomes (LC-*): seeds, exact blocks, chains, masked and shorter-seed search, the copy rule."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amplispark.functions import seeds as search
from amplispark.functions import seq
from amplispark.functions.seeds import ANCHORED, CONTEXT, FALLBACK, IDENTITY, IDENTITY_ANCHORED, MAX_INDEL, MOST_HITS, SEED, STEP, Reference
from amplispark.operators import windows

#: Contigs that a task reads side by side, and their bases at most (a longer contig is read by itself).
_ROWS, _BASES = 1000, 1_000_000
CANDIDATE = (
    "accession string, contig string, strand string, ref int, start int, end int, length int, anchored int, identity double, cut boolean, "
    "context_left int, context_right int, n_left int, n_inside int, n_right int, kind string, "
    "anchors array<struct<place:int,start:int,size:int>>, region string, region_start int"
)
_TYPES = [
    *(pa.string(),) * 3, *(pa.int32(),) * 5, pa.float64(), pa.bool_(), *(pa.int32(),) * 5, pa.string(),
    pa.list_(pa.struct([("place", pa.int32()), ("start", pa.int32()), ("size", pa.int32())])), pa.string(), pa.int32(),
]
_NAMES = [c.split()[0] for c in CANDIDATE.split(", ")]


def seeds(fragment: str, k: int = SEED, step: int = STEP) -> list[tuple[int, str]]:
    """LC-01: (place, k-mer) every ``step`` bases, and the last one."""
    return [(p, fragment[p : p + k]) for p in search.seed_places(Reference(fragment), k, step)]


def _named(contigs: DataFrame) -> DataFrame:
    """(accession, contig, seq); a genome of one contig need not name it."""
    return contigs.select("accession", F.col("contig") if "contig" in contigs.columns else F.col("accession").alias("contig"), "seq")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str], search.Contigs]]:
    """(accessions, contig names, contigs) of the rows with a sequence, a bounded number of bases at a time."""
    for b in batches:
        held, bases = [], 0
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if row[2] is None:
                continue
            if held and (bases + len(row[2]) > _BASES or len(held) >= _ROWS):
                yield _side_by_side(held)
                held, bases = [], 0
            held.append(row)
            bases += len(row[2])
        if held:
            yield _side_by_side(held)


def _side_by_side(rows: list[tuple]) -> tuple[list[str], list[str], search.Contigs]:
    accessions, names, seqs = zip(*rows, strict=True)
    return accessions, names, search.Contigs(list(seqs))


def seed_hits(contigs: DataFrame, fragment: str, k: int = SEED, step: int = STEP, most: int = MOST_HITS) -> DataFrame:
    """LC-02: (accession, strand, place, start) where a seed occurs as it is; a seed with more than ``most`` hits in a strand of a contig has none.

    Contigs are read where they lie: every k-mer is looked up in the table of
    the fragment's seeds, on both strands at once, and only hits leave the task.
    """
    reference = Reference(fragment)
    table = search.SeedTable(reference, search.seed_places(reference, k, step), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for accessions, _, sequences in _stretches(batches):
            hits = table.hits(sequences)
            hits = search.pick(hits, search.informative(hits, most=most))
            named = [pa.array(x, pa.string()).take(pa.array(n)) for x, n in ((accessions, hits.contig), (("+", "-"), hits.strand))]
            columns = [*named, pa.array(hits.place, pa.int32()), pa.array(hits.start, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["accession", "strand", "place", "start"])

    return _named(contigs).mapInArrow(run, "accession string, strand string, place int, start int")


def exact_blocks(hits: DataFrame, k: int = SEED) -> DataFrame:
    """LC-03: hits of one diagonal that touch, as one block of (place, start, length): gaps and islands."""
    on = Window.partitionBy("accession", "strand", "diagonal").orderBy("place")
    d = hits.withColumn("diagonal", F.col("start") - F.col("place"))
    before = F.max(F.col("place") + k).over(on.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_opens", F.when(before.isNull() | (F.col("place") > before), 1).otherwise(0))
    d = d.withColumn("_block", F.sum("_opens").over(on.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = d.groupBy("accession", "strand", "diagonal", "_block").agg(F.min("place").alias("place"), F.min("start").alias("start"), (F.max("place") + k - F.min("place")).alias("length"))
    return blocks.select("accession", "strand", "place", "start", "length")


def seed_blocks(contigs: DataFrame, fragment: str, k: int = SEED, step: int = STEP, most: int = MOST_HITS) -> DataFrame:
    """LC-01 .. LC-03 in one reading of the contigs: (accession, contig, strand, place, start, length, size), the :func:`exact_blocks` of each contig's own hits.

    A contig's hits lie in the task that reads it, so they are folded there and
    nothing is shuffled. ``size`` is the contig's number of bases.
    """
    reference = Reference(fragment)
    table = search.SeedTable(reference, search.seed_places(reference, k, step), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for accessions, names, sequences in _stretches(batches):
            hits = table.hits(sequences)
            b = search.blocks_of(search.pick(hits, search.informative(hits, most=most)), k)
            named = [pa.array(x, pa.string()).take(pa.array(n)) for x, n in ((accessions, b.contig), (names, b.contig), (("+", "-"), b.strand))]
            columns = [*named, *(pa.array(x, pa.int32()) for x in (b.place, b.start, b.size, sequences.sizes[b.contig]))]
            yield pa.RecordBatch.from_arrays(columns, names=["accession", "contig", "strand", "place", "start", "length", "size"])

    return _named(contigs).mapInArrow(run, "accession string, contig string, strand string, place int, start int, length int, size int")


def candidates(contigs: DataFrame, references: Sequence[Reference], max_indel: int = MAX_INDEL, fallback: int | None = FALLBACK, flank: int = search.FLANK) -> DataFrame:
    """LC-01 .. LC-09, LC-20: the candidate copies (``CANDIDATE``) of some references in genomes of one contig or several.

    A region reaches ``flank`` bases and the tolerance beyond its candidate.

    One pass over the contigs where they lie; only candidates are shuffled, to
    tell which genomes have one with ``ANCHORED`` bases: those have no use for
    what lies under N or was found by seeds of ``fallback`` bases, and the
    latter is for genomes without the former.
    """
    exact = [search.Searcher(r, SEED, STEP, max_indel) for r in references]
    shorter = [search.Searcher(r, fallback, STEP, max_indel) for r in references] if fallback else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for accessions, names, sequences in _stretches(batches):
            t = search.locate(sequences, exact, shorter, flank)
            if len(t["contig"]):
                named = {"accession": np.array(accessions, object)[t["contig"]], "contig": np.array(names, object)[t["contig"]], "strand": np.array(["+", "-"], object)[t["strand"]]}
                more = {"cut": (t["start"] < 0) | (t["end"] > t["length"]), "anchors": [[{"place": p, "start": s, "size": n} for p, s, n in a.tolist()] for a in t["anchors"]]}
                columns = t | named | more
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], kind, from_pandas=c == "identity") for c, kind in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)

    found = _named(contigs).mapInArrow(run, CANDIDATE)
    genome = Window.partitionBy("accession")
    strong = F.max((F.col("kind") == "exact") & (F.col("anchored") >= ANCHORED)).over(genome)
    hidden = F.max(F.col("kind") == "masked").over(genome)
    flagged = found.withColumn("_strong", strong).withColumn("_hidden", hidden)
    return flagged.where("kind = 'exact' OR NOT _strong AND (kind = 'masked' OR NOT _hidden)").drop("_strong", "_hidden")


def copies(contigs: DataFrame, fragment: str, max_indel: int = MAX_INDEL, left: str = "", right: str = "", flank: int = search.FLANK) -> DataFrame:
    """:func:`candidates` of one fragment with its flanks in a record of its own (:func:`context`)."""
    return candidates(contigs, [Reference(fragment, left, right)], max_indel, flank=flank)


def context(found: DataFrame, contigs: DataFrame, size: int = 1000) -> tuple[str, str]:
    """LC-12: the flanks of the best whole copy of all, by anchored bases, identity and place; empty where none has ``ANCHORED`` bases."""
    whole = found.where((F.col("kind") == "exact") & ~F.col("cut") & (F.col("anchored") >= ANCHORED))
    best = whole.orderBy(F.desc("anchored"), F.desc("identity"), "accession", "contig", "strand", "start").limit(1)
    row = windows.flanks_in(best, _named(contigs), size).first()
    return (row["left"], row["right"]) if row else ("", "")


def is_copy(anchored: Column, identity: Column, left: Column, right: Column, touches: Column) -> Column:
    """LC-10: enough anchored bases; or context on a side that touches or on both sides; or identity with some anchors."""
    context = ((left >= CONTEXT) | (right >= CONTEXT)) & touches | ((left >= CONTEXT) & (right >= CONTEXT))
    return (anchored >= ANCHORED) | context | ((identity >= IDENTITY) & (anchored >= IDENTITY_ANCHORED))


def judged(found: DataFrame) -> DataFrame:
    """LC-10 for every kind of candidate, as ``is_copy``: one hidden by N always counts, one of shorter seeds by identity alone."""
    touches = (F.col("anchored") > 0) | F.col("cut")
    by_identity = F.coalesce((F.col("identity") >= IDENTITY) & (F.col("anchored") >= IDENTITY_ANCHORED), F.lit(False))
    exact = F.coalesce(is_copy(F.col("anchored"), F.col("identity"), F.col("context_left"), F.col("context_right"), touches), F.lit(False))
    return found.withColumn("is_copy", F.when(F.col("kind") == "masked", True).when(F.col("kind") == "fallback", by_identity).otherwise(exact))


def classify(found: DataFrame, contigs: DataFrame) -> DataFrame:
    """LC-11, LC-15, LC-16: (accession, state, copies, beside) of every listed genome.

    A copy under N or by shorter seeds gives way to an exact one at its place.
    The state is found, contig_break where all copies are cut, and not_found,
    also where all are cut and none has a base of the fragment, which then is
    not in the assembly. ``beside`` tells of anchored regions that are no copy:
    beside copies, related without one, or flanked where only flanks were found.
    """
    item = F.struct("contig", "strand", "start", "end", "anchored", "cut", "kind", "is_copy", F.greatest("context_left", "context_right").alias("context"))
    per = judged(found).groupBy("accession").agg(F.collect_list(item).alias("all"))
    meets = lambda x, rows: F.exists(rows, lambda y: (x["contig"] == y["contig"]) & (x["strand"] == y["strand"]) & (F.least(x["end"], y["end"]) > F.greatest(x["start"], y["start"])))
    per = per.withColumn("sure", F.filter("all", lambda x: x["is_copy"] & (x["kind"] == "exact")))
    per = per.withColumn("chosen", F.concat("sure", F.filter("all", lambda x: x["is_copy"] & (x["kind"] != "exact") & ~meets(x, F.col("sure")))))
    per = per.withColumn("others", F.filter("all", lambda x: ~x["is_copy"] & (x["anchored"] > 0) & (x["kind"] != "fallback") & ~meets(x, F.col("chosen"))))
    some, other = F.size("chosen") > 0, F.size("others") > 0
    beside = F.when(some & other, "beside").when(other, "related").when(~some & F.exists("all", lambda x: x["context"] >= CONTEXT), "flanked")
    cut = F.forall("chosen", lambda x: x["cut"])
    absent = cut & F.forall("chosen", lambda x: x["anchored"] == 0)
    state = F.when(~some | absent, "not_found").when(cut, "contig_break").otherwise("found")
    n = F.when(state == "not_found", 0).otherwise(F.size("chosen"))
    told = per.select("accession", state.alias("state"), n.cast("long").alias("copies"), beside.alias("beside"))
    listed = contigs.select("accession").distinct().join(told, "accession", "left")
    return listed.select("accession", F.coalesce("state", F.lit("not_found")).alias("state"), F.coalesce("copies", F.lit(0).cast("long")).alias("copies"), "beside")


def role_windows(found: DataFrame, roles: DataFrame, pad: int = 15) -> DataFrame:
    """AS-02: (accession, contig, strand, start, oligo, oligo_seq, window) of each copy and oligo; the window is null where its site runs off the region.

    Roles are (oligo, oligo_seq, on, place, size): where the oligo lies on the
    fragment and on which strand of it. A site is placed by the nearest block,
    so that a copy longer or shorter than the fragment has each site in its place.
    """
    off = lambda b: F.when((b["place"] <= F.col("place")) & (F.col("place") < b["place"] + b["size"]), 0).otherwise(F.least(F.abs(F.col("place") - b["place"]), F.abs(F.col("place") - b["place"] - b["size"])))
    near = F.array_min(F.transform("anchors", lambda b, i: F.struct(off(b).alias("off"), i.alias("i"), (b["start"] - b["place"]).alias("shift"))))["shift"]
    j = found.crossJoin(roles)  # an assay's own oligos, a handful
    at = near + F.col("place") - F.col("region_start")
    lo, hi = F.greatest(at - pad, F.lit(0)), F.least(at + F.col("size") + pad, F.length("region"))
    cut = F.substring(F.col("region"), lo + 1, hi - lo)
    inside = (at >= 0) & (at + F.col("size") <= F.length("region"))
    window = F.when(inside, F.when(F.col("on") == "-", seq.reverse_complement(cut)).otherwise(cut))
    return j.select("accession", "contig", "strand", "start", "oligo", "oligo_seq", window.alias("window"))


def partitioned_copies(contigs: DataFrame, hits: DataFrame, references: Sequence[Reference], longest: int, flank: int = search.FLANK, within: int = search.TOLERANCE) -> DataFrame:
    """LC-18: (accession, contig, strand, start, end, anchored, identity, found_by): the copies in records, small ones read whole and large ones around the hits of a search.

    A record of at most ``longest`` bases is scanned as it is. Of a larger one
    only the stretches around its hits are cut and scanned, and what is found
    there is moved to the record's own coordinates. Hits are (accession, contig,
    hit_from, hit_to), from 1 on the forward strand; those of records that were
    not searched, small or unknown, are leaks and have no effect. Copies of one
    strand that start within ``within`` bases of each other are one, that with
    most anchored bases.
    """
    named = _named(contigs).withColumn("_n", F.length("seq"))
    pad = max(len(r.fragment) for r in references) + flank + within
    h = hits.select("accession", "contig" if "contig" in hits.columns else F.col("accession").alias("contig"), (F.col("hit_from") - 1 - pad).alias("a"), (F.col("hit_to") + pad).alias("b"))
    # Stretches that meet are one, so that no copy is cut by the end of a stretch but where the record ends.
    along = Window.partitionBy("accession", "contig").orderBy("a", "b")
    opens = F.col("a") > F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = h.withColumn("_o", F.coalesce(opens.cast("int"), F.lit(0))).withColumn("_r", F.sum("_o").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = runs.groupBy("accession", "contig", "_r").agg(F.greatest(F.min("a"), F.lit(0)).alias("a"), F.max("b").alias("b"))
    # Records are read once: a small one goes whole, whatever was found in it, a large one by its stretches, and leaks meet no record.
    small = F.col("_n") <= longest
    near = F.row_number().over(Window.partitionBy("accession", "contig").orderBy("a"))
    cut = named.join(stretches.withColumn("_k", near), ["accession", "contig"], "left")
    # A test of both sides, as one of the records alone would be made where their sequences are still to be derived.
    cut = cut.where(F.when(small, (F.col("_n") > 0) & (F.coalesce(F.col("_k"), F.lit(1)) == 1)).otherwise(F.col("a").isNotNull()))
    cut = cut.withColumn("a", F.when(small, 0).otherwise(F.col("a"))).withColumn("b", F.when(small, F.col("_n")).otherwise(F.least("b", "_n")))
    # A piece's name tells where it was cut, and whether its record is small: genomes have their small and their large records judged apart.
    route = F.when(small, "s").otherwise("l")
    pieces = cut.select(F.concat(route, "accession").alias("accession"), F.concat_ws("|", "a", "b", "_n", "contig").alias("contig"), F.substring(F.col("seq"), (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).alias("seq"))
    found = judged(candidates(pieces, references, flank=flank)).where("is_copy").withColumn("_p", F.split("contig", r"\|", 4))
    a, b, n = (F.col("_p")[i].cast("int") for i in range(3))
    shift = F.when(F.col("strand") == "+", a).otherwise(n - b)
    found_by = F.when(F.substring("accession", 1, 1) == "s", "direct_scan").otherwise("search")
    every = found.select(
        F.expr("substring(accession, 2)").alias("accession"), F.col("_p")[3].alias("contig"), "strand", (F.col("start") + shift).cast("int").alias("start"), (F.col("end") + shift).cast("int").alias("end"),
        "anchored", "identity", found_by.alias("found_by"),
    )
    line = Window.partitionBy("accession", "contig", "strand").orderBy("start", "end")
    apart = F.coalesce(F.col("start") - F.lag("start").over(line) > within, F.lit(True))
    places = every.withColumn("_o", apart.cast("int")).withColumn("_r", F.sum("_o").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("start", "end", "anchored", "identity", "found_by"), F.struct("anchored", "identity", -F.col("start")))
    return places.groupBy("accession", "contig", "strand", "_r").agg(best.alias("b")).select("accession", "contig", "strand", "b.*")
