"""Alignment and structure kernels in place (AL-01 .. AL-04, TH-03)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from amplispark.functions import kernels, seq, structures


def with_kernel(rows: DataFrame, inputs: list[str], kernel: Callable[[list[tuple]], list[tuple | None]], out: str) -> DataFrame:
    """``rows`` with the columns ``out`` (DDL) of a kernel that takes many inputs at once; nulls where it returns None or an input is null.

    AS-15: equal inputs of a batch are computed once; nothing is shuffled.
    """
    spec = StructType.fromDDL(out)
    types = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[f.dataType.simpleString()] for f in spec]
    names = [f"_{i}" for i in range(len(inputs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            args = list(zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in names], strict=True))
            distinct = [a for a in dict.fromkeys(args) if None not in a]
            of = dict(zip(distinct, kernel(distinct), strict=True))
            found = [of.get(a) or (None,) * len(spec) for a in args]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)] if found else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["_row", *spec.names])

    held = rows.select(F.struct("*").alias("_row"), *[F.col(c).alias(n) for c, n in zip(inputs, names, strict=True)])
    schema = StructType([held.schema["_row"], *spec.fields])
    return held.mapInArrow(run, schema).select("_row.*", *spec.names)


def semi_global(rows: DataFrame) -> DataFrame:
    """AL-01: (…, oligo_seq, window) with the alignment of the whole oligo."""
    return with_kernel(rows, ["oligo_seq", "window"], kernels.semi_global, "q_aln string, s_aln string, s_start int, s_end int, score int")


def run_length(rows: DataFrame) -> DataFrame:
    """AL-03: (…, oligo_seq, window) with the change of one run's length that explains the window, and its alignment; nulls where none does."""
    each = lambda pairs: [kernels.run_length(*p) for p in pairs]
    return with_kernel(rows, ["oligo_seq", "window"], each, "shift int, run_start int, q_aln string, s_aln string, s_start int, s_end int")


def _chosen(pairs: list[tuple]) -> list[tuple]:
    """AL-04 for each pair: its alignment, or the reading by run length where that leaves no mismatch and the alignment is not perfect."""
    out = []
    for (oligo, window), (q, s, start, end, score) in zip(pairs, kernels.semi_global(pairs), strict=True):
        other = None if score == kernels.MATCH * len(oligo) else kernels.run_length(oligo, window)
        if other is None:
            out.append((q, s, start, end, None, None))
        else:
            change, at, *lines = other
            run = len(oligo[at:]) - len(oligo[at:].lstrip(oligo[at]))
            out.append((*lines, oligo[at], f"{run}->{run + change}"))
    return out


def chosen(rows: DataFrame) -> DataFrame:
    """AL-04: (…, oligo_seq, window) with the alignment to judge; where it is one by run length, ``run_base`` and ``run_change`` ("4->5") name it."""
    return with_kernel(rows, ["oligo_seq", "window"], _chosen, "q_aln string, s_aln string, s_start int, s_end int, run_base string, run_change string")


def pair_structures(pairs: DataFrame) -> DataFrame:
    """QC-07, TH-03: (…, seq_a, seq_b) with the most stable dimer of each pair."""
    return with_kernel(pairs, ["seq_a", "seq_b"], structures.dimers, "tm double, dg double")


def hairpins(oligos: DataFrame) -> DataFrame:
    """QC-07, TH-03: (…, sequence) with the most stable hairpin of each oligo; nulls where it has none."""
    return with_kernel(oligos, ["sequence"], lambda rows: structures.hairpins([s for (s,) in rows]), "hairpin_tm double, hairpin_dg double")


def site_duplexes(sites: DataFrame, key: str = "site_id") -> DataFrame:
    """TH-04, TH-05: (…, tm, dg, delta_tm) of each aligned site (``key``, q_aln, s_aln): of the degenerate oligo's mix the member that binds best.

    A degenerate code takes the template's base where it holds it, as that
    member of the mix binds there, and is expanded where it does not; a code of
    the template takes the oligo's base where it holds it, else its first one.
    Nulls where less than eight bases lie opposite, or nothing pairs.
    """
    bases = F.create_map(*[F.lit(x) for c, b in seq.CODES.items() for x in (c, b)])
    holds = lambda code, b: F.coalesce(F.instr(bases[code], b) > 0, F.lit(False))
    plain = lambda b: b.isin(*"ACGT")
    q, t = seq.chars(F.col("q_aln")), seq.chars(F.col("s_aln"))
    member = F.array_join(F.filter(F.zip_with(q, t, lambda a, b: F.when(a == "-", "").otherwise(F.when(plain(b) & holds(a, b), b).otherwise(a))), lambda x: x != ""), "")
    # Both codes degenerate: the template takes the first of its bases that the oligo's code holds.
    shared = lambda a, b: F.get(F.filter(seq.chars(bases[b]), lambda x: holds(a, x)), 0)
    template = F.array_join(F.zip_with(q, t, lambda a, b: F.when(b.isin("-", "."), "").when(plain(b), b).otherwise(F.coalesce(shared(a, b), F.substring(bases[b], 1, 1), F.lit("N")))), "")
    mix = sites.select("*", template.alias("_t"), F.when(seq.combinations(member) <= 64, seq.expand(member)).otherwise(F.array(member)).alias("_mix"))
    each = with_kernel(mix.select(F.col(key).alias("_key"), F.col("_t"), F.explode("_mix").alias("_m")), ["_m", "_t"], structures.duplexes, "tm double, dg double, delta_tm double")
    best = each.groupBy("_key").agg(F.max_by(F.struct("tm", "dg", "delta_tm"), F.struct("tm", "_m")).alias("_b"))
    return sites.join(best, sites[key] == best["_key"], "left").drop("_key").select(*sites.columns, "_b.tm", "_b.dg", "_b.delta_tm")


def measure(q: Column, s: Column, unobserved_matches: bool = True) -> Column:
    """AL-02: struct<matches, mismatches, gaps, clean3> of an alignment; clean3 is the run of matches at the 3' end."""
    m = F.create_map(*[F.lit(x) for kv in seq.MASKS.items() for x in kv])

    def state(a, b):
        share = F.coalesce(m[a].bitwiseAND(m[b]), F.lit(0)) != 0
        seen = share if unobserved_matches else share & (b != "N")
        return F.when((a == "-") | (b == "-"), F.lit("g")).when(seen, F.lit("m")).otherwise(F.lit("x"))

    marks = F.array_join(F.zip_with(seq.chars(q), seq.chars(s), state), "")
    count = lambda s, c: F.length(F.regexp_replace(s, f"[^{c}]", "")).alias({"m": "matches", "x": "mismatches", "g": "gaps"}[c])
    counts = lambda s: F.struct(count(s, "m"), count(s, "x"), count(s, "g"), F.length(F.regexp_extract(s, "(m*)$", 1)).alias("clean3"))
    return F.transform(F.array(marks), counts)[0]  # the marks are made once a row, however many of the numbers are used
