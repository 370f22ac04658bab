"""Sequence strings as Column expressions (FN-01 .. FN-31); no user functions.

A sequence is an upper-case string of IUPAC codes. Nulls give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC codes with the bases they stand for, and their complements.
CODES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT_FROM = "ACGTRYSWKMBDHVN"
COMPLEMENT_TO = "TGCAYRSWMKVHDBN"
_BIT = {"A": 1, "C": 2, "G": 4, "T": 8}
MASKS = {code: sum(_BIT[b] for b in bases) for code, bases in CODES.items()}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def chars(s: Column) -> Column:
    """The characters of a string as an array; of an empty one, no element."""
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: i <= F.length(s)), lambda i: F.substring(s, i, 1))


def normalise(s: Column) -> Column:
    """FN-01: without white space, in upper case."""
    return F.upper(F.regexp_replace(s, r"\s+", ""))


def find_invalid(s: Column) -> Column:
    """FN-02: array<struct<pos, ch>> of the characters that are no IUPAC code, from 1."""
    marked = F.transform(chars(s), lambda c, i: F.struct((i + 1).alias("pos"), c.alias("ch")))
    return F.filter(marked, lambda x: ~x["ch"].isin(list(CODES)))


def is_degenerate(s: Column) -> Column:
    """FN-03"""
    return s.rlike("[^ACGT]")


def combinations(s: Column) -> Column:
    """FN-04: how many concrete sequences a degenerate one stands for."""
    sizes = _map({c: len(b) for c, b in CODES.items()})
    return F.aggregate(chars(s), F.lit(1).cast("long"), lambda acc, c: acc * sizes[c])


def expand(s: Column, most: int = 64) -> Column:
    """FN-05: the concrete sequences in order, the last position running fastest; an error above ``most``."""
    bases = F.create_map(*[x for c, b in CODES.items() for x in (F.lit(c), F.array(*[F.lit(y) for y in b]))])
    grown = F.aggregate(
        chars(s),
        F.array(F.lit("")),
        lambda acc, c: F.flatten(F.transform(acc, lambda p: F.transform(bases[c], lambda b: F.concat(p, b)))),
    )
    too_many = F.raise_error(F.concat(F.lit("too many variants of "), s)).cast("array<string>")
    return F.when(combinations(s) <= most, grown).otherwise(too_many)


def complement(s: Column) -> Column:
    return F.translate(s, COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(s: Column) -> Column:
    """FN-06"""
    return F.reverse(complement(s))


def gc_percent(s: Column) -> Column:
    """FN-07; null for an empty sequence."""
    rest = F.replace(F.replace(s, F.lit("G"), F.lit("")), F.lit("C"), F.lit(""))
    return F.try_divide(F.lit(100.0) * (F.length(s) - F.length(rest)), F.length(s))


def longest_run(s: Column, base: str | None = None) -> Column:
    """FN-08: the longest run of one base, or of ``base``; 0 without one.

    Most runs of a sequence are of one base: runs of four or more are taken out
    first, shorter ones only where there is none.
    """
    one = f"[{base or 'ACGT'}]"
    longest = lambda least: F.array_max(F.transform(F.regexp_extract_all(s, F.lit(rf"({one})\1{{{least - 1},}}"), F.lit(0)), F.length))
    return F.coalesce(longest(4), longest(2), F.when(s.rlike(one), F.lit(1)), F.lit(0))


def masks(s: Column) -> Column:
    """Each code as a set of bases, in bits; what is no code as the empty set."""
    m = _map(MASKS)
    return F.transform(chars(s), lambda c: F.coalesce(m[c], F.lit(0)))


def compatible(a: Column, b: Column) -> Column:
    """FN-09: whether two codes share a base."""
    m = _map(MASKS)
    return m[a].bitwiseAND(m[b]) != 0


def count_mismatches(a: Column, b: Column) -> Column:
    """FN-10: positions of two equally long sequences whose codes share no base."""
    return F.aggregate(F.zip_with(masks(a), masks(b), lambda x, y: (x.bitwiseAND(y) == 0).cast("int")), F.lit(0), lambda acc, x: acc + x)


def sanitise(s: Column) -> Column:
    """FN-11: what is no IUPAC code becomes N."""
    return F.regexp_replace(F.upper(s), f"[^{COMPLEMENT_FROM}]", "N")


def _aligned(q: Column, s: Column, f) -> Column:
    return F.array_join(F.zip_with(chars(q), chars(s), f), "")


def midline(q: Column, s: Column) -> Column:
    """FN-12: | for equal bases, : for a match through an ambiguity code, a space otherwise."""
    m = _map(MASKS)
    through = lambda a, b: F.coalesce(m[a].bitwiseAND(m[b]), F.lit(0)) != 0
    return _aligned(q, s, lambda a, b: F.when((a == b) & (a != "-") & (a != "."), F.lit("|")).when(through(a, b), F.lit(":")).otherwise(F.lit(" ")))


def site_string(q: Column, s: Column) -> Column:
    """FN-13: a site as . for a match, its base for a mismatch, - for a gap; insertions are in lower case."""
    m = _map(MASKS)
    match = lambda a, b: F.coalesce(m[a].bitwiseAND(m[b]), F.lit(0)) != 0
    return _aligned(q, s, lambda a, b: F.when(a == "-", F.lower(b)).when(b == "-", F.lit("-")).when(match(a, b), F.lit(".")).otherwise(b))


def oligo_of(label: Column) -> Column:
    """FN-15: a query's oligo, without the number of its variant."""
    return F.regexp_replace(label, r"_v\d+$", "")


def record_type(accession: Column, title: Column) -> Column:
    """FN-16: transcript, genomic or other, by accession prefix and then by words of the title."""
    return (
        F.when(accession.rlike(r"^(NM|NR|XM|XR)_"), F.lit("transcript"))
        .when(accession.rlike(r"^(NC|NG|NT|NW|NZ|AC)_"), F.lit("genomic"))
        .when(title.rlike(r"(?i)\b(mrna|transcript|cdna)\b"), F.lit("transcript"))
        .when(title.rlike(r"(?i)\b(genome|chromosome|plasmid|contig|scaffold|genomic)\b"), F.lit("genomic"))
        .otherwise(F.lit("other"))
    )


def is_plasmid(title: Column) -> Column:
    """FN-17"""
    return title.rlike(r"(?i)\bplasmid\b")


def collection_year(value: Column, latest: Column) -> Column:
    """FN-18: the first four-digit year from 1800 to 2099 that stands alone; null if none or later than ``latest``."""
    y = F.regexp_extract(value, r"(^|[^0-9])(1[89][0-9]{2}|20[0-9]{2})([^0-9]|$)", 2)
    year = F.when(y != "", y.cast("int"))
    return F.when(year <= latest, year)


def slug(name: Column) -> Column:
    """FN-19: lower case, everything else than letters and digits as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def valid_accession(a: Column) -> Column:
    """FN-19, IC-02: letters, an optional underscore, digits and an optional version."""
    return a.rlike(r"^[A-Za-z]{1,6}_?[A-Za-z]{0,4}[0-9]+(\.[0-9]+)?$")


def sequence_stats(s: Column) -> Column:
    """FN-20: struct<length, n_count, gaps>; a gap is a run of ten N or more."""
    return F.struct(
        F.length(s).cast("long").alias("length"),
        F.regexp_count(s, F.lit("N")).cast("long").alias("n_count"),
        F.regexp_count(s, F.lit("N{10,}")).cast("long").alias("gaps"),
    )


def n_run_before(s: Column, pos: Column) -> Column:
    """FN-21: how many N end just before the 0-based position."""
    return F.length(F.regexp_extract(F.substring(s, F.lit(1), pos), "(N*)$", 1))


def n_run_after(s: Column, pos: Column) -> Column:
    """FN-21: how many N begin at the 0-based position."""
    return F.length(F.regexp_extract(F.substring(s, pos + 1, F.length(s)), "^(N*)", 1))


def record_url(accession: Column) -> Column:
    """FN-22: the public page of an accession, by its kind."""
    kind = F.when(accession.rlike("^GC[AF]_"), F.lit("datasets/genome/")).otherwise(F.lit("nuccore/"))
    return F.concat(F.lit("https://www.ncbi.nlm.nih.gov/"), kind, accession)


def is_offpeak(utc: Column) -> Column:
    """FN-23: Saturday, Sunday, or from 21:00 to 05:00, in New York."""
    t = F.from_utc_timestamp(utc, "America/New_York")
    return F.dayofweek(t).isin(1, 7) | (F.hour(t) >= 21) | (F.hour(t) < 5)


def number_range(low: Column, high: Column, digits: int = 1) -> Column:
    """FN-25: one number, or two with a hyphen where they differ."""
    a, b = (F.format_string(f"%.{digits}f", x.cast("double")) for x in (low, high))
    return F.when(a == b, a).otherwise(F.concat(a, F.lit("-"), b))


def has_mgb(modifications: Column, reporter: Column, quencher: Column) -> Column:
    """FN-26: MGB among the modifications, or named with a dye."""
    named = F.upper(F.concat_ws(" ", reporter, quencher)).contains("MGB")
    return F.coalesce(F.array_contains(modifications, "MGB"), F.lit(False)) | named


def modification_list(text: Column) -> Column:
    """FN-27: split on commas and semicolons, in upper case, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.upper(text), "[,;]"), lambda x: F.trim(x)), lambda x: x != ""))


def level_of_title(title: Column) -> Column:
    """FN-31: the assembly level at the end of "contig (level)"; empty without one."""
    return F.regexp_extract(title, r"\(([^()]*)\)$", 1)


def redact(message: Column) -> Column:
    """FN-29: keys and addresses in a message, masked."""
    return F.regexp_replace(F.regexp_replace(message, r"(?i)(api_key|email|token)=[^&\s]+", "$1=***"), r"://[^/@\s]+@", "://***@")


def forward_span(start: Column, end: Column, strand: Column, length: Column) -> Column:
    """FN-30: a half-open span of the sense strand on the forward strand of its contig."""
    minus = strand == "-"
    return F.struct(F.when(minus, length - end).otherwise(start).alias("start"), F.when(minus, length - start).otherwise(end).alias("end"))
