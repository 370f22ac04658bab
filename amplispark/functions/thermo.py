"""Nearest-neighbour thermodynamics as Column expressions (TH-01, TH-02, TH-05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amplispark.functions import seq

# Unified nearest-neighbour parameters (SantaLucia 1998), dH in kcal/mol, dS in cal/(mol K), dG at 37 degrees in kcal/mol.
_DH = {"AA": -7.9, "AT": -7.2, "TA": -7.2, "CA": -8.5, "GT": -8.4, "CT": -7.8, "GA": -8.2, "CG": -10.6, "GC": -9.8, "GG": -8.0}
_DS = {"AA": -22.2, "AT": -20.4, "TA": -21.3, "CA": -22.7, "GT": -22.4, "CT": -21.0, "GA": -22.2, "CG": -27.2, "GC": -24.4, "GG": -19.9}
_DG = {"AA": -1.00, "AT": -0.88, "TA": -0.58, "CA": -1.45, "GT": -1.44, "CT": -1.28, "GA": -1.30, "CG": -2.17, "GC": -2.24, "GG": -1.84}
_INIT = {"A": (2.3, 4.1), "T": (2.3, 4.1), "C": (0.1, -2.8), "G": (0.1, -2.8)}
_SYMMETRY = -1.4
_PAIR = dict(zip("ACGT", "TGCA", strict=True))


def with_complements(table: dict[str, float]) -> dict[str, float]:
    """Each dinucleotide and its reverse complement."""
    return table | {_PAIR[d[1]] + _PAIR[d[0]]: x for d, x in table.items()}


DH, DS, DG = with_complements(_DH), with_complements(_DS), with_complements(_DG)


def _sum(s: Column, table: dict[str, float]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: i < F.length(s))
    return F.aggregate(places, F.lit(0.0), lambda acc, i: acc + m[F.substring(s, i, F.lit(2))])


def nn_dg37(s: Column) -> Column:
    """TH-01: the sum of the stacking energies at 37 degrees, without initiation; null where a code is ambiguous."""
    return _sum(s, DG)


def melting_temp(s: Column, nm: float = 400.0, mv: float = 50.0, dv: float = 3.0, dntp: float = 0.8) -> Column:
    """TH-02: melting temperature at ``nm`` nM of strands, ``mv`` and ``dv`` mM of monovalent and divalent salt.

    dH / (dS + 0.368 (n - 1) ln Na + R ln(C / x)) - 273.15, x = 4 for strands
    that differ from their reverse complements and 1 for the others.
    """
    na = (mv + 120.0 * max(0.0, dv - dntp) ** 0.5) / 1000.0
    h, e = (F.create_map(*[F.lit(x) for b, v in _INIT.items() for x in (b, v[k])]) for k in (0, 1))
    ends = [F.substring(s, 1, 1), F.substring(s, -1, 1)]
    own = seq.reverse_complement(s) == s
    dh = _sum(s, DH) + h[ends[0]] + h[ends[1]]
    ds = _sum(s, DS) + e[ends[0]] + e[ends[1]] + F.when(own, F.lit(_SYMMETRY)).otherwise(F.lit(0.0))
    ds = ds + F.lit(0.368) * (F.length(s) - 1) * F.log(F.lit(na))
    conc = F.when(own, F.lit(nm / 1e9)).otherwise(F.lit(nm / 4e9))
    return F.lit(1000.0) * dh / (ds + F.lit(1.987) * F.log(conc)) - F.lit(273.15)


def resolve_against(oligo: Column, template: Column) -> Column:
    """TH-05: an oligo's degenerate codes as the template has them where it matches, else as their first base."""
    bases = F.create_map(*[F.lit(x) for c, b in seq.CODES.items() for x in (c, b)])
    pick = lambda o, t: F.when(F.instr(bases[o], t) > 0, t).otherwise(F.substring(bases[o], 1, 1))
    return F.array_join(F.zip_with(seq.chars(oligo), seq.chars(template), pick), "")
