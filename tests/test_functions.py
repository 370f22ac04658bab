import functools
import itertools
import random

import pytest
from pyspark.sql import functions as F

from amplispark.functions import grading, kernels, seq, thermo
from amplispark.operators import alignment, specificity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(s):
    return F.lit(s)


def test_thermodynamics(spark):
    assert one(spark, thermo.nn_dg37(lit("GCGCG"))) == pytest.approx(-8.82)
    assert one(spark, thermo.nn_dg37(lit("AAAAA"))) == pytest.approx(-4.00)
    assert one(spark, thermo.melting_temp(lit("CTTCTGACCGAGGTCGAAACGTA"))) == pytest.approx(66.4, abs=0.1)
    assert one(spark, thermo.resolve_against(lit("ACRY"), lit("ACGG"))) == "ACGC"


def test_sequences(spark):
    assert one(spark, seq.expand(lit("GACCCCAAAATCAGCGAAAR"))) == ["GACCCCAAAATCAGCGAAAA", "GACCCCAAAATCAGCGAAAG"]
    assert one(spark, seq.expand(lit("GRAY"))) == ["GAAC", "GAAT", "GGAC", "GGAT"]
    assert one(spark, seq.reverse_complement(lit("ACGTRN"))) == "NYACGT"
    assert [tuple(x) for x in one(spark, seq.find_invalid(lit("ACXGU")))] == [(3, "X"), (5, "U")]
    assert one(spark, seq.find_invalid(lit(""))) == []
    assert one(spark, seq.longest_run(lit("AACCCCG"))) == 4
    assert one(spark, seq.normalise(lit(" ac g\tt"))) == "ACGT"
    assert one(spark, seq.gc_percent(lit(""))) is None
    with pytest.raises(Exception, match="too many variants"):
        spark.range(1).select(seq.expand(F.concat(lit("NNNN"), F.col("id").cast("string").substr(1, 0)))).collect()


def test_runs_and_gc_of_odd_sequences(spark):
    rng = random.Random(5)
    texts = [None, "", "N", "acgt", "Ä", "A", "AG", "AAG", "GGTTT", "NNNNNA", "ANAANAAA", "TTTTGGGG", "GÄGGÄC", "A-A\nA", "R" * 9 + "C" * 5, "ACGT" * 50, "AACCGGTT" * 50, "G" * 200_000, "CA" * 100_000]
    texts += ["".join(rng.choices("ACGTNa", k=rng.randrange(60))) for _ in range(200)]
    run = lambda s, bases: max((len(list(g)) for c, g in itertools.groupby(s or "") if c in bases), default=0)
    gc = lambda s: 100.0 * sum(c in "GC" for c in s) / len(s) if s else None
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(2)
    found = {r.i: (r.gc, r.run, r.g_run) for r in df.select("i", seq.gc_percent(F.col("s")).alias("gc"), seq.longest_run(F.col("s")).alias("run"), seq.longest_run(F.col("s"), "G").alias("g_run")).collect()}
    assert found == {i: (gc(s), run(s, "ACGT"), run(s, "G")) for i, s in enumerate(texts)}


def grade(spark, q, s, role="forward", mgb=False):
    r = one(spark, grading.grade(lit(q), lit(s), lit(role), lit(mgb)))
    return r["class"], r["rule"]


Q = "GACCCCAAAATCAGCGAAAT"


def at(*changes, q=Q):
    """q with the bases at 3' positions exchanged."""
    s = list(q)
    for pos, base in changes:
        s[len(q) - pos] = base
    return "".join(s)


def test_primer_grades(spark):
    q = "GACCCCAAAATCAGCGAAAA"
    assert grade(spark, q, at((1, "T"), q=q)) == ("likely_failure", "R1")  # A-A at the end
    assert grade(spark, "GACCCCAAAATCAGCGAACA", "GACCCCAAAATCAGCGAAGA") == ("at_risk", "R1")  # C-C before it
    assert grade(spark, q, at((1, "G"), q=q)) == ("tolerated", "R1")  # A-C at the end
    assert grade(spark, Q, at((7, "T"))) == ("tolerated", "R2")
    assert grade(spark, Q, at((1, "C"), (4, "C"))) == ("likely_failure", "R3")
    assert grade(spark, Q, at((8, "T"), (12, "T")))[0] == "at_risk"
    assert grade(spark, Q, at((7, "T"), (10, "G"), (14, "T")))[0] == "likely_failure"
    assert grade(spark, Q, at((16, "G"), (17, "G"), (18, "G"), (19, "G")))[0] == "at_risk"
    assert grade(spark, Q, Q) == ("perfect", "")
    assert grade(spark, Q, at((1, "N"))) == ("indeterminate", "R6")
    assert grade(spark, Q, at((1, "."))) == ("likely_failure", "R1")


def test_gap_and_probe_grades(spark):
    assert grade(spark, "GACCCCAAAATCAGCGAAAT", "GACCCC-AAATCAGCGAAAT") == ("at_risk", "R5b")
    p = "ACCCCGCATTACGTTTGGTGGACC"
    assert grade(spark, p, at((12, "A"), q=p), "probe", True) == ("indeterminate", "R9")
    assert grade(spark, p, at((12, "A"), q=p), "probe", False) == ("tolerated", "R9")
    assert grade(spark, p, "ACCCCGC-TTACGTTTGGTGGACC", "probe") == ("at_risk", "R5c")


def test_pair_rule(spark):
    fails = lambda a, b: one(spark, grading.pair_fails(F.lit(a), F.lit(b)))
    assert fails(3, 2) and fails(1, 4) and fails(4, 1)
    assert not fails(3, 1) and not fails(2, 2)


def test_reach(spark):
    floor = lambda e: one(spark, specificity.score_floor(F.lit(0.711), F.lit(1.374), F.lit(811905916.0), F.lit(float(e))))
    assert [floor(e) for e in (1000, 10000, 100000)] == [10, 8, 7]
    always = lambda n, f: one(spark, specificity.always_reported(F.lit(n), F.lit(f)))
    assert [always(17, 10), always(17, 8), always(25, 10), always(10, 11)] == [1, 1, 2, -1]


def brute_alignment(q, s):
    """The best score of q in a stretch of s, by trying every stretch with full dynamic programming."""
    best = None
    for a in range(len(s) + 1):
        for b in range(a, len(s) + 1):
            best = max(best, global_score(q, s[a:b])) if best is not None else global_score(q, s[a:b])
    return best


def global_score(q, s):
    low = -(10**9)
    m = [[low] * (len(s) + 1) for _ in range(len(q) + 1)]
    x, y = ([r[:] for r in m] for _ in range(2))
    m[0][0] = 0
    for i in range(len(q) + 1):
        for j in range(len(s) + 1):
            if i and j:
                m[i][j] = max(m[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1]) + (1 if q[i - 1] == s[j - 1] else -3)
            if i:
                x[i][j] = max(m[i - 1][j] - 7, x[i - 1][j] - 2, y[i - 1][j] - 7)
            if j:
                y[i][j] = max(m[i][j - 1] - 7, y[i][j - 1] - 2, x[i][j - 1] - 7)
    return max(m[-1][-1], x[-1][-1], y[-1][-1])


def test_semi_global():
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("AACGT") for _ in range(n))
    pairs = [("ACGTAC", "TTACGTACTT"), ("ACGTACGT", "TACGTTACGTA"), ("AAACCC", "AAATCCC"), ("ACGTTTGACCA", "GGACGTTGACCAG"), ("ACGT", "T"), ("ACG", ""), *[(dna(rng.randint(1, 8)), dna(rng.randint(0, 12))) for _ in range(60)]]
    for (q, s), (q_aln, s_aln, start, end, score) in zip(pairs, kernels.semi_global(pairs), strict=True):
        assert q_aln.replace("-", "") == q and s_aln.replace("-", "") == s[start:end] and len(q_aln) == len(s_aln)
        assert score == brute_alignment(q, s)
    assert kernels.semi_global([("ACGT", "ACGTTACGT"), ("", "ACG")]) == [("ACGT", "ACGT", 0, 4, 4), ("", "", 0, 0, 0)]  # the leftmost of equal ends
    assert kernels.semi_global([("ACGTRN", "ACGTAC")])[0][4] == 6  # codes that share a base match
    # Seven bases pair on either side of what the window lacks (a gap of two costs 9, four mismatches 12) or has too much.
    assert kernels.semi_global([("GACCTGAGTCATTGCAGG", "TTGACCTGATCATTGCAGGTT")])[0][:2] == ("GACCTGAGTCATTGCAGG", "GACCTGA-TCATTGCAGG")
    assert kernels.semi_global([("GACCTGAGTCATTGCAGG", "TTGACCTGACCGTCATTGCAGGTT")])[0][:2] == ("GACCTGA--GTCATTGCAGG", "GACCTGACCGTCATTGCAGG")


def brute_identity(region, fragment, offset, band):
    """Every banded path, by recursion on (score, matches)."""
    first, last = max(0, -offset), min(len(fragment), len(region) - offset)
    if last <= first:
        return 0.0

    @functools.cache
    def best(i, j):
        if not 0 <= j <= len(region) or abs(j - i - offset) > band:
            return (-(10**6), 0)
        if i == first:
            return (0, 0)
        same = fragment[i - 1] == region[j - 1] != "N" if j else False
        a, b = best(i - 1, j - 1) if j else (-(10**6), 0), best(i - 1, j)
        found = [(a[0] + (1 if same else -1), a[1] + same), (b[0] - 2, b[1])]
        if j and abs(j - 1 - i - offset) <= band:
            c = best(i, j - 1)
            found.append((c[0] - 2, c[1]))
        return max(found)

    return round(max(best(last, j) for j in range(len(region) + 1))[1] / (last - first), 3)


def test_identities():
    rng = random.Random(6)
    dna = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    rows = [("TTACGTACGTAA", "ACGTACGT", 2, 3), ("", "ACG", 0, 3), ("ACG", "ACG", 9, 3)]
    for _ in range(80):
        f = dna(rng.randint(1, 15))
        rows.append((dna(rng.randint(0, 6)) + f[: len(f) // 2] + dna(rng.randint(0, 2)) + f[len(f) // 2 :] + dna(rng.randint(0, 6)), f, rng.randint(-5, 9), rng.choice((2, 5))))
    assert kernels.identities(rows) == [brute_identity(*r) for r in rows]


def test_run_length():
    assert kernels.run_length("ACGTTTTTGCA", "CCACGTTTTGCACC") == (-1, 3, "ACGTTTTTGCA", "ACG-TTTTGCA", 2, 12)
    assert kernels.run_length("ACGTTTTGCA", "CCACGTTTTTTGCACC") == (2, 3, "ACG--TTTTGCA", "ACGTTTTTTGCA", 2, 14)
    assert kernels.run_length("ACGTTTTGCA", "ACGTGCA") is None  # a run keeps two bases
    assert kernels.run_length("ACGTTTTGCA", "ACGTTGCA")[0] == -2
    assert kernels.run_length("ACGNNNNGCA", "ACGNNNGCA") is None  # a run of an ambiguous code is none
    assert kernels.run_length("ACGTTTGCA", "ACGTTGCA") is None  # nor one of three bases
    assert kernels.run_length("AAAACGTTTT", "AAACGTTTTAAAAACGTTTT")[0] == -1  # shorter before longer
    assert kernels.run_length("ACGTGCA", "TT") is None


def test_chosen_alignment(spark):
    rows = spark.createDataFrame([(1, "ACGGTTTTTGCA", "CCACGGTTTTGCACC"), (2, "ACGGTTTTTGCA", "CCACGGTTTTTGCACC"), (3, "ACGGTTTTTGCA", None), (4, "ACGGTTTTTGCA", "CCACGGTTTTGGACC")], "k int, oligo_seq string, window string")
    got = {r.k: r for r in alignment.chosen(rows).collect()}
    assert (got[1].q_aln, got[1].s_aln, got[1].run_base, got[1].run_change) == ("ACGGTTTTTGCA", "ACGG-TTTTGCA", "T", "5->4")
    assert (got[2].s_aln, got[2].run_base) == ("ACGGTTTTTGCA", None) and got[3].q_aln is None and got[4].run_base is None
    shorter = alignment.run_length(rows).orderBy("k").collect()
    assert [r.shift for r in shorter] == [-1, None, None, None]


def test_chains():
    assert kernels.chains([(0, 10, 5), (6, 16, 5), (0, 100, 4)]) == [[0, 1], [2]]
    assert kernels.chains([(0, 10, 20), (10, 40, 20), (40, 400, 20)], 150, 100) == [[0, 1], [2]]  # groups
    assert kernels.chains([(0, 0, 10), (20, 220, 30), (30, 30, 10)], 150) == [[1], [0, 2]]  # diagonals 200 apart; the longer first
    assert kernels.chains([(0, 0, 10), (5, 5, 10)], 150) == [[0, 1]]
    assert kernels.chains([]) == []


def test_other_kernels():
    assert kernels.find_sites("ACG", "ACGTTCGN", 0) == [("+", 0, 0), ("-", 1, 0)]
    seqs = ["ACGTTCGN", "", "AC", "GACG", "NNACGTACG", "TTCGTT"]
    got = kernels.find_sites_in([("a", "ACG"), ("b", "TTC")], seqs, 1)
    want = [(k, n, *x) for n, o in (("a", "ACG"), ("b", "TTC")) for k, s in enumerate(seqs) for x in kernels.find_sites(o, s, 1)]
    assert sorted(got) == sorted(want)
