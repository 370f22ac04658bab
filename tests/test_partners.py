"""The partner scan against nested loops over anchors and oligos."""

import random

import pytest

from amplispark.functions import kernels
from amplispark.operators import partners

RC = kernels.reverse_complement
ANCHOR = "tier string, accession string, site_id long, role string, oligo string, orientation string, s_start long, s_end long, level string"


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def changed(rng, s, n):
    s = list(s)
    for i in rng.sample(range(len(s)), n):
        s[i] = rng.choice("ACGTN".replace(s[i], ""))
    return "".join(s)


def measured(q, s):
    marks = "".join("g" if "-" in (a, b) else "m" if a == b else "x" for a, b in zip(q, s, strict=True))
    mm, gaps = marks.count("x"), marks.count("g")
    clean = len(marks) - len(marks.rstrip("m"))
    level = "critical" if mm <= 3 and gaps == 0 and clean >= 5 else "warning" if mm <= 5 and gaps <= 1 and clean >= 3 else "minor"
    return mm, gaps, clean, level


def brute_force(anchors, seqs, oligos, known, reach, budget):
    rank = {"critical": 0, "warning": 1, "minor": 2}
    taken = [(k[0], k[1], k[2], k[3], k[4], k[5]) for k in known]
    out, states, left = [], {}, budget if budget is not None else len(anchors)
    for tier, accession, site_id, role, _, orientation, start, end, level in sorted(anchors, key=lambda a: (rank[a[8]], a[2])):
        if accession == "unknown" or accession is None:
            states[site_id] = "no_accession"
            continue
        if left <= 0:
            states[site_id] = "not_scanned"
            continue
        left -= 1
        s = seqs.get(accession) or ""
        lo, hi = (start + 1, min(start + reach - 1, len(s))) if orientation == "+" else (max(1, end - reach + 1), min(end, len(s)) - 1)
        part = s[lo - 1 : hi] if hi >= lo else ""
        states[site_id] = "scanned" if part else "failed"
        facing = "-" if orientation == "+" else "+"
        for name in sorted({o[0] for o in oligos if o[1] != role}):
            best = None
            for o, r, variant in sorted(oligos):
                if o != name or r == role or len(part) < len(variant):
                    continue
                window = RC(part) if facing == "-" else part
                ((q, t, a, b, _score),) = kernels.semi_global([(variant, window)])
                x, y = (lo + len(part) - b, lo + len(part) - a - 1) if facing == "-" else (lo + a, lo + b - 1)
                mm, gaps, clean, level_ = measured(q, t)
                faces = (start < x and end < y) if orientation == "+" else (x < start and y < end)
                if level_ != "minor" and faces:
                    key = (mm + gaps, -clean, variant)
                    best = (key, x, y, mm, gaps, clean, level_) if best is None or key < best[0] else best
            if best and not any(k[:4] == (tier, accession, name, facing) and k[4] <= best[2] and best[1] <= k[5] for k in taken):
                taken.append((tier, accession, name, facing, best[1], best[2]))
                out.append((tier, accession, name, facing, site_id, *best[1:]))
    return sorted(out), states


@pytest.mark.parametrize(("seed", "reach", "budget"), [(0, 2000, None), (1, 150, None), (2, 300, 9), (3, 90, 4), (4, 400, None)])
def test_equals_nested_loops(spark, seed, reach, budget):
    rng = random.Random(seed)
    forward, reverse, other = dna(rng, 20), dna(rng, 24), dna(rng, 18)
    oligos = [("f", "forward", forward), ("r", "reverse", reverse), ("r", "reverse", changed(rng, reverse, 1).replace("N", "A")), ("r2", "reverse", other)]
    seqs, anchors, known = {}, [], []
    for n in range(14):
        parts, length, accession = [], 0, f"acc{n}"
        for _ in range(rng.randrange(4, 12)):
            kind = rng.randrange(6)
            piece = [dna(rng, rng.randrange(5, 60)), changed(rng, forward, rng.randrange(4)), RC(changed(rng, reverse, rng.randrange(5))), changed(rng, reverse, 1), RC(forward), RC(other[:8] + other[9:])][kind]
            if kind in (1, 2, 4) and rng.random() < 0.6:
                role, strand = {1: ("forward", "+"), 2: ("reverse", "-"), 4: ("forward", "-")}[kind]
                anchors.append((rng.choice(["near", "far"]), accession, len(anchors), role, role[0], strand, length + 1, length + len(piece), rng.choice(["critical", "warning"])))
                if rng.random() < 0.8:
                    known.append((anchors[-1][0], accession, role[0], strand, length + 1, length + len(piece)))
            parts.append(piece)
            length += len(piece)
        seqs[accession] = "".join(parts)
    anchors += [("near", "unknown", 900, "forward", "f", "+", 1, 20, "critical"), ("near", None, 901, "forward", "f", "+", 1, 20, "warning"), ("near", "gone", 902, "reverse", "r", "-", 5, 28, "critical"), ("near", "acc0", 903, "forward", "f", "+", len(seqs["acc0"]), len(seqs["acc0"]), "warning")]
    want, states = brute_force(anchors, seqs, oligos, known, reach, budget)
    a, contigs = spark.createDataFrame(anchors, ANCHOR), spark.createDataFrame(list(seqs.items()), "accession string, seq string")
    o = spark.createDataFrame(oligos, "oligo string, role string, oligo_seq string")
    k = spark.createDataFrame(known, "tier string, accession string, oligo string, orientation string, s_start long, s_end long")
    got = partners.partner_scan(a, contigs, o, k, reach, budget).collect()
    assert sorted((r.tier, r.accession, r.oligo, r.orientation, r.anchor_id, r.s_start, r.s_end, r.mismatches, r.gaps, r.clean3, r.level) for r in got) == want and want
    assert {r.site_id: r.state for r in partners.scanned_anchors(a, contigs, reach, budget).collect()} == states


def test_sites_are_accepted_in_turn(spark):
    rng = random.Random(7)
    rows = [("t", "x", rng.choice("ab"), "+", t, s, s + rng.choice((9, 12))) for t, s in enumerate(rng.randrange(300) for _ in range(200))]
    taken = []
    for r in rows:
        if not any(k[2] == r[2] and k[5] <= r[6] and r[5] <= k[6] for k in taken):
            taken.append(r)
    df = spark.createDataFrame(rows, "tier string, accession string, oligo string, orientation string, turn int, s_start long, s_end long").repartition(5)
    assert sorted(tuple(r) for r in partners.accepted(df).collect()) == sorted(taken)
    assert partners.accepted(df.limit(0)).count() == 0
