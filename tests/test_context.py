import random

from amplispark.operators import locate


def test_flanks_confirm_copies(spark):
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    left, fragment, right = dna(120), dna(100), dna(120)
    other = dna(40) + fragment[40:60] + dna(40)
    rows = [
        ("whole", left + fragment + right),
        ("cut", left + fragment[:12]),
        ("past", left[:90]),
        ("divergent", dna(50) + left + other + right),
        ("one side", left + other + dna(120)),
        ("flank only", left + dna(220)),
        ("block only", dna(120) + other + dna(120)),
        ("none", dna(300)),
    ]
    contigs = spark.createDataFrame(rows, "accession string, seq string")
    found = locate.copies(contigs, fragment)
    assert locate.context(found, contigs) == (left, right)
    states = lambda f: {r.accession: r.state for r in locate.classify(f, contigs).collect()}
    assert states(found) == {a: "found" if a == "whole" else "not_found" for a, _ in rows}
    want = {a: "not_found" for a, _ in rows} | {"whole": "found", "divergent": "found", "one side": "found"}  # "cut" and "past" hold no block of the fragment: it is not in the assembly
    with_context = locate.copies(contigs, fragment, left=left, right=right)
    assert states(with_context) == want
    r = with_context.where("accession = 'whole'").first()
    assert (r.start, r.end, r.anchored, r.identity) == (120, 220, 100, 1.0) and min(r.context_left, r.context_right) >= 112
