import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from amplispark.llm import divergence as dv

SCHEMA = "doc_id long, lang string, source string, text string, item string, rank int"


def brute_force(docs, least, shown=10):
    """docs: (lang, source, text)."""
    held, among = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        held[lang or "", source or ""].update(words)
        among[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in held}:
        kept = sorted(w for w, n in among[lang].items() if n >= least)
        of = lambda counts: {w: 1 + 10**9 * (counts[w] + 2) // (sum(counts[x] for x in kept) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        own = {s: of(c) for (g, s), c in held.items() if g == lang}
        whole = of(sum((c for (g, _), c in held.items() if g == lang), Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in own.items():
            pairs = sorted((-sum(f(p[w], q[w]) for w in kept), o.encode(), o) for o, q in own.items() if o != s)
            terms = sorted((-f(p[w], whole[w]), w.encode(), w) for w in kept if held[lang, s][w] and p[w] > whole[w])[:shown]
            out += [(lang, s, part, o, -v, r + 1) for part, rows in (("pair", pairs), ("term", terms)) for r, (v, _, o) in enumerate(rows)]
    return sorted(out)


def audited(spark, docs, parts=4, **kw):
    df = spark.createDataFrame([(i, *d, "x", 9) for i, d in enumerate(docs)], SCHEMA).repartition(parts)
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in dv.audit(df, **kw).collect())


def some_docs(n=400, sources=11, seed=0):
    rng = random.Random(seed)
    words = [a + b for a in ("ab", "Cd", "é", "日本", "x y", "z") for b in ("", "a", "B", "ßß", "q1q", "_r", "\U0001f600")]
    docs = []
    for _ in range(n):
        s = 0 if rng.random() < 0.35 else rng.randrange(sources)
        docs.append((rng.choice(["en", "de", None]), f"s{s}", " ".join(rng.choice(words[s % 7 :]) for _ in range(rng.randrange(30)))))
    docs += [("en", "empty", None), ("en", "empty", ""), ("en", None, "!!! 123"), (None, None, None), ("fr", "a", "rare words"), ("fr", "b", None), ("fr", "c", "other"), ("xx", "alone", "one")]
    return docs + docs[:40]


@pytest.mark.parametrize("kw", [{}, {"cell": 7, "block": 3, "per_pass": 2}, {"cell": 3, "block": 1, "per_pass": 5}, {"shown": 2, "block": 4, "per_pass": 1}])
def test_equals_brute_force(spark, kw):
    docs = some_docs()
    assert audited(spark, docs, least=10, **kw) == brute_force(docs, 10, kw.get("shown", 10))


def test_other_least(spark):
    docs = some_docs(60, 4, seed=1)
    assert audited(spark, docs, least=1, cell=5) == brute_force(docs, 1)
    assert {r[2] for r in audited(spark, docs, least=1000)} == {"pair"}


def test_empty(spark):
    assert audited(spark, []) == [] and audited(spark, [("en", "a", "b " * 50)], least=1) == []


def test_counts_beyond_64_bits_stay_exact():
    counts, n, v = np.array([0, 3, 10**10, 4 * 10**17], np.int64), 5 * 10**17, 1000
    assert dv.shares(counts, n, v).tolist() == [1 + 10**9 * (int(c) + 2) // (n + 2 * v) for c in counts]


def test_vectors_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 500):
        ids, counts = np.sort(rng.choice(4096, n, replace=False)), rng.integers(1, 2**40, n)
        got = dv.unpacked(dv.packed(ids, counts))
        assert got[0].tolist() == ids.tolist() and got[1].tolist() == counts.tolist()


def test_every_two_blocks_meet_once(spark):
    for n in (1, 2, 5, 8):
        blocks = spark.createDataFrame([("en", 0, b, n) for b in range(n)], "lang string, cell long, block int, blocks int")
        met = [tuple(sorted((r.home, r.block))) for first in range(0, n, 3) for r in dv.rotation(blocks, first, first + 3).where("round >= 0").collect()]
        assert sorted(met) == [(i, j) for i in range(n) for j in range(i, n)]
