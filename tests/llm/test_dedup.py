import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from amplispark.llm import dedup, graphs, shingles
from amplispark.llm.common import Workspace


def brute_force(docs, width):
    """doc_id -> (set size, smallest reachable doc_id), all pairs compared as strings."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    inverse, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            inverse[x].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for o, n in Counter(o for x in s for o in inverse[x] if o < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[o]) - n):
                a, b = find(o), find(i)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, docs, width):
    got = dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=width).collect()
    want = brute_force(docs, width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_driver_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 4)


def test_many_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base, docs = [rng.choice(words) for _ in range(120)], []
    for i in range(260):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        docs.append((i, " ".join(copy)))
    docs += [(1000 + k, " ".join(rng.choice(words) for _ in range(60))) for k in range(40)] + [(2000, "a b c d"), (2001, "A B c D"), (2002, "a b c d e"), (2003, ""), (2004, None)]
    check(spark, docs, 4)


def test_blocks_agree_with_one_block(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    monkeypatch.setattr(dedup, "STAR", 5)
    test_many_near_copies(spark)


def test_sketches_estimate_similarity():
    np.seterr(over="ignore")
    rng = np.random.default_rng(1)
    for size, shared in ((4, 4), (40, 30), (2000, 1000), (5, 4)):
        errors = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 2 * size - shared).astype(np.uint64)
            a, b = np.sort(x[:size]), np.sort(x[size - shared :])
            s = shingles.sketches([a, b], 240)
            assert (s != np.iinfo(np.uint64).max).all()
            errors.append((s[0] == s[1]).mean() - shared / (2 * size - shared))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graphs.components(edges, Workspace(spark, "t")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100}
    assert graphs.components(edges.where("a < 0"), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("text", ["", None, " \t"])
def test_no_words(text):
    assert len(shingles.shingle_set(text, 4, shingles.WordNumbers())) == 0


def test_stage_keeps_one_of_a_group(spark):
    docs = spark.createDataFrame([(3, "one two three four five six", 1), (2, "one two three four five six", 2), (9, "other words stand here alone now", 3), (9, "other words stand here alone now", 3), (None, "x", 4)], "doc_id long, text string, kept int")
    got = dedup.dedup_stage(docs).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [(r.doc_id, r.kept) for r in got] == [(None, 4), (2, 2), (9, 3)]


def test_links_that_no_smallest_class_has(spark, monkeypatch):
    """Where comparing with the smallest finds nothing, the blocks find all links; and of a hot bucket without links no text is sent."""
    real = dedup.links_with_smallest
    monkeypatch.setattr(dedup, "links_with_smallest", lambda *a: real(*a).where("a < 0"))
    test_many_near_copies(spark)
    rows = [(0, 0, n, n, 100, list(range(40)), bytes([n] * 240)) for n in range(30)]
    assert dedup.wanted_rows(rows, 80) == []
    assert dedup.wanted_rows(rows + [(0, 0, 99, 99, 100, list(range(40)), bytes([3] * 240))], 80) == [3, 30]


def test_of_rows_that_share_an_id_the_same_one_stays(spark):
    docs = [(1, "b c d e f", 1), (1, "a c d e f", 2), (1, None, 3), (2, "z y x w v", 4), (2, "z y x w v", 3)]
    for order in (docs, docs[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, kept int").repartition(3)
        assert sorted((r.doc_id, r.kept) for r in dedup.dedup_stage(df).collect()) == [(1, 3), (2, 3)]


def test_beside_a_large_group_the_blocks_grow_with_the_bucket(spark, monkeypatch):
    """One bucket of a group of 3,000, one of 40 and 60 single classes: every class meets what it may be linked with, in few blocks."""
    monkeypatch.setattr(dedup, "BLOCK", 64)
    comp = lambda i: 0 if i < 3000 else 3000 if i < 3040 else i
    members = spark.createDataFrame([(0, 7, i) for i in range(3100)], "band int, key long, rep long")
    groups = spark.createDataFrame([(i, comp(i)) for i in range(3040)], "node long, component long")
    for sizes, most in ((lambda i: 100, 3100 + 47 * 100 + 100 * 4), (lambda i: 10 ** (1 + i % 3), 60_000)):
        n = spark.createDataFrame([(i, sizes(i)) for i in range(3100)], "rep long, n long")
        rows = dedup.dealt_blocks(members, groups, n, 80).collect()
        assert len(rows) <= most + 3100
        met = defaultdict(lambda: ([], []))
        for r in rows:
            met[r.i, r.j][r.side].append(r.rep)
        pairs = set()
        for (i, j), (a, b) in met.items():
            pairs |= {(min(x, y), max(x, y)) for x in (b if i == j else a) for y in b if x != y}
        wanted = {(x, y) for y in range(3000, 3100) for x in range(y) if comp(x) != comp(y) and 100 * min(sizes(x), sizes(y)) >= 80 * max(sizes(x), sizes(y))}
        assert wanted <= pairs and not any(comp(x) == comp(y) == 0 for x, y in pairs)


def test_stage_with_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4), (1, "z", 5, 6)], "doc_id long, text string, `a.b` int, `c``d` int")
    got = dedup.dedup_stage(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == {(1, "a b c d e f", 1, 2)}
