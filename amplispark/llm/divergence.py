"""Audit of how the sources of a language differ, by systolic rotation.

A group is the documents of one (lang, source). Its vector has a number for each
kept term of the language, p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)), and
two vectors differ at a term by f = floor((p - q)**2 / (p + q)).

1. Terms are counted in the tasks that read the texts; only counts are shuffled. A
   language keeps the V terms that ``least`` of its documents hold.
2. A language's terms are dealt over cells of about ``CELL`` terms, and numbered in
   their cell. A group's part of a cell is one compressed vector: term numbers as
   differences, and counts. While it is made, a heap of the task ranks its terms
   against the whole language.
3. Sources are dealt over blocks of about ``BLOCK``. In a cell the blocks play a
   round-robin tournament: in round r block i meets block (r - i) mod blocks. One
   of the two stays where it is, the vectors of the other come by, one at a time, in
   the order of the rounds; a meeting gives the numbers of both directions.
   ``ROUNDS`` rounds share a shuffle, and each such pass is written.
4. The numbers of a pair are added up over cells.

A vector holds what a group's terms are, so a meeting costs the two groups' terms in
the cell, and the terms that neither has are one product. All arithmetic is in whole
numbers. No task holds more than a block of vectors of one cell.

Defined cases: null text, lang or source is the empty string; repeated rows each
count as a document; a group without kept terms has its pairs (value 0 if its
language keeps no term) and no term rows; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amplispark.llm.common import Workspace, table

LEAST = 10
SHOWN = 10
CELL = 4096
BLOCK = 32
ROUNDS = 16
UNIT = 10**9
#: Terms that a task counts before it hands its counts on.
_HELD = 400_000
#: A-Z to a-z, other letters and all bytes of other scripts as they are, the rest of ASCII to white space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text) rows: occurrences and documents, in parts to be added up; every group has a row with the empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                words = [b"", *terms]
                counts = np.array([(0, 0), *terms.values()], np.int64)
                n = len(words)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts[:, 0]), pa.array(counts[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, b.column(2), strict=True):
                terms = held.setdefault((lang, source), {})
                own: dict[bytes, int] = {}
                for w in (text.as_py() or b"").translate(_LETTERS).split():
                    own[w] = own.get(w, 0) + 1
                before = len(terms)
                for w, n in own.items():
                    if (c := terms.get(w)) is None:
                        terms[w] = [n, 1]
                    else:
                        c[0] += n
                        c[1] += 1
                size += len(terms) - before
                if size > _HELD:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    taken = docs.select(text("lang").alias("lang"), text("source").alias("source"), F.col("text").cast("binary").alias("text"))
    return taken.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """p of each count."""
    if counts.max(initial=0) + 2 < 2**63 // UNIT:
        return 1 + UNIT * (counts + 2) // (n + 2 * v)
    return np.array([1 + UNIT * (int(c) + 2) // (n + 2 * v) for c in counts], np.int64)


def apart(p, q):
    """f of numbers or arrays of up to 10**9 + 1."""
    return (p - q) ** 2 // (p + q)


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A vector of ascending term numbers and their counts."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<i4").tobytes() + counts.astype("<i8").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<i4", n).astype(np.int64)), np.frombuffer(raw, "<i8", n, 4 * n)


def vectors(kept: DataFrame, shown: int) -> DataFrame:
    """(lang, cell, source, total, v, width, data, top) of (lang, cell, source, total, v, lang_total, width, entries) rows.

    ``entries`` are structs of a term's number, its count in the group and in the
    language; ``top`` has the ``shown`` first terms of p > q with their value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, tops = [], []
            for entries, total, v, lang_total in zip(b.column("entries"), *(b.column(c).to_pylist() for c in ("total", "v", "lang_total")), strict=True):
                own = entries.values
                ids, counts, whole = (np.asarray(own.field(k).to_numpy(False), np.int64) for k in range(3))
                order = np.argsort(ids)
                ids, counts, whole = ids[order], counts[order], whole[order]
                p, q = shares(counts, total, v), shares(whole, lang_total, v)
                at = np.flatnonzero(p > q)
                best = heapq.nsmallest(shown, zip((-apart(p, q)[at]).tolist(), ids[at].tolist(), strict=True))
                tops.append([{"id": i, "value": -f} for f, i in best])
                data.append(packed(ids, counts))
            columns = [b.column(c) for c in ("lang", "cell", "source", "total", "v", "width")]
            top = pa.array(tops, pa.list_(pa.struct([("id", pa.int32()), ("value", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary()), top], names=["lang", "cell", "source", "total", "v", "width", "data", "top"])

    schema = "lang string, cell long, source string, total long, v long, width long, data binary, top array<struct<id:int,value:long>>"
    return kept.mapInArrow(run, schema)


class Residents:
    """The vectors of a block in one cell, which stay while others come by."""

    def __init__(self, v: int, width: int):
        self.v, self.width = v, width
        self.sources: list[str] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.totals: list[int] = []
        self.ready = False

    def take(self, source: str, total: int, data: bytes) -> None:
        ids, counts = unpacked(data)
        self.sources.append(source)
        self.totals.append(total)
        self.parts.append((ids, shares(counts, total, self.v)))

    def _settle(self) -> None:
        sizes = np.array([len(i) for i, _ in self.parts])
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.ids, self.p = np.concatenate([i for i, _ in self.parts]), np.concatenate([p for _, p in self.parts])
        self.none = np.array([shares(np.zeros(1, np.int64), t, self.v)[0] for t in self.totals])  # p of a term that the group lacks
        self.none_of = np.repeat(self.none, sizes)
        self.q, self.there = np.zeros(self.width + 1, np.int64), np.zeros(self.width + 1, bool)
        self.ready = True

    def _sums(self, x: np.ndarray) -> np.ndarray:
        """Sums of numbers of all residents' terms by resident."""
        return np.diff(np.concatenate([[0], np.cumsum(x)])[self.starts])

    def meet(self, total: int, data: bytes) -> np.ndarray:
        """What each resident and the vector that comes by differ by, over all terms of the cell."""
        if not self.ready:
            self._settle()
        ids, counts = unpacked(data)
        q, lacks = shares(counts, total, self.v), shares(np.zeros(1, np.int64), total, self.v)[0]
        self.q[:], self.there[:] = lacks, False
        self.q[ids], self.there[ids] = q, True
        at = self.q[self.ids]
        own = self._sums(apart(self.p, at))
        both = self.there[self.ids]
        # Terms of the visitor alone are all of the visitor's without those that the resident has too.
        visitor = np.array([int(apart(p, q).sum()) for p in self.none.tolist()]) - self._sums(np.where(both, apart(self.none_of, at), 0))
        neither = self.width - self.sizes - len(ids) + self._sums(both.astype(np.int64))
        return own + visitor + neither * apart(self.none, lacks)


def meetings(dealt: DataFrame) -> DataFrame:
    """(lang, source, item, value) in both directions: rows of a (lang, cell, home) stand together, residents (round -1) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, residents, found = None, None, []
        for b in batches:
            for lang, cell, home, turn, block, source, total, v, width, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if here != (lang, cell, home):
                    here, residents = (lang, cell, home), Residents(v, width)
                if turn < 0:
                    residents.take(source, total, data)
                elif residents.sources:
                    values = residents.meet(total, data).tolist()
                    for other, value in zip(residents.sources, values, strict=True):
                        if block != home or source < other:  # inside a block each pair meets once as well
                            found += [(lang, other, source, value), (lang, source, other, value)]
                if len(found) > 10_000:
                    yield _batch(found)
                    found = []
        if found:
            yield _batch(found)

    keys = ["lang", "cell", "home"]
    rows = dealt.select(*keys, "round", "block", "source", "total", "v", "width", "data")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "round", "source").mapInArrow(run, "lang string, source string, item string, value long")


def _batch(rows: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 3 + [pa.int64()], strict=True)], names=["lang", "source", "item", "value"])


def rotation(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """(lang, cell, home, round, ...) of the rounds from ``first`` to before ``last``: block i and block (round - i) mod blocks meet at one of the two."""
    i, n = F.col("block"), F.col("blocks")
    rounds = F.sequence(F.lit(first), F.least(F.lit(last), n).cast("int") - 1)
    travelling = blocks.where(n > first).withColumn("round", F.explode(rounds)).withColumn("other", F.pmod(F.col("round") - i, n).cast("int"))
    # Of the two the smaller number is the home of even sums and the larger of odd ones, so that homes have about the same work.
    home = F.when((i + F.col("other")) % 2 == 0, F.least(i, F.col("other"))).otherwise(F.greatest(i, F.col("other")))
    travelling = travelling.withColumn("home", home).where((F.col("home") != i) | (F.col("other") == i)).drop("other")
    staying = blocks.where(n > first).withColumns({"round": F.lit(-1), "home": i})
    return staying.unionByName(travelling)


def audit(docs: DataFrame, least: int = LEAST, shown: int = SHOWN, cell: int = CELL, block: int = BLOCK, per_pass: int = ROUNDS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its language, and in which terms from the language."""
    spark = docs.sparkSession
    ws = Workspace(spark, "divergence")
    counts = ws.save(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups = ws.save(counts.select("lang", "source").distinct())
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= least)
    terms = ws.save(terms.select("lang", "term", "whole"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_total"))
    numbered = terms.join(langs, "lang").withColumn("cell", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / cell)))
    of_cell = Window.partitionBy("lang", "cell")
    # Dealt anew by cell: left where the join has put it, a language would be numbered by one task.
    numbered = numbered.repartition("lang", "cell").withColumn("id", F.row_number().over(of_cell.orderBy("term")) - 1).withColumn("width", F.count("*").over(of_cell))
    numbered = ws.save(numbered)
    present = ws.save(counts.where("term <> ''").join(numbered, ["lang", "term"]).select("lang", "source", "cell", "id", "n", "whole"))
    totals = groups.join(present.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    totals = totals.join(sizes, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"))
    totals = ws.save(totals)
    # A group has a vector in every cell of its language, also where it has none of the terms.
    cells = numbered.groupBy("lang", "cell").agg(F.first("v").alias("v"), F.first("lang_total").alias("lang_total"), F.count("*").alias("width"))
    entries = present.groupBy("lang", "source", "cell").agg(F.collect_list(F.struct("id", "n", "whole")).alias("entries"))
    none = F.array().cast("array<struct<id:int,n:long,whole:long>>")
    every = totals.join(cells, "lang").repartition("lang", "source", "cell").join(entries, ["lang", "source", "cell"], "left").withColumn("entries", F.coalesce("entries", none))
    made = ws.save(vectors(every.select("lang", "cell", "source", "total", "v", "lang_total", "width", "entries"), shown))
    blocks = made.drop("top").join(totals.select("lang", "source", "block", "blocks"), ["lang", "source"])
    rounds = totals.agg(F.max("blocks")).first()[0] or 0
    passes = [ws.save(meetings(rotation(blocks, first, first + per_pass)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))) for first in range(0, rounds, per_pass)]
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = made.select("lang", "source", "cell", F.explode("top").alias("t")).select("lang", "source", "cell", "t.id", "t.value")
    out = out.join(numbered.select("lang", "cell", "id", F.col("term").alias("item")), ["lang", "cell", "id"])
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    # Languages without kept terms have no vectors; their pairs are all 0.
    bare = totals.join(langs.select("lang"), "lang", "left_anti")
    pairs = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    for p in passes:
        pairs = pairs.unionByName(p)
    pairs = pairs.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(out)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}),
l AS (SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.c, 0) AS c, 1 + ({UNIT} * (coalesce(c.c, 0) + 2)::HUGEINT) // (t.n + 2 * l.v) AS p, 1 + ({UNIT} * (k.c + 2)::HUGEINT) // (l.n + 2 * l.v) AS q
  FROM t JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= {SHOWN}
"""

QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {"op13_source_divergence": ORACLE}
