"""Hard negatives of anchors by bit-sliced integer products.

Components are whole numbers, floor(256 * x), and a row's score is its inner
product with the anchor. A task takes the rows of its partition in blocks and
their components bit-plane by bit-plane, the most significant first. After each
plane a score lies in an interval: what the planes so far give, plus what the
rest can add at least and at most, which is the anchor's negative and its
positive components times the value of the planes to come. A candidate is dropped
once its interval cannot qualify; those left after the last plane have their
exact score.

1. Positives: of the rows with the anchor's label, the first 5. An interval that
   ends below the fifth best score, or below the fifth best lower end, is out.
2. Negatives: of the rows with another label, the first 10 whose score stands in
   the window that a positive's score opens. An interval is out if it misses the
   windows of all positives or ends below the tenth best of each that it meets.

Anchors are numbered and dealt by number into passes, the only thing that is sent
to all tasks; a pass holds at most ``per_pass`` of them and ``_SENT`` components.
A pass reads the rows twice, shuffles k rows a partition for each anchor (or
anchor and positive), and is written before the next begins. A label is never a
shuffle key, so a frequent one does no harm.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; scores are of vectors with as many components as the
anchor's; a row with the anchor's id is never its positive; repeated rows each
count; ties go to the smaller id; an anchor without positives, or whose windows
are empty (they are for a positive score below 0), returns nothing; an empty table
gives an empty result; other columns are not read. Scores beyond 64 bits stand at
the bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amplispark.llm.common import Workspace, table

SCALE = 256
#: Planes of a block that are taken at once for all anchors; from there on each anchor has its own candidates.
LEAD = 3
_ROWS = 2048
_SENT = 8_000_000
_EXACT = 2**53
_LONGEST = 2**63 - 1
_LEAST = -_LONGEST - 1

#: Whether intervals [lo, hi] of candidates of one anchor can still qualify.
Test = Callable[[np.ndarray, np.ndarray], np.ndarray]


def whole_rows(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number of components -> (ids, labels, floor(256 * x) as doubles) of the (vec_id, label, embedding) rows that take part."""
    keep = np.logical_and.reduce([c.is_valid().to_numpy(False) for c in batch.columns])
    ids, labels, vectors = (c.filter(pa.array(keep)) for c in batch.columns)
    sizes = vectors.value_lengths().to_numpy(False)
    flat = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(False), np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    ids, labels = np.asarray(ids.to_numpy(False), np.int64), np.asarray(labels.to_numpy(False), np.int64)
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        x = flat[starts[rows][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.clip(SCALE * x[fine], -np.finfo(np.float64).max, np.finfo(np.float64).max)
        out[d] = (ids[rows][fine], labels[rows][fine], np.floor(x))
    return out


def integers(x: np.ndarray, most: int) -> np.ndarray:
    """Whole doubles as 64-bit integers if sums of up to ``most`` are exact in doubles too, else as integers of any size."""
    if most < _EXACT:
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


def product(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """x @ a.T of what :func:`integers` gives, exact."""
    if x.dtype == object:
        return x.dot(a.T)
    return (x.astype(np.float64) @ a.T.astype(np.float64)).astype(np.int64)


def bounded(scores: np.ndarray) -> np.ndarray:
    """Scores that stand at the bound where they pass 64 bits."""
    return np.clip(scores, _LEAST, _LONGEST).astype(np.int64) if scores.dtype == object else scores


class Sliced:
    """A block of rows, the components cut into bit-planes, against anchors of the same number of components."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        """Rows and anchors are matrices of whole doubles."""
        # Python integers, as the bound itself may pass any fixed width.
        most = 4 * int(np.abs(rows).max(initial=1)) * int(np.abs(anchors).max(initial=1)) * max(1, rows.shape[1])
        self.rows, self.anchors = integers(rows, most), integers(anchors, most)
        largest = max((int(max(self.rows.max(), -1 - self.rows.min())) if self.rows.size else 0), 0)
        self.planes = largest.bit_length()  # below the sign's
        self.down = np.minimum(self.anchors, 0).sum(axis=1)
        self.up = np.maximum(self.anchors, 0).sum(axis=1)
        self.left = max(0, self.planes - LEAD)
        # Sign and leading planes of a number, by two's complement, are the number without its lower bits.
        self.lead = product((self.rows >> self.left) << self.left, self.anchors)

    def scores(self, at: int, candidates: np.ndarray, test: Test) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the candidates of anchor ``at`` whose intervals pass ``test`` after every plane."""
        got, left = self.lead[candidates, at], self.left
        while True:
            rest = (1 << left) - 1
            keep = test(bounded(got + rest * self.down[at]), bounded(got + rest * self.up[at]))
            candidates, got = candidates[keep], got[keep]
            if not left or not len(candidates):
                return candidates, bounded(got)
            left -= 1
            got = got + ((((self.rows[candidates] >> left) & 1) @ self.anchors[at]) << left)


@dataclass
class Anchors:
    """The anchors of one pass that have the same number of components; with positives, their windows of scores too."""

    numbers: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray  # anchors x components, whole numbers as doubles


class Best:
    """The k best (score, id) so far by key, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def least(self, key: tuple[int, int]) -> int:
        """A score below this one cannot be among the k best."""
        have = self.rows.get(key)
        return have[0][-1] if have is not None and len(have[0]) == self.k else _LEAST

    def add(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        have = self.rows.get(key)
        if have is not None:
            scores, ids = np.concatenate([have[0], scores]), np.concatenate([have[1], ids])
        scores = scores.astype(np.int64)
        order = np.lexsort((ids, ~scores))[: self.k]  # ~ turns the order round and cannot overflow
        self.rows[key] = (scores[order], ids[order])

    def batch(self) -> pa.RecordBatch | None:
        rows = [(*key, int(i), int(s)) for key, (scores, ids) in self.rows.items() for s, i in zip(scores, ids, strict=True)]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["anchor", "positive", "vec_id", "score"])


def kth_best(lows: np.ndarray, k: int) -> int:
    """The k-th best lower end: a score below it cannot be among the k best."""
    if len(lows) < k:
        return _LEAST
    return int(np.partition(lows, len(lows) - k)[len(lows) - k])


def gather_positives(block: Sliced, ids: np.ndarray, labels: np.ndarray, anchors: Anchors, k: int, best: Best) -> None:
    for n in range(len(anchors.ids)):
        candidates = np.flatnonzero((labels == anchors.labels[n]) & (ids != anchors.ids[n]))
        key = (int(anchors.numbers[n]), 0)
        held = best.least(key)

        def test(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return hi >= max(held, kth_best(lo, k))  # noqa: B023

        rows, scores = block.scores(n, candidates, test)
        if len(rows):
            best.add(key, scores, ids[rows])


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest negative score n with low * positive <= 100 * n <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def gather_negatives(block: Sliced, ids: np.ndarray, labels: np.ndarray, anchors: Anchors, windows: dict[int, list[tuple[int, int]]], k: int, best: Best) -> None:
    """``windows``: by number of the anchor, the window of each of its positives."""
    for n in range(len(anchors.ids)):
        number = int(anchors.numbers[n])
        if not (own := windows.get(number)):
            continue
        needed = [max(first, best.least((number, p))) for p, (first, _) in enumerate(own)]

        def test(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(lo), bool)
            for (first, last), least in zip(own, needed, strict=True):  # noqa: B023
                surely = (lo >= first) & (hi <= last)
                keep |= (lo <= last) & (hi >= max(least, kth_best(lo[surely], k)))
            return keep

        rows, scores = block.scores(n, np.flatnonzero(labels != anchors.labels[n]), test)
        for p, (_, last) in enumerate(own):
            inside = (scores >= needed[p]) & (scores <= last)
            if inside.any():
                best.add((number, p), scores[inside], ids[rows[inside]])


def _phase(rows: DataFrame, anchors: dict[int, Anchors], windows: dict[int, list[tuple[int, int]]] | None, k: int) -> DataFrame:
    """(anchor, positive, vec_id, score): k rows at most a partition for each anchor, or for each anchor and positive where there are windows."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = sent.value
        best = Best(k)
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                for d, (ids, labels, x) in whole_rows(whole.slice(at, _ROWS)).items():
                    if d in anchors and len(ids):
                        block = Sliced(x, anchors[d].whole)
                        if windows is None:
                            gather_positives(block, ids, labels, anchors[d], k, best)
                        else:
                            gather_negatives(block, ids, labels, anchors[d], windows, k, best)
        if (out := best.batch()) is not None:
            yield out

    return rows.mapInArrow(run, "anchor long, positive long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, per_pass: int = 1024,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best ``positives``, the k best
    rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = vectors.sparkSession
    taken = [F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding")]
    complete = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL"
    rows = vectors.select(*taken)
    ws = Workspace(spark, "hard-negatives")
    asked = ws.save(vectors.where(is_anchor).select(*taken).where(complete).withColumn("_n", F.monotonically_increasing_id()))
    found = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    passes = max(1, math.ceil(found["n"] / max(1, min(per_pass, _SENT // max(1, found["d"] or 1)))))
    answers = []
    for n in range(passes):
        got = asked.where(F.pmod(F.xxhash64("_n"), F.lit(passes)) == n).select("vec_id", "label", "embedding").toArrow()
        anchors, ids_of = {}, []
        for b in got.combine_chunks().to_batches():
            for d, (ids, labels, x) in whole_rows(b).items():
                anchors[d] = Anchors(np.arange(len(ids_of), len(ids_of) + len(ids)), ids, labels, x)
                ids_of += [int(i) for i in ids]
        pairs: list[tuple[int, int, int, int, int]] = []
        windows: dict[int, list[tuple[int, int]]] = {}
        for r in _ranked(_phase(rows, anchors, None, positives), positives).orderBy("anchor", "rank").collect():
            own = windows.setdefault(r["anchor"], [])
            pairs.append((r["anchor"], len(own), ids_of[r["anchor"]], r["vec_id"], r["score"]))
            own.append(window(r["score"], low, high))
        names = spark.createDataFrame(pairs, "anchor long, positive long, anchor_id long, positive_id long, positive_score long")
        best = _ranked(_phase(rows, anchors, windows, k), k)
        answer = best.join(F.broadcast(names), ["anchor", "positive"]).select(  # names: at most per_pass * positives rows
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        answers.append(ws.write(answer))
    return spark.read.schema(answer.schema).parquet(*answers)


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The rows with label (label + 1) % 10 where the id is divisible by 7."""
    return embeddings.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND len(a.e) = len(c.e) AND (a.label <> c.label OR a.vec_id <> c.vec_id)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
) WHERE rank <= 10
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": ORACLE}
