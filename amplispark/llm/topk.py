"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are cut into ``slices`` of components; a node is one slice of one
partition, and its local scores are the inner products over that slice.

1. Every node gathers, for each query, its k best local scores; their vectors'
   whole scores give a cutoff c: the k-th best of them can only be beaten.
2. The cutoff is sent to all nodes. A vector of whole score c or more has at
   least c / slices in one slice at least, whatever the signs, so each node
   collects the entries from there on.
3. What was collected is resolved to whole scores, and the best k of each
   partition meet in the answer.

Queries are numbered and dealt by number, whatever their ids, into passes of
about ``per_pass``, the only thing that is collected and sent out; a pass reads
the vectors twice, shuffles k rows for each query and partition, and is written
before the next begins.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; scores are of vectors with as many components
as the query; rows with the query's id are its own and never candidates; repeated
candidates each count; ties go to the smaller id; an empty table gives an empty
result; other columns are not read. Scores beyond 64 bits stand at the bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amplispark.llm.common import Workspace, table

SCALE = 1024
_ROWS = 2048
_EXACT = 2.0**53
_LONGEST = 2**63 - 1


@dataclass
class Queries:
    """The queries of one pass that have the same number of components."""

    numbers: np.ndarray
    ids: np.ndarray
    whole: np.ndarray  # queries x components, whole numbers as doubles


def whole_vectors(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Number of components -> (ids, floor(1024 * x) as doubles) of the vectors that take part."""
    keep = ids.is_valid().to_numpy(False) & vectors.is_valid().to_numpy(False)
    ids, vectors = ids.filter(pa.array(keep)), vectors.filter(pa.array(keep))
    sizes = vectors.value_lengths().to_numpy(False)
    flat = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(False), np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    numbers = np.asarray(ids.to_numpy(False), np.int64)
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        x = flat[starts[rows][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(axis=1)
        out[d] = (numbers[rows][fine], np.floor(SCALE * x[fine]))
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, vectors x queries: in doubles where every sum fits, else in integers of any size."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1])
    if most < _EXACT:
        return x @ q.T
    as_ints = lambda m: np.array([[int(c) for c in row] for row in m.tolist()], object).reshape(m.shape)
    return as_ints(x) @ as_ints(q).T


class Best:
    """The k best (score, id) so far of each query, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        have = self.rows.get(query)
        if have is not None:
            scores, ids = np.concatenate([have[0], scores]), np.concatenate([have[1], ids])
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k]
        self.rows[query] = (scores[order], ids[order])

    def batch(self) -> pa.RecordBatch | None:
        rows = [(q, int(i), max(-_LONGEST - 1, min(_LONGEST, int(s)))) for q, (scores, ids) in self.rows.items() for s, i in zip(scores, ids, strict=True)]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query", "vec_id", "score"])


def local(x: np.ndarray, ids: np.ndarray, queries: Queries, cutoffs: np.ndarray | None, k: int, slices: int, best: Best) -> None:
    """Adds what the vectors of one partition have to say: phase 1 without cutoffs, phases 2 and 3 with them."""
    bounds = np.linspace(0, x.shape[1], slices + 1).astype(int)
    parts = [products(x[:, a:b], queries.whole[:, a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    own = ids[:, None] == queries.ids[None, :]
    if cutoffs is None:
        chosen = np.zeros(own.shape, bool)
        for p in parts:
            top = np.argpartition(np.where(own, -np.inf, p.astype(np.float64)), max(0, len(ids) - k), axis=0)[-k:]
            np.put_along_axis(chosen, top, True, axis=0)
    else:
        chosen = np.any([slices * p >= cutoffs[None, :] for p in parts], axis=0)
    chosen &= ~own
    for n in np.flatnonzero(chosen.any(axis=0)).tolist():
        at = np.flatnonzero(chosen[:, n])
        scores = sum(p[at, n] for p in parts)
        if cutoffs is not None:
            at, scores = at[scores >= cutoffs[n]], scores[scores >= cutoffs[n]]
        if len(at) > 4 * k:  # only scores from the k-th best on can stay
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= least], scores[scores >= least]
        if len(at):
            best.add(int(queries.numbers[n]), scores, ids[at])


def _phase(vectors: DataFrame, queries: dict[int, Queries], cutoffs: dict[int, int] | None, k: int, slices: int) -> DataFrame:
    """(query, vec_id, score), k rows at most for each query and partition."""
    sent = vectors.sparkSession.sparkContext.broadcast((queries, cutoffs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, cutoffs = sent.value
        best = Best(k)
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                b = whole.slice(at, _ROWS)
                for d, (ids, x) in whole_vectors(b.column(0), b.column(1)).items():
                    if d in queries and len(ids):
                        q = queries[d]
                        least = None if cutoffs is None else np.array([cutoffs.get(int(n), -np.inf) for n in q.numbers])
                        local(x, ids, q, least, k, slices, best)
        if (out := best.batch()) is not None:
            yield out

    return vectors.mapInArrow(run, "query long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 10, slices: int = 2, per_pass: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that the Column ``is_query`` names."""
    spark = vectors.sparkSession
    asked = vectors.where(is_query)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    asked = asked.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    ws = Workspace(spark, "top-k")
    asked = ws.save(asked.withColumn("_n", F.monotonically_increasing_id()))
    passes = max(1, math.ceil(asked.count() / per_pass))
    answers = []
    for n in range(passes):
        got = asked.where(F.pmod(F.xxhash64("_n"), F.lit(passes)) == n).toArrow().combine_chunks()
        queries, numbered, first = {}, [], 0
        column = lambda c: got.column(c).combine_chunks() if got.num_rows else pa.array([], got.schema.field(c).type)  # noqa: E731, B023
        for d, (ids, x) in whole_vectors(column("vec_id"), column("embedding")).items():
            queries[d] = Queries(np.arange(first, first + len(ids)), ids, x)
            numbered += [(first + i, int(q)) for i, q in enumerate(ids)]
            first += len(ids)
        gathered = _ranked(_phase(rows, queries, None, k, slices), k)
        cutoffs = {r["query"]: r["score"] for r in gathered.where(F.col("rank") == k).select("query", "score").collect()}
        found = _ranked(_phase(rows, queries, cutoffs, k, slices), k)
        names = spark.createDataFrame(numbered, "query long, query_id long")
        answer = found.join(F.broadcast(names), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        answers.append(ws.write(answer))
    return spark.read.schema(answer.schema).parquet(*answers)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

QUERIES = {"op5_exact_topk": op5_exact_topk}
ORACLES = {"op5_exact_topk": ORACLE}
