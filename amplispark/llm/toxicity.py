"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; all other training text counts as
unlabelled. With the class prior p, the risk of a classifier is
``p * R(positives as 1) + max(0, R(unlabelled as 0) - p * R(positives as 0))``;
where the second part falls below zero, its gradient is climbed instead, so the
classifier cannot buy a low risk by calling positives negative.

Fitting reads bounded samples of the labelled rows (``n_positive``,
``n_unlabelled``, by hash threshold, texts whole); the class prior is counted
over all labels and the words' shares over all training texts. Every hashed word
that is surely more frequent in the positives is a feature. Several numpy
classifiers on resampled rows are averaged. Scoring reads every text whole.

Defined cases: null and empty texts score as a text without words; repeated rows
count as often as they occur; without positives every score is 0; an empty table
gives an empty result; a document labelled twice is positive if any label is; a
row without doc_id is in no fold (``held_out`` is null), is never learned from
and is scored like any other; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.llm.common import table

BUCKETS = 1 << 20
REMEMBERED = 300_000
_WORDS = re.compile(r"[^\W\d_]+")
#: Standard errors by which a word's share in positives must exceed that in all texts to become a feature, and the share of a rare word.
_SURE, _RARE = 5.0, 0.01


@dataclass
class Model:
    """Averaged linear classifiers over the presence of hashed words."""

    buckets: np.ndarray
    weights: np.ndarray  # classifiers x buckets
    bias: np.ndarray


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def bucket_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def train_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _hashed(texts: DataFrame, kept: np.ndarray | None = None) -> DataFrame:
    """(buckets) of (text) rows, those of its words; with ``kept`` only buckets in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = None if kept is None else _Places(kept)
        for b in batches:
            if places is None:
                found = [sorted({bucket_of(w) for w in words_of(x.as_py())}) for x in b.column(0)]
            else:
                places = places if len(places) <= REMEMBERED else _Places(kept)
                found = [kept[sorted(places.of(x.as_py()))] for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["buckets"])

    return texts.mapInArrow(run, "buckets array<int>")


def document_counts(texts: DataFrame, buckets: np.ndarray) -> tuple[int, np.ndarray]:
    """(texts, how many of them hold a word of each bucket), counted over every row of (text); a task returns one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, n, total = _Places(buckets), 0, np.zeros(len(buckets) + 1, np.int64)
        for b in batches:
            for x in b.column(0):
                places = places if len(places) <= REMEMBERED else _Places(buckets)
                total[list(places.of(x.as_py()))] += 1
            total[-1] += len(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["k", "n"])

    summed = texts.mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(buckets) + 1, np.int64)
    out[summed["k"].to_numpy()] = summed["n"].to_numpy()
    return int(out[-1]), out[:-1]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    unlabelled: DataFrame | None = None,
    n_positive: int = 4000,
    n_unlabelled: int = 12000,
    n_classifiers: int = 3,
    seed: int = 17,
) -> Model:
    """Learns from (doc_id, text) and (doc_id, toxic) rows, which the caller has cut to the training fold.

    ``prior`` is the share of toxic documents; None takes it from the labels.
    The risk of the unlabelled part is that of the labelled documents with
    their labels hidden, toxic ones among them, as the estimator asks for text
    of the whole distribution; ``unlabelled`` (doc_id, text) replaces them,
    where the labels name toxic documents only and the prior is given.
    ``n_positive`` and ``n_unlabelled`` bound the labelled rows that are read.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_toxic, n_known = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    nothing = Model(np.zeros(0, np.int64), np.zeros((1, 0)), np.array([-np.inf]))
    if not n_toxic:
        return nothing
    prior = n_toxic / n_known if prior is None else prior
    scale = 1 << 30
    part = lambda most, n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(scale)) < min(scale, int(scale * most / max(1, n)) + 1)
    # Ids of a bounded sample; of rows that share one the text with the least hash, so that the rows are bounded as well.
    one_text = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows_of = lambda ids: docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(one_text).orderBy("doc_id").select("text")
    positive = _buckets(_hashed(rows_of(known.where((F.col("toxic") == 1) & part(n_positive, n_toxic, 1)).select("doc_id"))))
    if not positive:
        return nothing
    kept = _telling(positive, docs.select("text"))
    if unlabelled is None:
        rest = rows_of(known.where(part(n_unlabelled, n_known, 2)).select("doc_id"))
    else:
        rest = unlabelled.where(part(n_unlabelled, unlabelled.count(), 2)).select("text")
    return _learn([b[np.isin(b, kept)] for b in positive], _buckets(_hashed(rest, kept)), kept, float(prior), n_classifiers, seed)


def _buckets(rows: DataFrame) -> list[np.ndarray]:
    return [np.asarray(r, np.int64) for r in rows.toArrow()["buckets"].to_pylist()]


def _telling(positive: list[np.ndarray], texts: DataFrame) -> np.ndarray:
    """The buckets whose share in the positives exceeds that in all texts by ``_SURE`` standard errors of a rare word's share."""
    seen, n = np.unique(np.concatenate(positive), return_counts=True)
    share, error = n / len(positive), 1 / np.sqrt(len(positive))
    could = share / np.sqrt(_RARE) >= _SURE * error  # those of others could not pass, were they in no text at all
    seen, share = seen[could], share[could]
    total, count = document_counts(texts, seen)
    in_all = count / max(1, total)
    return seen[(share - in_all) / np.sqrt(in_all + _RARE) >= _SURE * error]


def _learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], kept: np.ndarray, prior: float, n_classifiers: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    drawn = lambda rows: Rows.of([rows[i] for i in rng.integers(0, len(rows), len(rows))], kept)
    rest = unlabelled or positive
    fitted = [non_negative_pu(drawn(positive), drawn(rest), prior) for _ in range(n_classifiers)]
    return Model(kept, np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]))


@dataclass
class Rows:
    """Rows of binary features: the row and the column of every one."""

    n: int
    row: np.ndarray
    column: np.ndarray
    width: int

    @classmethod
    def of(cls, buckets: list[np.ndarray], kept: np.ndarray) -> Rows:
        sizes = [len(b) for b in buckets]
        flat = np.concatenate([np.zeros(0, np.int64), *buckets])
        return cls(len(buckets), np.repeat(np.arange(len(buckets)), sizes), np.searchsorted(kept, flat), len(kept))

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def summed(self, g: np.ndarray) -> np.ndarray:
        """Each column's sum of a value per row, with the sum of all behind them."""
        return np.append(np.bincount(self.column, g[self.row], self.width), g.sum())


def non_negative_pu(pos: Rows, unlabelled: Rows, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by Adam on all rows."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    theta = np.zeros(pos.width + 1)
    theta[-1] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        zp, zu = pos @ w + b, unlabelled @ w + b
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_pos, of_un = prior * sigmoid(zp) / pos.n, sigmoid(zu) / unlabelled.n
        if negative_risk >= 0:
            g = pos.summed(-prior * (1 - sigmoid(zp)) / pos.n - of_pos) + unlabelled.summed(of_un)
        else:
            g = pos.summed(of_pos) + unlabelled.summed(-of_un)
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


class _Places(dict):
    """Word -> place of its bucket among some buckets, or -1, filled as words appear."""

    def __init__(self, buckets: np.ndarray):
        self.columns = {int(b): k for k, b in enumerate(buckets)}

    def __missing__(self, word: str) -> int:
        k = self[word] = self.columns.get(bucket_of(word), -1)
        return k

    def of(self, text: str | None) -> set[int]:
        """The places of a text's words."""
        return set(map(self.__getitem__, words_of(text))) - {-1}


def score_text(text: str | None, model: Model, places: _Places) -> float:
    z = model.weights[:, sorted(places.of(text))].sum(axis=1) + model.bias
    with np.errstate(over="ignore"):  # a model without positives has a bias of minus infinity
        return float((1 / (1 + np.exp(-z))).mean())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), a row per input row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        places = _Places(model.buckets)
        for b in batches:
            found = []
            for x in b.column(1):
                if len(places) > REMEMBERED:
                    places = _Places(model.buckets)
                found.append(score_text(x.as_py(), model, places))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    fold = train_fold(F.col("doc_id"))
    model = fit(docs.where(fold), labels.where(fold))
    out = score(docs, model)
    return out.select("doc_id", (~fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
