"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word backs
off to its character n-grams: the longest n at which any of them is known
decides, down to single characters; a word unknown even there says nothing. A
text's language has the highest sum.

Fitting reads a bounded sample of the labelled rows (``docs_per_language``, by
hash threshold) and learns every word of it; scoring reads every text whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
tie between languages goes to the first in alphabetical order; repeated rows are
scored each by itself; without labelled rows every text is ``und``; a row without
doc_id is in no fold (``held_out`` is null), is never learned from and is judged
like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.llm.common import table

UNDETERMINED = "und"
LONGEST = 5
#: Words that a worker remembers between texts; a cache without influence on results.
REMEMBERED = 300_000
_WORDS = re.compile(r"[^\W\d_]+")
#: Words up to which a longer text raises the confidence of its score.
_SURE_AFTER = 25


class Table:
    """Strings with a row of log frequencies by language each."""

    def __init__(self, rows: dict[str, int], counts: np.ndarray):
        """Counts by language become smoothed log shares."""
        self.rows = rows
        totals, v = counts.sum(axis=0), max(1, len(counts))
        self.logs = np.log((counts + 0.1) / (totals + 0.1 * v))


@dataclass
class Model:
    """Log frequencies by language of words and of character n-grams, by n."""

    langs: list[str]
    words: Table | None = None
    grams: dict[int, Table] = field(default_factory=dict)

    def of(self, word: str) -> np.ndarray:
        """The scores of one word, by language."""
        if (k := self.words.rows.get(word)) is not None:
            return self.words.logs[k]
        marked = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            known = self.grams[n]
            rows = [k for g in grams(marked, n) if (k := known.rows.get(g)) is not None]
            if rows:
                return known.logs[rows].mean(axis=0)
        return np.zeros(len(self.langs))


def grams(marked: str, n: int) -> list[str]:
    """The character n-grams of a word between its marks; for n = 1 without the marks."""
    if n == 1:
        return list(marked[1:-1])
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def model_of(counted: list[tuple[str, str, int]]) -> Model:
    """A model of (lang, word, count) rows of a bounded sample."""
    langs = sorted({x[0] for x in counted})
    at = {x: k for k, x in enumerate(langs)}
    words: dict[str, int] = {}
    place = [words.setdefault(word, len(words)) for _, word, _ in counted]
    counts = np.zeros((len(words), len(langs)))
    np.add.at(counts, (place, [at[lang] for lang, _, _ in counted]), [n for _, _, n in counted])
    by_n = {}
    for n in range(1, LONGEST + 1):
        rows: dict[str, int] = {}
        sizes, found = np.zeros(len(words), np.int64), []
        for i, word in enumerate(words):
            own = [rows.setdefault(g, len(rows)) for g in grams(f"^{word}$", n)]
            sizes[i] = len(own)
            found += own
        owner, which = np.repeat(np.arange(len(words)), sizes), np.array(found, np.int64)
        by_n[n] = Table(rows, np.stack([np.bincount(which, counts[owner, k], len(rows)) for k in range(len(langs))], axis=1))
    return Model(langs, Table(words, counts), by_n)


def train_fold(doc_id: Column) -> Column:
    """Rows that a model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(labelled: DataFrame, docs_per_language: int = 1000) -> Model:
    """Learns from (doc_id, text, lang) rows; about ``docs_per_language`` of a language are read, by the hash of id and text, equal rows once."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    scale = 1 << 30
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(scale, int(scale * docs_per_language / n) + 1))])
    # Rows that share an id are dealt apart, equal ones fall in or out together and count once: the bound holds whatever repeats.
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < limits[F.col("lang")]).select("lang", "doc_id", "text").distinct()
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow()
    return model_of(sorted(zip(*(counted[c].to_pylist() for c in ("lang", "word", "n")), strict=True)))


class _Rows(dict):
    """Word -> row of ``table``, filled as words appear."""

    def __init__(self, model: Model):
        self.model, self.table, self.used = model, np.zeros((1024, len(model.langs))), 0

    def __missing__(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.model.of(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1


def judge(text: str | None, model: Model, rows: _Rows) -> tuple[str, float]:
    """(language, score) of one text."""
    words = _WORDS.findall(text.lower()) if text and model.langs else []
    if not any(c.isalpha() for w in words for c in w):
        return UNDETERMINED, 0.0
    ids = np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))
    total = rows.table[ids].sum(axis=0)
    spread = total / len(ids) * min(len(ids), _SURE_AFTER)
    best = int(np.argmax(total))
    return model.langs[best], float(1.0 / np.exp(spread - spread[best]).sum())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), a row per input row; ``id_col`` may be a struct of whatever should come along."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        rows = _Rows(model)
        for batch in batches:
            found = []
            for x in batch.column(1):
                if rows.used > REMEMBERED:
                    rows = _Rows(model)
                found.append(judge(x.as_py(), model, rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = taken.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return taken.mapInArrow(run, schema)


def language_stage(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a score of at least ``least``; their columns stay as they were.

    The model learns from the training rows of ``docs`` itself, those with a
    ``lang``; without any, every document is undetermined and goes, and without
    that column there is an error. A text that is null or has no letter goes; a
    row without doc_id is judged like any other; an empty table stays empty.
    """
    if "lang" not in docs.columns:
        raise ValueError("the language stage learns from a column lang")
    model = fit(docs.where(train_fold(F.col("doc_id"))).select("doc_id", "text", "lang"))
    held = docs.select(F.struct("*").alias("_row"), "text")
    judged = identify(held, model, id_col="_row")
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("doc_id.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(train_fold(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = identify(docs, model)
    return out.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
