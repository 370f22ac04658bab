"""Packing of documents into token windows by Karmarkar-Karp multiway differencing.

Each task tokenizes its documents, cuts whole windows off, cuts the rest into
pieces of at most ``piece`` ids, gathers pieces until they would fill ``group``
windows up to ``fill``, and splits such a group into near-equal windows: partial
partitions merge largest spread first, the fullest window of one with the
emptiest of the other. Where a window exceeds its capacity the group is split
again into one window more. Nothing is shuffled; a task holds one group.

Defined cases: a null or empty text is the end id alone; long texts are cut, at
no loss; repeated rows are packed each by itself; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import contextlib
import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.llm.common import table

WINDOW = 2048
END_ID = 1
#: Words that a worker remembers between texts; a cache without influence on results.
REMEMBERED = 1_500_000
_PARTS = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers.

    The tokenizer lowers case and never joins across white space, so a text's
    ids are those of its words one after another. A run of letters and the ASCII
    marks behind it (but for apostrophes) are split by it too, and remembered
    apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True
        self._check(path)

    def _check(self, path: str) -> None:
        """Raises for a tokenizer whose ids are not those of its words; texts can only be tokenized by words with one of that kind."""
        of = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        joined = [(p, [w.decode() for w in words_of(p)]) for p in ("The Quick fox jumps", "a\tb\n\nc  D e", " Don't (stop)-now! 12.5", "ÉTÉ Naïve Über")]
        marked = [(f"word{m}", ["word", m]) for m in "!\"#$%&(),-./:;=?@[]_{}~" if _PARTS.fullmatch(b"word" + m.encode())]
        for text, words in joined + marked:
            if of(text) != [i for w in words for i in of(w)]:
                raise ValueError(f"{path}: its ids of {text!r} are not those of {words}")

    def learn(self, words: set[bytes]) -> None:
        """Adds words that are not known."""
        split = {w: m.groups() if not w.isalpha() and (m := _PARTS.fullmatch(w)) and _letters(m[1]) else (w,) for w in words}
        new = {p for parts in split.values() for p in parts if p not in self}
        plain = [p for p in new if _letters(p)]
        if plain and self._learn_joined(plain):
            new.difference_update(plain)
        rest = list(new)
        for p, e in zip(rest, self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False), strict=True):
            self[p] = np.asarray(e.ids, dtype="<u4").tobytes()
        for w, parts in split.items():
            if len(parts) == 2:
                self[w] = self[parts[0]] + self[parts[1]]

    def _learn_joined(self, plain: list[bytes]) -> bool:
        """Adds words of letters in one call: each ends with the first id that ends a word; False if the count differs."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(plain) or cuts[-1] != 4 * len(ids):
            return False
        raw, start = ids.tobytes(), 0
        for p, cut in zip(plain, cuts, strict=True):
            self[p] = raw[start:cut]
            start = cut
        return True


_KNOWN: dict[str, Words] = {}


def known_words(path: str) -> Words:
    """The worker's words, which its tasks share."""
    if path not in _KNOWN:
        _KNOWN[path] = Words(path)
    return _KNOWN[path]


def _letters(word: bytes) -> bool:
    """Whether a word is of letters alone, in lower case too."""
    return word.isalpha() if word.isascii() else (w := word.decode()).isalpha() and w.lower().isalpha()


def words_of(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return raw.split() if b"<|" in raw else raw.lower().split()  # a special token is told by its case


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The numbers of the sizes in k parts of near-equal sums."""
    heap = [(-s, n, [0] * (k - 1) + [s], [None] * (k - 1) + [(n, None, None)]) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, parts_a = heapq.heappop(heap)
        _, _, sums_b, parts_b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(sums_a, reversed(sums_b), strict=True)]
        parts = [(None, x, y) if x and y else x or y for x, y in zip(parts_a, reversed(parts_b), strict=True)]
        order = sorted(range(k), key=sums.__getitem__)
        low = sums[order[0]]
        heapq.heappush(heap, (low - sums[order[-1]], made, [sums[i] - low for i in order], [parts[i] for i in order]))
        made += 1
    return [sorted(_leaves(p)) for p in heap[0][3]] if heap else []


def _leaves(tree) -> Iterator[int]:
    stack = [tree]
    while stack:
        x = stack.pop()
        if x:
            if x[0] is not None:
                yield x[0]
            stack += [x[1], x[2]]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The numbers of the sizes in windows within the capacity, one more as long as one exceeds it."""
    k = -(-sum(sizes) // capacity)
    while True:
        parts = difference(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


def pack_task(docs: Iterator[tuple[object, str | None]], tokenizer: str, task: int, window: int, piece: int, group: int, fill: float, batch: int = 64) -> Iterator[list[tuple]]:
    """Lists of rows of SCHEMA for the documents of one task."""
    known, rows, waiting, size, used = known_words(tokenizer), [], [], 0, 0

    def place(pieces: list[tuple]) -> None:
        nonlocal used
        offset = 0
        for p in pieces:
            rows.append((*p, (task << 32) + used, offset))
            offset += p[2]
        used += 1

    def close() -> None:
        nonlocal waiting, size
        for part in windows([p[2] for p in waiting], window):
            place([waiting[i] for i in part])
        waiting, size = [], 0

    def add(doc_id: object, ids: bytes) -> None:
        nonlocal size
        n = len(ids) // 4
        at = 0
        while at < n:
            length = window if n - at >= window else min(n - at, piece)
            p = (doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n)
            at += length
            if length == window:
                place([p])
                continue
            if size + length > fill * group * window:
                close()
            waiting.append(p)
            size += length

    end = END_ID.to_bytes(4, "little")
    held: list[tuple[object, list[bytes]]] = []

    def tokenize() -> None:
        found, unknown = [], []
        for _, words in held:
            ids = list(map(known.get, words))
            found.append(ids)
            k = -1
            with contextlib.suppress(ValueError):  # no further None
                while True:
                    k = ids.index(None, k + 1)
                    unknown.append((ids, k, words[k]))
        known.learn({w for _, _, w in unknown})
        for ids, k, w in unknown:
            ids[k] = known[w]
        for (doc_id, _), ids in zip(held, found, strict=True):
            add(doc_id, b"".join(ids) + end)
        held.clear()
        if len(known) > REMEMBERED:
            known.clear()

    for doc_id, text in docs:
        held.append((doc_id, words_of(text)))
        if len(held) >= batch:
            tokenize()
            if rows:
                yield rows
                rows = []
    tokenize()
    if waiting:
        close()
    if rows:
        yield rows


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, piece: int = 512, group: int = 32, fill: float = 0.99) -> DataFrame:
    """A row of SCHEMA per piece of the (doc_id, text) rows; ``tokenizer`` is the path of its file."""
    schema = pa.schema([(name, pa.int64()) for name in (x.split()[0] for x in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = ((i.as_py(), x.as_py()) for b in batches for i, x in zip(b.column(0), b.column(1), strict=True))
        task = TaskContext.get().partitionId()
        for rows in pack_task(docs, tokenizer, task, window, piece, group, fill):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def word_bpe() -> str:
    """The path of the tokenizer that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe())


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
