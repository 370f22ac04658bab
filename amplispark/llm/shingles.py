"""Word shingles of texts and their fast similarity sketches, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words that a worker remembers between texts; a cache without influence on results.
REMEMBERED = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 over the golden ratio, made odd
_LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers whose every bit depends on all bits: the finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def number_of(data: bytes) -> int:
    """64 bits of a BLAKE2b digest."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class WordNumbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = number_of(word)
        return n


def words_of(text: str | None) -> list[bytes]:
    """The words of a text between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_set(text: str | None, width: int, known: WordNumbers) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers.

    A text of fewer words is one shingle of them all; one without words has none.
    """
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > REMEMBERED:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    acc = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        acc = mixed(acc * _ODD + h[k : k + n])
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


def signature(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart: sums of two mixes over the set."""
    with np.errstate(over="ignore"):
        return (int(mixed(shingles).sum(dtype=np.uint64)).to_bytes(8, "little") + int(mixed(shingles ^ _ODD).sum(dtype=np.uint64)).to_bytes(8, "little"))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The sketch of each non-empty set: t numbers, equal in two sketches with the sets' similarity as probability.

    In round i every element falls into a bin that its hash for that round
    names, with a value that starts with i; bins keep their least value, so an
    earlier round wins. In rounds t to 2t - 1 every element falls into bin
    i - t, so after 2t rounds every bin is full. Sets whose bins are full drop
    out; a set of n elements needs about t ln t / n rounds.
    """
    out = np.full((len(sets), t), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    todo = np.arange(len(sets))
    first = 0
    while first < 2 * t and len(todo):
        elements = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, [len(sets[i]) for i in todo])
        last = min(2 * t, first + max(1, 200_000 // len(elements)))
        for i in range(first, last):
            x = mixed(elements + np.uint64(i + 1) * _ODD)
            bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
            np.minimum.at(flat, owner * t + bins, (np.uint64(i) << np.uint64(32)) | (x & _LOW))
        first = last
        todo = todo[(out[todo] == np.iinfo(np.uint64).max).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """bands 64-bit keys for each sketch of bands * rows numbers; the number of the band is part of its key."""
    parts = sketch.reshape(len(sketch), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD, parts.shape[:2]).copy()
    for k in range(rows):
        acc = mixed(acc * _ODD + parts[:, :, k])
    return acc.view(np.int64)
