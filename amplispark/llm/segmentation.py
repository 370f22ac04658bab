"""SentencePiece encoding by sampling distinct segmentations, and decoding.

A text's segmentations form a lattice; a piece weighs ``(rank + 2) ** -alpha``
by its rank in the vocabulary, a character that is in no piece is written in
bytes. Gumbel top-k draws k different segmentations as if without replacement:
perturbed log weights are compared as arrival times, the exponentials of their
negatives. An A* search over the lattice finds the earliest ones exactly. The
best of a whole region of segmentations has a known law, so only regions wait in
the queue: the earliest region gives up its segmentation, and what is left of
it splits by the first step that differs. The time of the next arrival, k + 1, is
the threshold of the inclusion scores.

Pieces never cross from a letter to the white space after it, so the lattice is
built for distinct units between such places, in numpy, and a text's steps are
drawn for all its units at once, equal units of all texts side by side. Seeds
come from the row key alone.

Defined cases: a null or empty text has the one empty segmentation; where fewer
than k segmentations exist all are returned, with inclusion 1; rows of one key
and text get the same draws; any length of text is sampled whole; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.llm.common import table

_HASH = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 over the golden ratio, made odd
_WORD = 2**64 - 1
#: Characters of texts sampled at once, and of units whose lattices are kept for the texts to come; without influence on results.
_CHUNK_CHARS, _KEPT_CHARS = 300_000, 1_500_000
#: Units walked at once; without influence on results.
_BLOCK = 1 << 15
#: Segmentations that the query draws of each text: beyond two the search has regions to choose from, whose order decides which comes next.
SAMPLES_A_TEXT = 4
SAMPLES = "doc_id long, sample int, n_ids long, ids array<int>, log_prob double, inclusion double"


class Vocabulary:
    """Pieces by hash, with their log weights."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.piece_of = {i: sp.id_to_piece(i) for i in plain}
        self.longest = max(map(len, self.piece_of.values()))
        if any("▁" in p.lstrip("▁") or ("\n" in p and p != "\n") for p in self.piece_of.values()):
            raise ValueError(f"{path}: pieces that reach over white space are not supported")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        hashes = np.array([self._hash(self.piece_of[i]) for i in plain], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = np.append(hashes[order], np.zeros(1, np.uint64)), np.array(plain, np.int64)[order]
        self.bucket = np.searchsorted(self.hashes[:-1] >> np.uint64(46), np.arange((1 << 18) + 1, dtype=np.uint64))
        self.taken = np.zeros(1 << 20, bool)
        self.taken[(self.hashes[:-1] >> np.uint64(44)).view(np.int64)] = True
        self.goes_on = np.zeros(1 << 20, bool)  # beginnings of longer pieces
        self.goes_on[[self._hash(x) >> 44 for x in {p[:n] for p in self.piece_of.values() for n in range(1, len(p))}]] = True
        self.byte_array = np.array(self.byte_ids, np.int64)
        self.is_part = np.zeros(sp.get_piece_size(), bool)  # ids that stand for no text of their own
        self.is_part[self.byte_array[128:]] = True
        self.is_part[sp.unk_id()] = True
        shown = [self.piece_of.get(i, "").replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        for b in range(128):
            shown[self.byte_ids[b]] = bytes([b])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        rank = np.array([min(-sp.get_score(int(i)), float(len(plain))) for i in self.ids])
        self.weights = -alpha * np.log(rank + 2)
        self.byte_weight = -alpha * np.log(len(plain) + 2)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(_HASH) % 2**64
            h ^= h >> 32
        return h

    def normalize(self, text: str | None) -> str:
        return self.sp.normalize(text or "")

    def look_up(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of hashes that are of a piece, numbers of those pieces)."""
        at = np.flatnonzero(self.taken[(x >> np.uint64(44)).view(np.int64)])
        y = x[at]
        b = (y >> np.uint64(46)).view(np.int64)
        k, end = self.bucket[b], self.bucket[b + 1]
        hits, pieces = [], []
        while len(at):
            same = self.hashes[k] == y
            hits.append(at[same])
            pieces.append(k[same])
            k += 1
            more = np.flatnonzero(~same & (k < end))
            at, y, k, end = at[more], y[more], k[more], end[more]
        return (np.concatenate(hits), np.concatenate(pieces)) if hits else (at, at)

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The text of each row of ids, in UTF-8."""
        counts = np.array([len(r) for r in rows], np.int64)
        ids = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64, copy=False)
        sizes = self.shown_size[ids]
        ends = np.cumsum(sizes)
        total = int(sizes.sum())
        narrow = np.int32 if total < 2**31 - len(self.shown) else np.int64
        at = np.repeat((self.shown_at[ids] - (ends - sizes)).astype(narrow), sizes)
        at += np.arange(total, dtype=narrow)
        out = self.shown.take(at).tobytes()
        parts = np.append(0, np.cumsum(self.is_part[ids]))
        cuts, ends = np.append(0, np.cumsum(counts)), np.append(0, ends)
        whole = (parts[cuts[1:]] == parts[cuts[:-1]]).tolist()
        spans = itertools.pairwise(ends[cuts].tolist())
        return [out[a:b].removeprefix(b" ") if w else self.sp.decode(r.tolist()).encode() for r, w, (a, b) in zip(rows, whole, spans, strict=True)]


class Lattice:
    """The lattices of distinct units, side by side: a node is a place in one of them.

    Edges stand by node, the longest step first; ``p`` is the probability of a
    step, which counts all that can follow it, ``upto`` that of it and the edges
    before it (2 at a node's last edge), ``after`` the node that it leads to, -1
    at the unit's end. Units can be added; a unit's edges do not depend on the
    others.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.room = vocabulary, {}
        self.starts = np.zeros(0, np.int64)
        self.is_start = np.zeros(0, bool)
        self.codes, self.left, self.first, self.last = (np.zeros(0, np.int32) for _ in range(4))
        self.size, self.pid, self.logp, self.p = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0)
        self.after, self.upto = np.zeros(0, np.int32), np.zeros(0)

    def add(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        """Appends the lattices of further units, of the given sizes, from their code points side by side."""
        starts, n = np.cumsum(sizes) - sizes, len(codes)
        if not n:
            return
        left = (np.repeat(starts + sizes, sizes) - np.arange(n)).astype(np.int32)
        found, degree = self._pieces(codes, left)
        first, size, pid, logp, p, after = self._edges(found, degree, left)
        is_start = np.zeros(n, bool)
        is_start[starts] = True
        nodes, edges = len(self.codes), len(self.size)
        new = {"starts": starts + nodes, "is_start": is_start, "codes": codes, "left": left, "first": first + edges, "last": first + edges + degree - 1}
        new |= {"size": size, "pid": pid, "logp": logp, "p": p, "upto": self._upto(p, first, degree)}
        new["after"] = np.where(after < n, after + nodes, -1)
        for name, value in new.items():
            self._append(name, value)

    def _append(self, name: str, value: np.ndarray) -> None:
        """Lengthens an array within a larger one, so that what it holds is seldom copied."""
        old = getattr(self, name)
        n, m = len(old), len(old) + len(value)
        room = self.room.get(name, old)
        if len(room) < m:
            room = self.room[name] = np.empty(max(m, n * 3 // 2), old.dtype)
            room[:n] = old
        room[n:m] = value
        setattr(self, name, room[:m])

    def _pieces(self, codes: np.ndarray, left: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """(size, nodes, weights, ids) of the pieces that start at nodes, and the number of each node's."""
        v, n = self.vocabulary, len(codes)
        h, at, found = np.zeros(n, np.uint64), np.arange(n), []
        added = codes.astype(np.uint64) + np.uint64(1)
        degree = np.zeros(n, np.int32)
        with np.errstate(over="ignore"):
            for size in range(1, v.longest + 1):
                h += added[at + (size - 1)]
                h *= _HASH
                h ^= h >> np.uint64(32)
                hit, k = v.look_up(h)
                nodes = at[hit]
                found.append((size, nodes, v.weights[k], v.ids[k]))
                degree[nodes] += 1
                on = np.flatnonzero(v.goes_on[(h >> np.uint64(44)).view(np.int64)] & (left[at] > size))
                if not len(on):
                    break
                at, h = at[on], h[on]
        alone = np.ones(n, bool)
        alone[found[0][1]] = False
        raw = np.flatnonzero(alone)  # characters that are no piece
        c = codes[raw]
        cost = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF).astype(int)
        found.append((1, raw, v.byte_weight * cost, np.where(c < 128, v.byte_array[np.minimum(c, 127)], -1)))
        degree[raw] += 1
        return found, degree

    @staticmethod
    def _edges(found: list[tuple], degree: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first edge of each node; size, id, log probability and probability of each edge, and the node after it, the number of nodes at a unit's end)."""
        n = len(left)
        by_left = np.argsort(left.astype(np.min_scalar_type(int(left.max()))), kind="stable")
        d = degree[by_left]
        heads = np.cumsum(d, dtype=np.int64) - d
        edges = int(d.sum())
        first = np.zeros(n, np.int64)
        first[by_left] = heads
        size, pid, weight, p = np.zeros(edges, np.int32), np.zeros(edges, np.int32), np.zeros(edges), np.zeros(edges)
        free = first.copy()
        for step, nodes, w, ids in sorted(found, key=lambda f: -f[0]):  # of a node's edges the longest stands first
            place = free[nodes]
            free[nodes] += 1
            size[place], pid[place], weight[place] = step, ids, w
        node = np.repeat(by_left, d)
        after = node + size
        after[size == left[node]] = n  # a unit's end, where nothing follows
        beta = np.zeros(n + 1)
        cuts = np.append(np.flatnonzero(np.diff(left[by_left], prepend=0)), n)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lo, hi = int(heads[i]), int(heads[j]) if j < n else edges
            own = heads[i:j] - lo
            total = weight[lo:hi] + beta[after[lo:hi]]
            top = np.maximum.reduceat(total, own)
            share = np.exp(total - np.repeat(top, d[i:j]))
            sums = np.add.reduceat(share, own)
            b = top + np.log(sums)
            beta[by_left[i:j]] = b
            weight[lo:hi] = total - np.repeat(b, d[i:j])
            p[lo:hi] = share / np.repeat(sums, d[i:j])
        return first, size, pid, weight, p, after

    @staticmethod
    def _upto(p: np.ndarray, first: np.ndarray, degree: np.ndarray) -> np.ndarray:
        """The sum of each node's probabilities up to each edge; 2 at the last one, which no draw exceeds."""
        out, more, e = p.copy(), degree, first
        while len(e):
            on = more > 1
            out[e[~on]] = 2.0
            more, e = more[on] - 1, e[on] + 1
            out[e] += out[e - 1]
        return out

    def edges(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A random edge of each node."""
        e = self.first.take(nodes)
        more = np.flatnonzero(u > self.upto.take(e))
        e_, u = e.take(more) + 1, u.take(more)
        while len(more):
            e[more] = e_
            on = np.flatnonzero(u > self.upto.take(e_))
            more, e_, u = more.take(on), e_.take(on) + 1, u.take(on)
        return e

    def other_edge(self, node: int, barred: list[int], u: float) -> int:
        """A random edge of a node that is not barred."""
        free = [e for e in range(self.first[node], self.last[node] + 1) if e not in barred and self.p[e] > 0]
        left = u * sum(float(self.p[e]) for e in free)
        for e in free:
            left -= float(self.p[e])
            if left < 0:
                return e
        return free[-1]

    def walk(self, nodes: np.ndarray, seeds: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end of each start's steps; node and edge of each step) from the given nodes to the ends of their units, start by start.

        Only the starts of ``order`` are walked, in that order, which has no
        influence on their steps: those of equal nodes side by side are fast.
        """
        found, counts = [], np.zeros(len(nodes), np.int64)
        for i in range(0, len(order), _BLOCK):
            at, step = order[i : i + _BLOCK], 0
            here, own = nodes.take(at), seeds.take(at)
            while len(here):
                e = self.edges(here, uniform(own, step))
                found.append((step, at, here, e))
                step += 1
                counts[at] = step
                after = self.after.take(e)
                on = np.flatnonzero(after >= 0)
                here, at, own = after.take(on), at.take(on), own.take(on)
        ends = np.cumsum(counts)
        first = ends - counts
        total = int(counts.sum())
        out, out_e = np.zeros(total, np.int32), np.zeros(total, np.int32)
        for step, at, here, e in found:
            place = first.take(at) + step
            out[place], out_e[place] = here, e
        return ends, out, out_e

    def ids_of(self, nodes: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The ids of a segmentation; characters in no piece become the ids of their bytes."""
        ids = self.pid.take(e)
        if not len(ids) or ids.min() >= 0:
            return ids
        out: list[int] = []
        for n, i in zip(nodes.tolist(), ids.tolist(), strict=True):
            out += [i] if i >= 0 else [self.vocabulary.byte_ids[b] for b in chr(self.codes[n]).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers whose every bit depends on all bits: the finaliser of SplitMix64."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    z = y >> np.uint64(27)
    y ^= z
    y *= np.uint64(0x94D049BB133111EB)
    np.right_shift(y, np.uint64(31), out=z)
    y ^= z
    return y


def uniform(seeds: np.ndarray, n: int) -> np.ndarray:
    """The n-th number in [0, 1) of each mixed seed, from 0."""
    with np.errstate(over="ignore"):
        x = mixed(seeds + np.uint64(n) * _HASH) if n else seeds
    return (x >> np.uint64(11)).view(np.int64) * 2.0**-53


class Search:
    """The A* search over the segmentations of one text.

    A region holds what follows a path up to some step from ``first`` on and
    then differs from it (and from what is barred there): all regions together
    hold what has not been returned.
    """

    def __init__(self, lattice: Lattice, seed: int, path: tuple[np.ndarray, np.ndarray]):
        self.lattice, self.seed, self.drawn = lattice, seed, 0
        self.paths, self.sums, self.regions, self.threshold = [path], [self.summed(path)], [], np.inf
        self.log_time = math.log(-math.log1p(-self.draw()))
        self.wait(0, 0, {})

    def summed(self, path: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The log probability of a path before each step and after the last."""
        out = np.zeros(len(path[1]) + 1)
        np.cumsum(self.lattice.logp.take(path[1]), out=out[1:])
        return out

    def draw(self) -> float:
        """The next number in [0, 1) of this text's own stream."""
        self.drawn += 1
        x = (self.seed + (1_000_000 + self.drawn) * int(_HASH)) & _WORD
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WORD
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _WORD
        return ((x ^ (x >> 31)) >> 11) * 2.0**-53

    def left(self, path: int, step: int, barred: list[int]) -> float:
        """The probability of other edges than the path's and the barred ones at a step, given the steps before it."""
        la = self.lattice
        nodes, e = self.paths[path]
        node, own = nodes[step], e[step]
        first = int(la.first[node])
        return sum(p for x, p in enumerate(la.p[first : la.last[node] + 1].tolist(), first) if x != own and x not in barred)

    def mass(self, path: int, first: int, barred: dict[int, list[int]]) -> float:
        """The log of a region's probability: what follows the path up to ``first``, but for the path itself and what is barred."""
        before, la = self.sums[path], self.lattice
        start = before[first]
        rest = -math.expm1(before[-1] - start) - sum(math.exp(before[t] - start) * float(la.p[x]) for t, edges in barred.items() for x in edges)
        if rest < 1e-6:  # a difference of near equals: sum over the steps instead
            nodes = self.paths[path][0]
            open_ = first + np.flatnonzero(la.first[nodes[first:]] < la.last[nodes[first:]])
            rest = sum(math.exp(before[t] - start) * self.left(path, t, barred.get(t, [])) for t in open_.tolist())
        return start + math.log(rest) if rest > 0 else -math.inf

    def wait(self, path: int, first: int, barred: dict[int, list[int]]) -> None:
        """Puts a region in the queue with the time at which its earliest segmentation arrives."""
        mass = self.mass(path, first, barred)
        if mass > -math.inf:
            later = math.log(-math.log1p(-self.draw())) - mass
            top = max(self.log_time, later)
            self.regions.append((top + math.log1p(math.exp(min(self.log_time, later) - top)), path, first, barred))

    def differing_step(self, path: int, first: int, barred: dict[int, list[int]]) -> int:
        """A random step at which a region's segmentation leaves the path."""
        before = self.sums[path]
        total = -math.expm1(before[-1] - before[first])
        while total > 1e-6:
            v = before[first] + math.log1p(-self.draw() * total)
            t = first + int(np.searchsorted(-before[first + 1 :], -v, side="left"))
            if t >= len(before) - 1:
                continue
            if t not in barred or self.draw() * -math.expm1(before[t + 1] - before[t]) < self.left(path, t, barred[t]):
                return t
            if self.mass(path, first, barred) - before[first] < math.log(total) - 3:
                break  # mostly barred: weigh the steps one by one
        nodes, la = self.paths[path][0], self.lattice
        open_ = (first + np.flatnonzero(la.first[nodes[first:]] < la.last[nodes[first:]])).tolist()
        cum = np.cumsum([math.exp(before[t] - before[first]) * self.left(path, t, barred.get(t, [])) for t in open_])
        return open_[int(min(np.searchsorted(cum, self.draw() * cum[-1], side="right"), np.flatnonzero(np.diff(cum, prepend=0.0) > 0)[-1]))]

    def next(self) -> tuple[int, int] | None:
        """The start of the next segmentation: the node inside a unit from which it goes on after it differs, or -1, and the number of the unit after."""
        if not self.regions:
            return None
        best = min(self.regions, key=lambda r: r[0])
        self.regions.remove(best)
        self.log_time, path, first, barred = best
        t = self.differing_step(path, first, barred)
        nodes, e = self.paths[path]
        own = self.lattice.other_edge(int(nodes[t]), [*barred.get(t, []), int(e[t])], self.draw())
        self.split = (path, first, barred | {t: [*barred.get(t, []), own]}, t, own)
        return int(self.lattice.after[own]), int(self.lattice.is_start[nodes[: t + 1]].sum())

    def add(self, *rest: tuple[np.ndarray, np.ndarray]) -> None:
        """Takes the walked rest of the segmentation of :meth:`next`, in pieces, and splits its region."""
        old, first, barred, t, own = self.split
        nodes, e = self.paths[old]
        path = np.concatenate([nodes[: t + 1], *(r[0] for r in rest)]), np.concatenate([e[:t], np.array([own], e.dtype), *(r[1] for r in rest)])
        self.paths.append(path)
        self.sums.append(self.summed(path))
        self.wait(old, first, barred)
        self.wait(len(self.paths) - 1, t + 1, {})

    def close(self) -> None:
        if self.regions:
            self.threshold = min(r[0] for r in self.regions)


def sample_all(lattice: Lattice, texts: list[np.ndarray], seeds: list[int], k: int) -> list[list[tuple[np.ndarray, np.ndarray, float, float]]]:
    """At most k distinct segmentations of each text of units: (nodes, edges, log probability, log threshold)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    starts = lattice.starts[np.concatenate([np.zeros(0, np.int64), *texts])]
    order = np.argsort(starts)
    with np.errstate(over="ignore"):
        base = mixed(np.array(seeds, np.uint64))  # away from the searches' own streams
        places = np.repeat(base, sizes) + (np.arange(len(starts)) - np.repeat(bounds[:-1], sizes)).astype(np.uint64) * _HASH

    def drawn(round_: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each unit of the texts that are alive: (where each unit's steps begin and the last ones end, nodes, edges)."""
        with np.errstate(over="ignore"):
            own = mixed(places + np.uint64(round_ << 40) * _HASH)
        ends, nodes, e = lattice.walk(starts, own, order if alive.all() else order[np.repeat(alive, sizes)[order]])
        return np.append(0, ends), nodes, e

    cuts, nodes, e = drawn(0, np.ones(len(texts), bool))
    firsts = [(nodes[a:b], e[a:b]) for a, b in itertools.pairwise(cuts[bounds].tolist())]
    searches = [Search(lattice, s, p) for s, p in zip(seeds, firsts, strict=True)]
    for round_ in range(1, k):
        started = [(i, got) for i, s in enumerate(searches) if len(s.paths) == round_ and (got := s.next()) is not None]
        if not started:
            break
        of, inside, unit = (np.array(x, np.int64) for x in zip(*((i, *got) for i, got in started), strict=True))
        alive = np.zeros(len(texts), bool)
        alive[of] = True
        cuts, nodes, e = drawn(round_, alive)
        with np.errstate(over="ignore"):  # what is left of a unit inside which a segmentation differs has a place of its own
            own = mixed(base[of] + np.uint64((round_ << 40) + (1 << 39)) * _HASH)
        own_cuts, own_nodes, own_e = lattice.walk(inside, own, np.flatnonzero(inside >= 0))
        own_cuts = np.append(0, own_cuts).tolist()
        heads, tails = cuts[bounds[of] + unit].tolist(), cuts[bounds[of + 1]].tolist()
        for i, a, b, c, d in zip(of.tolist(), own_cuts[:-1], own_cuts[1:], heads, tails, strict=True):
            searches[i].add((own_nodes[a:b], own_e[a:b]), (nodes[c:d], e[c:d]))
    for s in searches:
        s.close()
    return [[(n, e, float(b[-1]), float(s.threshold)) for (n, e), b in zip(s.paths, s.sums, strict=True)] for s in searches]


def seed_of(key: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{key}".encode(), digest_size=8).digest(), "little")


class Units:
    """Distinct units by number, with their lattices.

    No piece crosses a unit: it is a line end, or white space with the word behind it.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.lattice = Lattice(vocabulary)
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The units of each normalised text, by number; new ones are added."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([0, *map(len, texts)])
        space, line = codes == ord("▁"), codes == ord("\n")
        opens = space | line
        opens[1:] &= ~space[:-1] | line[1:]
        opens[1:] |= line[:-1]
        opens[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(opens)
        if not len(starts):
            return [starts] * len(texts)
        numbers = self._numbers(codes, starts, np.diff(starts, append=len(codes)))
        return [numbers[i:j] for i, j in itertools.pairwise(np.searchsorted(starts, bounds).tolist())]

    def _numbers(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each unit's number, looked up by hash; one whose hash is another's gets a lattice of its own."""
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(sizes.max()), _HASH))
            h = mixed(np.add.reduceat(mixed(codes.astype(np.uint64)) * power[place], starts) + sizes.astype(np.uint64))
        distinct, example, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        of_distinct = np.zeros(len(distinct), np.int64)
        of_distinct[~new] = self.numbers[at[~new]]
        of_distinct[new] = self._added(codes, starts[example[new]], sizes[example[new]])
        place_in = np.searchsorted(self.hashes, distinct[new])
        self.hashes, self.numbers = np.insert(self.hashes, place_in, distinct[new]), np.insert(self.numbers, place_in, of_distinct[new])
        numbers, la = of_distinct[which], self.lattice
        nodes = np.minimum(np.repeat(la.starts[numbers], sizes) + place, len(la.codes) - 1)
        same = np.logical_and.reduceat(la.codes[nodes] == codes, starts) & (la.left[la.starts[numbers]] == sizes)
        if not same.all():
            odd = np.flatnonzero(~same)
            numbers[odd] = self._added(codes, starts[odd], sizes[odd])
        return numbers

    def _added(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        first = len(self.lattice.starts)
        ends = np.cumsum(sizes)
        self.lattice.add(codes[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], sizes)
        return first + np.arange(len(starts))


def encode_task(rows: Iterator[tuple[object, str | None]], vocabulary: Vocabulary, k: int, seed: int) -> Iterator[tuple]:
    """(key, sample, ids, log probability, inclusion) of each (key, text) row."""
    units = Units(vocabulary)
    for held in _chunks((key, vocabulary.normalize(text)) for key, text in rows):
        if len(units.lattice.codes) > _KEPT_CHARS:
            units = Units(vocabulary)
        numbers = units.of([text for _, text in held])
        sampled = sample_all(units.lattice, numbers, [seed_of(key, seed) for key, _ in held], k)
        for (key, _), paths in zip(held, sampled, strict=True):
            for n, (nodes, e, logp, threshold) in enumerate(paths):
                yield key, n, units.lattice.ids_of(nodes, e), logp, float(-np.expm1(-np.exp(min(logp + threshold, 700.0))))


def _chunks(rows: Iterator[tuple[object, str]]) -> Iterator[list[tuple[object, str]]]:
    """The rows in stretches whose texts are sampled at once."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[1])
        if chars >= _CHUNK_CHARS or len(held) >= 4000:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return ((i.as_py(), x.as_py()) for b in batches for i, x in zip(b.column(0), b.column(1), strict=True))


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, seed: int = 0, digest: bool = False, per_batch: int = 400) -> DataFrame:
    """Rows of SAMPLES for (doc_id, text) rows; with ``digest`` ``ids_crc32`` and ``text_crc32``, of the decoded text, in place of ``ids``.

    ids_crc32 is of little-endian unsigned 32-bit ids, text_crc32 of UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            keys, n, ids, logp, inclusion = zip(*out, strict=True)
            columns = {"doc_id": pa.array(keys, pa.int64()), "sample": pa.array(n, pa.int32()), "n_ids": pa.array(map(len, ids), pa.int64())}
            if digest:
                columns["ids_crc32"] = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                columns["text_crc32"] = pa.array(map(zlib.crc32, vocabulary.decode(list(ids))), pa.int64())
            else:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            columns |= {"log_prob": pa.array(logp, pa.float64()), "inclusion": pa.array(inclusion, pa.float64())}
            return pa.RecordBatch.from_pydict(columns)

        for row in encode_task(_rows(batches), vocabulary, k, seed):
            out.append(row)
            if len(out) >= per_batch:
                yield batch()
                out = []
        if out:
            yield batch()

    schema = SAMPLES.replace("ids array<int>", "ids_crc32 long, text_crc32 long") if digest else SAMPLES
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, sample, text) of (doc_id, sample, ids) rows; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model)
        for b in batches:
            texts = [x.decode() for x in vocabulary.decode([np.array(x.as_py() or [], np.int64) for x in b.column(2)])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "sample", "text"])

    return rows.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")


def piece_bpe() -> str:
    """The path of the model that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), piece_bpe(), k=SAMPLES_A_TEXT, digest=True)


QUERIES = {"op8_sampled_segmentation": op8_sampled_segmentation}
ORACLES: dict[str, str] = {}
