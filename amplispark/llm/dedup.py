"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

1. Each text becomes its set of word shingles and a sketch of ``bands * rows``
   numbers. Equal sets are one class, which its smallest doc_id stands for.
2. A band of a sketch is a bucket; classes that share one are candidates. First
   each class is compared with the smallest one of each of its buckets, a work
   in proportion to the classes, however large a bucket is: this joins groups
   of near copies, and a bucket whose classes are all in one group is done.
3. In the others the remaining pairs of different groups are looked at, each in
   the first bucket that it shares, in blocks of about ``BLOCK`` classes a
   side, which a large group does not share with others and of which those of
   one group, or of sizes too far apart, never meet. Sketches sort out what is far from the threshold; texts are sent only
   for classes with a partner that is not, and full sets decide. Of a block
   only links that join different groups are tested and returned, never all
   pairs.

A pair at the threshold shares no band with probability (1 - 0.8 ** 6) ** 40, or
5e-6, and fails the sketch test, which lies five standard deviations below, with
3e-7; what is linked has always been confirmed on full sets.

Defined cases: a text that is null, empty or without words has no shingles and
is linked with nothing and meets no other in a shuffle; equal texts are one class; rows that share a doc_id are
one document, with the links of each; a row without doc_id stands alone, with no
component, and is kept; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.llm import graphs
from amplispark.llm.common import Workspace, table
from amplispark.llm.shingles import WordNumbers, band_keys, shingle_set, signature, sketches

BANDS, ROWS = 40, 6
BLOCK = 512
#: Classes that a task compares with the smallest class of their bucket at once.
STAR = 128
_CHUNK = 512


def sketched(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, sig, keys, codes) of (doc_id, text) rows; codes has 8 bits of each number of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        known = WordNumbers()
        for whole in batches:
            for at in range(0, len(whole), _CHUNK):
                b = whole.slice(at, _CHUNK)
                sets = [shingle_set(x.as_py(), width, known) for x in b.column(1)]
                full = [s for s in sets if len(s)]
                found = sketches(full, bands * rows)
                keys = iter(band_keys(found, bands, rows).tolist())
                codes = iter([c.tobytes() for c in (found & np.uint64(255)).astype(np.uint8)])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([signature(s) for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([next(codes) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "sig", "keys", "codes"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sig binary, keys array<long>, codes binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct numbers."""
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_equal(t: int, percent: int) -> float:
    """Equal numbers in the sketches of a pair at the threshold, less five standard deviations."""
    j = percent / 100
    return t * j - 5 * math.sqrt(t * j * (1 - j))


class Block:
    """The classes of one block, as (band, side, rep, comp, n, keys, codes) rows, and which pairs of them may be links."""

    def __init__(self, rows: list[tuple], percent: int):
        self.band, self.percent = rows[0][0], percent
        self.side = np.array([r[1] for r in rows])
        self.two = len(set(self.side.tolist())) == 2  # of a block of two sides pairs are one of each
        self.group, self.size = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        self.keys = np.array([r[5] for r in rows], np.int64)
        self.codes = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1)
        self.least = least_equal(self.codes.shape[1], percent)

    def partners(self, i: int) -> np.ndarray:
        """Later classes of other groups that share no earlier band with class i and are not far from the threshold."""
        size, later = self.size, slice(i + 1, None)
        ok = (self.group[later] != self.group[i]) & (100 * np.minimum(size[later], size[i]) >= self.percent * np.maximum(size[later], size[i]))
        if self.two:
            ok &= self.side[later] != self.side[i]
        at = np.flatnonzero(ok) + i + 1
        if len(at):
            at = at[(self.keys[at] == self.keys[i]).argmax(axis=1) == self.band]
        if len(at):
            at = at[(self.codes[at] == self.codes[i]).sum(axis=1) >= self.least]
        return at


def wanted_rows(rows: list[tuple], percent: int) -> list[int]:
    """Which rows of a block have a partner."""
    if len(rows) < 2:
        return []
    block, wanted = Block(rows, percent), np.zeros(len(rows), bool)
    for i in range(len(rows) - 1):
        if len(at := block.partners(i)):
            wanted[i] = True
            wanted[at] = True
    return np.flatnonzero(wanted).tolist()


def block_links(rows: list[tuple], width: int, percent: int, known: WordNumbers) -> list[tuple[int, int]]:
    """Links that join the groups of one block: of (band, side, rep, comp, n, keys, codes, text) rows."""
    if len(rows) < 2:
        return []
    block, out = Block(rows, percent), []
    sets: dict[int, np.ndarray] = {}
    for i in range(len(rows) - 1):
        for k in block.partners(i).tolist():
            if block.group[k] == block.group[i]:
                continue
            for x in (i, k):
                if x not in sets:
                    sets[x] = shingle_set(rows[x][7], width, known)
            if linked(sets[i], sets[k], percent):
                out.append((rows[i][2], rows[k][2]))
                block.group[block.group == block.group[k]] = block.group[i]
    return out


def star_links(rows: list[tuple], lo: int, width: int, percent: int, known: WordNumbers) -> list[tuple[int, int]]:
    """Links of class ``lo`` with the others of (rep, n, codes, text) rows."""
    out = []
    for r in (x for x in rows if x[0] == lo):
        own, codes = shingle_set(r[3], width, known), np.frombuffer(r[2], np.uint8)
        for x in rows:
            near = x[0] != lo and 100 * min(x[1], r[1]) >= percent * max(x[1], r[1])
            if near and (np.frombuffer(x[2], np.uint8) == codes).sum() >= least_equal(len(codes), percent) and linked(own, shingle_set(x[3], width, known), percent):
                out.append((lo, x[0]))
    return out


def _grouped(batches: Iterable[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(block, its rows without the first ``by`` columns, which name it); a block's rows stand together."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for name, block in itertools.groupby(rows, key=lambda r: r[:by]):
        yield name, [r[by:] for r in block]


def _links(rows: DataFrame, block: list[str], find: Callable[[tuple, list[tuple], WordNumbers], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) of what ``find`` returns for the rows of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        known = WordNumbers()
        for name, held in _grouped(batches, len(block)):
            if found := find(name, held, known):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return rows.repartition(*block).sortWithinPartitions(*block).mapInArrow(run, "a long, b long")


def links_with_smallest(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) links between the smallest class of each bucket of (band, key, rep) and its others, at most ``STAR`` of them in a block."""
    low = members.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key", "lo")
    pairs = members.join(low, "key").where("rep > lo").select("lo", "rep").distinct()
    sizes = pairs.groupBy("lo").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    dealt = pairs.join(sizes, "lo").select("lo", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep")
    centres = sizes.select("lo", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.col("lo").alias("rep"))
    rows = dealt.unionByName(centres).join(texts, "rep").select("lo", "part", "rep", "n", "codes", "text")
    return _links(rows, ["lo", "part"], lambda name, held, known: star_links(held, name[0], width, percent, known))


def dealt_blocks(members: DataFrame, groups: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, band, side, rep, comp): the classes of buckets that hold several groups, in the blocks whose pairs may be links.

    A group with ``BLOCK`` classes or more in a bucket has blocks of its own,
    and such blocks of one group never meet: beside a large group of near copies
    the others cost a work in proportion to it. Small groups share blocks, whole
    ones where possible. In a bucket of many blocks classes are dealt by the
    size of their sets as well, and blocks whose sizes cannot reach the
    threshold do not meet. ``sizes`` has the (rep, n) of the classes.
    """
    m = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("comp"))
    counts = m.groupBy("key", "comp").agg(F.count("*").alias("c"))
    small = F.col("c") < BLOCK
    of_key = counts.groupBy("key").agg(F.sum("c").alias("all"), F.sum(F.when(small, F.col("c")).otherwise(0)).alias("shared"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    large = counts.where(~small)
    d = m.join(of_key, "key").join(large, ["key", "comp"], "left").join(sizes, "rep")
    # Sets of sizes on levels further apart than one cannot reach the threshold.
    level = F.when(F.col("all") > 8 * BLOCK, F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("int")).otherwise(0)
    parts = F.ceil(F.coalesce("c", "shared") / BLOCK)
    dealt_by = F.when(F.col("c").isNull(), F.xxhash64("comp")).otherwise(F.xxhash64("rep"))
    own = F.when(F.col("c").isNotNull(), F.col("comp"))
    d = d.select("key", "band", "rep", "comp", own.alias("own"), level.alias("level"), F.pmod(dealt_by, parts).cast("int").alias("part"))
    name = F.concat_ws(":", "level", "part", F.coalesce(F.col("own").cast("string"), F.lit("-")))
    d = d.withColumn("block", name)
    blocks = d.select("key", F.col("block").alias("other"), F.col("own").alias("other_own"), F.col("level").alias("other_level")).distinct()
    meets = (F.abs(F.col("level") - F.col("other_level")) <= 1) & F.coalesce(F.col("own") != F.col("other_own"), F.lit(True))
    pairs = d.join(blocks, "key").where(meets)
    return pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", (F.col("block") <= F.col("other")).cast("int").alias("side"), "rep", "comp")


def bucket_links(members: DataFrame, groups: DataFrame, sketch: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) links found in the buckets of (band, key, rep) that hold several groups of (node, component)."""
    dealt = dealt_blocks(members, groups, sketch.select("rep", "n"), percent)
    block = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held in _grouped(batches, len(block)):
            if wanted := wanted_rows(held, percent):
                found = [(*name, *held[k][:4]) for k in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[*block, "band", "side", "rep", "comp"])

    types = [pa.int64(), *(pa.string(),) * 2, *(pa.int32(),) * 2, pa.int64(), pa.int64()]
    sketched_rows = dealt.join(sketch, "rep").select(*block, "band", "side", "rep", "comp", "n", "keys", "codes")
    wanted = sketched_rows.repartition(*block).sortWithinPartitions(*block).mapInArrow(run, "key long, i string, j string, band int, side int, rep long, comp long")
    rows = wanted.join(texts, "rep").select(*block, "band", "side", "rep", "comp", "n", "keys", "codes", "text")
    return _links(rows, block, lambda _, held, known: block_links(held, width, percent, known))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per input row."""
    ws = Workspace(docs.sparkSession, "near-duplicates")
    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = ws.save(sketched(taken, width, bands, rows))
    classes = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = ws.save(classes.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "keys", "codes"), "doc_id").alias("s")))
    keyed = reps.select("rep", F.posexplode("s.keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = ws.save(keyed.join(shared, "key").select("band", "key", "rep"))
    wanted = members.select("rep").distinct().join(reps.select("rep", F.col("s.n_shingles").alias("n"), "s.keys", "s.codes"), "rep")
    texts = ws.save(wanted.join(taken.where(F.col("text").isNotNull()), F.col("rep") == F.col("doc_id")).drop("doc_id"))
    links = ws.save(links_with_smallest(members, texts, width, percent))
    groups = graphs.components(links, ws)
    more = ws.save(bucket_links(members, groups, texts.drop("text"), texts, width, percent))
    groups = graphs.components(links.unionByName(more), ws)
    of_sig = reps.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    linked_rows = sketch.where(has).select("doc_id", "n_shingles", "sig").join(of_sig, "sig").select("doc_id", "n_shingles", "component_id")
    alone = sketch.where(~has).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked_rows.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def dedup_stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group, their columns as they were, whatever their names; of rows that share a doc_id, the one with the least text."""
    gone = near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct()
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    once = docs.join(gone.unionByName(repeated), "doc_id", "left_anti")
    again = docs.join(repeated.join(gone, "doc_id", "left_anti"), "doc_id", "left_semi")
    every = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    row = F.struct(*every)
    again = again.groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("_row")).select("_row.*")
    return once.select(*every).unionByName(again)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


QUERIES = {"op1_minhash_dedup": op1_minhash_dedup}
ORACLES: dict[str, str] = {}
