"""Sharding by weighted rendezvous hashing.

Each shard bids for each record with a hash of (key, shard); the best bid wins.
Key and shard list alone decide, so another shard takes rows only into itself,
and nothing moves between the old ones. Law of the result: ``key``.

Equal rows are counted before anything is shuffled, and get their slots as one
range that is dealt out in pieces, so that neither a key nor a group of copies
gathers in a task.

Defined cases: a null key is hashed as the empty string; rows of one key share a
shard, repeated rows too, each with a slot of its own; a null text has size 1
and the checksum of nothing; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amplispark.llm.common import table

#: Rows of one slot-numbering task, about; the hash prefix that deals them out grows with the count of rows.
ROWS_PER_BUCKET = 50_000
#: Equal rows that are written out together.
PIECE = 1_000
_BITS = 52


def _unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the hash of (key, shard): the first 13 hex digits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{shard}")).cast("binary")), 1, _BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**_BITS))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the best bid ``ln(u) / weight``; of equal bids the smallest number."""
    bids = [F.struct((F.log(_unit(key, s)) / F.lit(float(w))).alias("bid"), F.lit(-s).alias("minus")) for s, w in enumerate(weights)]
    best = F.greatest(*bids) if len(bids) > 1 else bids[0]
    return (-best["minus"]).cast("int")


def with_first_slots(groups: DataFrame, shard_col: str, n_col: str, order: list[str], n_rows: int) -> DataFrame:
    """Adds ``first_slot`` to groups of rows: slots are gapless from 0 in each shard, in the order of ``_digest`` and then ``order``.

    A shard's groups are dealt over buckets by a prefix of that digest, counted
    there, and numbered bucket by bucket with the counts of earlier buckets
    added, so no task sees a whole shard.
    """
    digits = 1
    while 16**digits * ROWS_PER_BUCKET < n_rows and digits < 6:
        digits += 1
    groups = groups.withColumn("_b", F.substring("_digest", 1, digits))
    before = lambda n, by, *of: F.coalesce(F.sum(n).over(Window.partitionBy(*of).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = groups.groupBy(shard_col, "_b").agg(F.sum(n_col).alias("_n"))
    starts = counts.select(shard_col, "_b", before("_n", ["_b"], shard_col).alias("_start"))
    own = groups.withColumn("_own", before(n_col, ["_digest", *order], shard_col, "_b"))
    return own.join(starts, [shard_col, "_b"]).withColumn("first_slot", F.col("_start") + F.col("_own")).drop("_b", "_own", "_start")


def shard_records(docs: DataFrame, weights: list[float] | None = None, key_col: str = "doc_id", text_col: str = "text", more: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row per input row.

    ``weights`` has one positive weight per shard (16 equal ones by default);
    ``more`` is the weight of the shard that ``grown_shard`` has besides.
    """
    weights = [1.0] * 16 if weights is None else list(weights)
    if not weights or min([*weights, more]) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(key_col).alias("doc_id"), key.alias("_key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    groups = rows.groupBy("doc_id", "_key", "size", "text_crc32").agg(F.count("*").alias("_n")).select(
        "doc_id", "size", "text_crc32", "_n", shard_of(F.col("_key"), weights).alias("shard"), shard_of(F.col("_key"), [*weights, more]).alias("grown_shard"),
        F.md5(F.concat_ws("|", "_key", "size", "text_crc32").cast("binary")).alias("_digest"),
    )
    slotted = with_first_slots(groups, "shard", "_n", ["doc_id", "size", "text_crc32"], docs.count())
    pieces = slotted.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(PIECE).cast("long")))).repartition("_digest", "_at")
    slot = F.explode(F.sequence(F.col("first_slot") + F.col("_at"), F.col("first_slot") + F.least(F.col("_at") + PIECE, F.col("_n")) - 1))
    return pieces.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"))


QUERIES = {"op9_rendezvous_sharding": op9_rendezvous_sharding}
ORACLES: dict[str, str] = {}
