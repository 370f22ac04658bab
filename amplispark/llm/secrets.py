"""Secret scans over a ledger of content-addressed blobs, in DataFrame functions only.

Every historical version of a file is addressed by the SHA-256 of its text. A
ledger says which (blob, rule version) pairs have been scanned and what was
found; a scan reads the text of a blob once, applies only the rules the ledger
lacks, and joins the findings back to every path that holds the blob. So copies
cost one scan, and a new rule version is the only thing that makes old blobs be
read again.

Offsets count code points, ends are exclusive. Built-in functions give no match
offsets, so they are summed from the pieces between the matches.

Defined cases: a null text is the empty text; an empty text has no findings;
repeated rows each get the findings of their blob; an empty table gives an empty
result; other columns are not read; very many matches in one text are all kept,
in time in proportion to them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.llm.common import Workspace, let, table

_SPAN = "struct<start:int,end:int>"
#: Matches that are folded together; the work of n matches is n * _CHUNK + (n / _CHUNK) ** 2 small steps.
_CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap, of which ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # of [0-9a-f]+ the matches of 32 and more: both take whole runs
)


def running(values: Column, zero: int, add: Callable[[Column, Column], Column]) -> Column:
    """What the values before each place of an array<int> add up to, ``add`` being a sum or a maximum.

    Folded in two levels, as an array that grows by one copies what it has:
    chunks of ``_CHUNK`` values by themselves, and the chunks' totals.
    """
    grown = lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))
    before = lambda items, first: F.slice(F.aggregate(items, F.array(first), grown), F.lit(1), F.size(items))

    def of(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(zero), add))
        return F.flatten(F.zip_with(chunks, before(totals, F.lit(zero)), before))

    return let(chunked(values), of)


def chunked(items: Column) -> Column:
    """An array in pieces of at most ``_CHUNK``."""
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / _CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * _CHUNK + 1, F.lit(_CHUNK)))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    pieces = F.struct(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("match"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"),
    )

    def located(p: Column) -> Column:
        # Before match i lie the matches and gaps before it, and the gap of its own.
        sizes = F.zip_with(p["match"], F.slice(p["gap"], F.lit(1), F.size(p["match"])), lambda m, g: m + g)
        start = lambda before, i: before + F.get(p["gap"], i)
        every = F.transform(running(sizes, 0, lambda x, y: x + y), lambda x, i: F.struct(start(x, i).alias("start"), (start(x, i) + F.get(p["match"], i)).alias("end"), F.get(p["value"], i).alias("n")))
        return F.transform(F.filter(every, lambda x: x["n"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return F.when(F.regexp_like(text, pattern), let(pieces, located)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger after a scan of ``versions``: (blob, scanned), a row per distinct text.

    ``scanned`` maps "kind@version" to the spans found. With the ledger of
    earlier scans (same columns) only unseen pairs are scanned, and blobs that
    ``versions`` lack stay as they are.
    """
    texts = versions.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("blob", blob_of(F.col("_text")))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = texts.groupBy("blob").agg(F.first("_text").alias("_text"))
        return blobs.select("blob", F.map_from_arrays(keys, F.array(*[spans(F.col("_text"), r) for r in rules])).alias("scanned"))
    # Digests first: a text is only sent on where a rule has not read it, and what the ledger knows of a blob is kept.
    known = F.coalesce("scanned", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<array<{_SPAN}>>")))
    held = texts.select("blob").distinct().join(ledger.select("blob", "scanned"), "blob", "left").select("blob", known.alias("_known"))
    unseen = held.where(F.size(F.array_except(keys, F.map_keys("_known"))) > 0)
    blobs = texts.join(unseen, "blob").groupBy("blob").agg(F.first("_text").alias("_text"), F.first("_known").alias("_known"))
    found = [F.coalesce(F.element_at("_known", F.lit(r.key)), spans(F.col("_text"), r)) for r in rules]
    others = F.map_filter("_known", lambda k, _: ~k.isin([r.key for r in rules]))
    scanned = blobs.select("blob", F.map_concat(others, F.map_from_arrays(keys, F.array(*found))).alias("scanned"))
    return scanned.unionByName(ledger.select("blob", "scanned").join(unseen.select("blob"), "blob", "left_anti"))


def scan_in_steps(versions: DataFrame, ws: Workspace, steps: int = 2, rules: tuple[Rule, ...] = RULES, text_col: str = "text", key_col: str = "doc_id", ledger: DataFrame | None = None) -> DataFrame:
    """The ledger after ``steps`` scans, as they follow each other while versions come in: each takes a part of the versions, dealt by key, and what the one before knows.

    A text that an earlier step has read is not read again, whatever paths hold it.
    """
    parts = versions.withColumn("_step", F.pmod(F.xxhash64(F.col(key_col)), F.lit(steps)))
    for k in range(steps):
        ledger = ws.save(scan(parts.where(F.col("_step") == k), ledger, rules, text_col))
    return ledger


def findings(scanned: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<start, rank, end, kind>> of all rules, by start and then by the order of the rules."""

    def of(k: int, r: Rule) -> Column:
        named = lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end"), F.lit(r.kind).alias("kind"))
        return F.transform(F.element_at(scanned, F.lit(r.key)), named)

    return F.array_sort(F.concat(*[of(k, r) for k, r in enumerate(rules)]))


def joined_back(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of every version with ``spans``, the findings of its blob (an empty array where there are none)."""
    paths = versions.select(*(carry or ["doc_id"]), blob_of(F.coalesce(F.col(text_col), F.lit(""))).alias("_blob"))
    hits = ledger.select(F.col("blob").alias("_blob"), findings(F.col("scanned"), rules).alias("_spans")).where(F.size("_spans") > 0)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return paths.join(hits, "_blob", "left").withColumn("spans", F.coalesce("_spans", none)).drop("_blob", "_spans")


def written(spans_col: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans_col: Column, mask: str = "[SECRET]") -> Column:
    """The text with every found span, overlapping ones merged, replaced by ``mask``.

    Of chunks of spans the stretch of text that they lie in is cut first, as to
    cut a piece is to count the letters before it.
    """

    def pieces(chunk: Column, base: Column) -> Column:
        end = F.element_at(chunk, -1)["to"]
        return let(F.substring(text, base + 1, end - base), lambda t: F.array_join(F.transform(chunk, lambda x: F.concat(F.substring(t, x["from"] - base + 1, x["to"] - x["from"]), F.lit(mask))), ""))

    def joined(at: Column) -> Column:
        gaps = F.filter(F.zip_with(at["before"], spans_col, lambda b, s: F.struct(b.alias("from"), s["start"].alias("to"))), lambda x: x["to"] >= x["from"])
        parts = F.transform(chunked(gaps), lambda c: pieces(c, F.element_at(c, 1)["from"]))
        last = F.array_max(F.transform(spans_col, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

    before = running(F.transform(spans_col, lambda s: s["end"]), 0, lambda x, y: F.greatest(x, y))
    return F.when(F.size(spans_col) == 0, text).otherwise(let(F.struct(before.alias("before")), joined))


def secret_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of each text masked and ``n_chars`` as it is then; a null text stays null."""
    names = docs.columns
    held = docs.select(F.struct("*").alias("_row"), F.col("text"), F.col("doc_id"))
    back = joined_back(held, scan_in_steps(held, Workspace(docs.sparkSession, "ledger")), carry=["_row", "text"])
    new = back.withColumn("_new", F.when(F.col("text").isNotNull(), masked(F.col("text"), F.col("spans"))))
    changed = {"text": F.col("_new"), "n_chars": F.when(F.size("spans") > 0, F.length("_new").cast("long")).otherwise(F.col("_row.n_chars"))}
    return new.select(*[(changed[c] if c in changed else F.col("_row")[c]).alias(c) for c in names])


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = joined_back(docs, scan_in_steps(docs, Workspace(spark, "ledger")))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id",
        *[count(r.kind) for r in RULES],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def oracle() -> str:
    """DuckDB SQL for :func:`op2_secret_scans`, without the ledger."""
    any_case = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {"assign": f"({any_case})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", "access": RULES[1].pattern, "hex": RULES[2].pattern}
    each = "\nUNION ALL\n".join(
        f"""SELECT rid, {k} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, '{patterns[r.kind]}') AS gap,
       regexp_extract_all(t, '{patterns[r.kind]}', 0) AS match, regexp_extract_all(t, '{patterns[r.kind]}', {r.group}) AS value
FROM d WHERE regexp_matches(t, '{patterns[r.kind]}')"""
        for k, r in enumerate(RULES)
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
e AS (SELECT *, unnest(generate_series(1, len(match))) AS i FROM m),
s AS (
  SELECT rid, rank, kind, len(match[i]) AS n,
         list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(match[1:i - 1], lambda x: length(x))), 0) AS start
  FROM e WHERE length(value[i]) >= least
),
g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY rid
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.rid = g.rid
"""


QUERIES = {"op2_secret_scans": op2_secret_scans}
ORACLES = {"op2_secret_scans": oracle()}
