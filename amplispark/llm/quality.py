"""Quality rules: a threshold table compiled into one Spark projection.

Every rule compares two measures of a document, ``a * left > b * right`` in
whole numbers, so a verdict never depends on rounding. All measures are built-in
expressions; no user function runs.

The stop words are those of twelve languages; a text in another one is rejected
by ``no_stop_words`` unless ``rules`` leaves that rule out.

Defined cases: a null or empty text has no words and fails the base rule; ties
on a threshold are kept; repeated rows are judged each by itself; an empty table
gives an empty result; other columns of the input are not read, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.llm.common import SPACES, table

# Frequent function words of English, German, French, Spanish, then Italian, Portuguese, Dutch, Swedish, Danish, Polish, Russian and Turkish.
STOP_WORDS = (
    "the of and to a in is that it was for with as on be at by this are from or an "
    "der die und in den von zu das mit sich des auf ist im ein die eine als auch an werden aus er "
    "de la le et les des en un du une que est pour qui dans par sur au plus pas ne avec ce il "
    "el y los se del las con no su para al lo como más o pero sus le ya este entre "
    "il che di non per sono della e do em um não uma os het een van dat niet op te voor "
    "och att det som på är inte og til ikke af i w na z się że nie jest и в не на что с по как это ve bir bu için ile"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects a document when ``a * left > b * right``."""

    name: str
    a: int
    left: str
    b: int
    right: str
    base: bool = False

    def fails(self) -> Column:
        return F.lit(self.a) * F.col(self.left) > F.lit(self.b) * F.col(self.right)

    def sql(self) -> str:
        return f"{self.a} * {self.left} > {self.b} * {self.right}"


#: ``one`` is the constant 1. The two base rules come from the contract of the query.
RULES = (
    Rule("too_short", 50, "one", 1, "n_words", base=True),
    Rule("repeated_windows", 100, "n_repeat_words", 50, "n_words", base=True),
    Rule("words_too_short", 2, "n_words", 1, "word_chars"),
    Rule("words_too_long", 1, "word_chars", 15, "n_words"),
    Rule("symbols", 100, "n_symbols", 30, "n_words"),
    Rule("repeated_lines", 100, "n_dup_lines", 30, "n_lines"),
    Rule("no_stop_words", 1, "n_words", 100, "n_stop_words"),
)


def _stop_forms(words: tuple[str, ...] | list[str]) -> list[str]:
    """Each stop word as it stands and with a capital."""
    return sorted({form for w in words for form in (w, w[:1].upper() + w[1:])})


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words=tuple(STOP_WORDS)) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words), a row per input row.

    Repeats are found by sorting the hashes of a text's 3-word windows, in
    n log n, and only for texts that have an equal pair.
    """
    stop = _stop_forms(stop_words)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    split = base.select(
        "doc_id",
        "_t",
        F.filter(F.split("_t", SPACES, -1), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0).alias("_lines"),
    )
    hashed = split.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.when(
            F.size("_w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))),
        ).alias("_h"),
    )
    paired = hashed.withColumn(
        "_p",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda p, at: F.coalesce(F.get("_p", at)["h"] == p["h"], F.lit(False))
    starts = paired.withColumn(
        "_d",
        F.array_sort(F.transform(F.filter("_p", lambda p, j: same(p, j - 1) | same(p, j + 1)), lambda p: p["i"])),
    )
    fresh = F.transform("_d", lambda x, j: F.least(F.lit(3), x - F.get("_d", j - 1)))
    return starts.withColumn(
        "n_repeat_words", F.coalesce(F.aggregate(fresh, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long")
    ).drop("_h", "_p", "_d")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures with ``base_failed``, ``kept`` and ``failed`` (names of the rules that reject), a row per input row."""
    m = measures(docs, id_col, text_col).withColumn("one", F.lit(1).cast("long"))
    base = F.lit(False)
    for r in rules:
        base = base | r.fails() if r.base else base
    failed = F.filter(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return (
        m.withColumn("base_failed", base)
        .withColumn("failed", failed)
        .withColumn("kept", F.size("failed") == 0)
        .drop("one")
    )


def quality_stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with their columns as they were."""
    held = docs.select(F.struct("*").alias("_row"), F.col("text"))
    # The row number keeps the optimizer from copying the measures into the filter, where each would be computed again.
    judged = quality_rules(held, id_col="_row", text_col="text").withColumn("_n", F.monotonically_increasing_id())
    return judged.where("kept AND _n >= 0").select("doc_id.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """DuckDB SQL for :func:`op7_quality_rules`."""
    stop = ", ".join(f"'{w}'" for w in _stop_forms(STOP_WORDS))
    base = " OR ".join(f"({r.sql()})" for r in RULES if r.base)
    any_ = " OR ".join(f"({r.sql()})" for r in RULES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT rid, doc_id, t,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), wins AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM s WHERE len(w) >= 3)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n >= 2
), cover AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid
), m AS (
  SELECT s.doc_id, CAST(1 AS BIGINT) AS one, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(w, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM s LEFT JOIN cover c ON s.rid = c.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({base}) AS base_failed, NOT ({any_}) AS kept
FROM m
"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": oracle()}
