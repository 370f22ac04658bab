"""Queries over graded sites, genomes and years, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.functions import grading
from amplispark.operators import inclusivity
from amplispark.plans.catalogue import register
from amplispark.plans.sequences import BEST_SQL, best
from amplispark.plans.synthetic import CONTIGS, FORWARD, OLIGOS, PROBE, duck, view


def _mutant(oligo: str, step: int) -> str:
    """SQL for an oligo with one to three exchanged bases, by key."""
    n = len(oligo)
    one = lambda s, at, b: f"substr({s}, 1, CAST({at} AS INT)) || substr('ACGT', CAST(1 + {b} AS INT), 1) || substr({s}, CAST(2 + {at} AS INT))"
    first = one(f"'{oligo}'", f"(p_partkey % {n})", "p_partkey % 4")
    second = one(f"({first})", f"((p_partkey * {step}) % {n})", "(p_partkey + 1) % 4")
    third = one(f"({second})", f"((p_partkey * {step + 2}) % {n})", "p_size % 4")
    return f"CASE p_size % 4 WHEN 0 THEN '{oligo}' WHEN 1 THEN {first} WHEN 2 THEN {second} ELSE {third} END"


PRIMERS = f"SELECT CAST(p_partkey AS BIGINT) AS k, '{FORWARD}' AS q, {_mutant(FORWARD, 7)} AS s FROM {{part}}"
PROBES = f"SELECT CAST(p_partkey AS BIGINT) AS k, '{PROBE}' AS q, {_mutant(PROBE, 5)} AS s, p_partkey % 2 = 0 AS mgb FROM {{part}}"


def primer_sql(q: str, s: str) -> str:
    """SQL for the rank of an ungapped primer site without ambiguity."""
    m = f"list_filter(list_transform(generate_series(1, length({q})), lambda i: {{'pos': length({q}) - i + 1, 'a': substr({q}, i, 1), 'b': translate(substr({s}, i, 1), 'ACGT', 'TGCA')}}), lambda x: x.a <> translate(x.b, 'ACGT', 'TGCA'))"
    one = """CASE WHEN x.pos = 1 THEN CASE WHEN x.a || '-' || x.b IN ('C-A', 'A-C', 'G-T', 'T-G') THEN 1 WHEN x.a || '-' || x.b IN ('T-T', 'T-C', 'C-T') THEN 2 ELSE 3 END
      WHEN x.pos = 2 AND x.a || '-' || x.b NOT IN ('C-A', 'A-C', 'G-T', 'T-G', 'T-T', 'T-C', 'C-T') THEN 2 ELSE 1 END"""
    return f"""(SELECT {{'rank': CASE WHEN len(o) = 0 THEN inner_rank WHEN len(i) = 0 THEN CASE WHEN len(o) <= 4 THEN 1 ELSE 2 END ELSE greatest(inner_rank, 2) END,
    'rule': CASE WHEN len(o) = 0 THEN inner_rule WHEN len(i) = 0 THEN 'R3b' ELSE inner_rule || '+R3b' END, 'n': len(o) + len(i), 'inner': len(i)}} FROM (
  SELECT *, CASE WHEN len(i) = 0 THEN 0 WHEN len(i) = 1 THEN singles[1]
      WHEN len(l) >= 2 AND len(list_filter(l, lambda x: x.pos = 1)) > 0 THEN 3 WHEN len(i) = 2 THEN greatest(2, coalesce(list_max(last_singles), 1))
      WHEN len(i) = 4 AND len(l) = 0 AND len(o) = 0 AND list_max(list_transform(i, lambda x: x.pos)) - list_min(list_transform(i, lambda x: x.pos)) = 3 THEN 2 ELSE 3 END AS inner_rank,
    CASE WHEN len(i) = 0 THEN '' WHEN len(i) = 1 AND i[1].pos <= 5 THEN 'R1' WHEN len(i) = 1 THEN 'R2' ELSE 'R3' END AS inner_rule
  FROM (SELECT i, o, l, list_transform(i, lambda x: {one}) AS singles, list_transform(l, lambda x: {one}) AS last_singles
    FROM (SELECT list_filter(m, lambda x: x.pos <= 16) AS i, list_filter(m, lambda x: x.pos > 16) AS o, list_filter(m, lambda x: x.pos <= 5) AS l FROM (SELECT {m} AS m)))))"""


def probe_sql(q: str, s: str, mgb: str) -> str:
    m = f"list_filter(generate_series(1, length({q})), lambda i: substr({q}, length({q}) - i + 1, 1) <> substr({s}, length({q}) - i + 1, 1))"
    return f"""(SELECT {{'rank': CASE WHEN len(m) = 0 THEN 0 WHEN {mgb} THEN CASE WHEN len(m) = 1 AND m[1] > 7 THEN 4 ELSE 3 END
    WHEN len(m) = 1 AND m[1] > 5 THEN 1 WHEN len(m) <= 2 THEN 2 ELSE 3 END, 'rule': CASE WHEN len(m) = 0 THEN '' ELSE 'R9' END, 'n': len(m), 'inner': len(m)}} FROM (SELECT {m} AS m))"""


_CLASS = "['perfect', 'tolerated', 'at_risk', 'likely_failure', 'indeterminate']"
register(
    "grade_primer",
    lambda s, d: view(s, d, PRIMERS).select("k", grading.grade(F.col("q"), F.col("s"), F.lit("forward"), F.lit(False)).alias("g")).select("k", "g.*"),
    f"SELECT k, {_CLASS}[g.rank + 1] AS class, g.rule AS rule, CAST(g.n AS INTEGER) AS mismatches FROM (SELECT k, {primer_sql('q', 's')} AS g FROM {duck(PRIMERS)})",
)
register(
    "grade_probe",
    lambda s, d: view(s, d, PROBES).select("k", grading.grade(F.col("q"), F.col("s"), F.lit("probe"), F.col("mgb")).alias("g")).select("k", "g.*"),
    f"SELECT k, {_CLASS}[g.rank + 1] AS class, g.rule AS rule, CAST(g.n AS INTEGER) AS mismatches FROM (SELECT k, {probe_sql('q', 's', 'mgb')} AS g FROM {duck(PROBES)})",
)
register(
    "pair_rule",
    lambda s, d: view(s, d, "SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS INT) AS n, CAST(l_quantity AS INT) % 6 AS f, CAST(l_partkey % 6 AS INT) AS r FROM {lineitem}").select("k", "n", grading.pair_fails(F.col("f"), F.col("r")).alias("fails")),
    "SELECT l_orderkey AS k, l_linenumber AS n, (greatest(f, r) >= 3 AND least(f, r) >= 2) OR (greatest(f, r) >= 4 AND least(f, r) >= 1) AS fails FROM (SELECT *, CAST(l_quantity AS INT) % 6 AS f, l_partkey % 6 AS r FROM lineitem)",
)

#: A laboratory result for two thirds of the sites of the graded primers, by how many A they have.
EVIDENCE = f"SELECT DISTINCT s AS site, CASE length(replace(s, 'A', '')) % 3 WHEN 0 THEN 'detected' WHEN 1 THEN 'not_detected' END AS observed FROM ({PRIMERS}) t"


def _with_evidence(spark: SparkSession, sf: str) -> DataFrame:
    graded = view(spark, sf, PRIMERS).select("k", F.col("s").alias("site"), grading.grade(F.col("q"), F.col("s"), F.lit("forward"), F.lit(False))["class"].alias("class"))
    joined = graded.join(view(spark, sf, EVIDENCE), "site", "left")
    return joined.select("k", grading.with_evidence(F.col("class"), F.col("observed")).alias("class"), F.col("observed").isNotNull().alias("tested"))


register(
    "lab_evidence",
    _with_evidence,
    f"""SELECT k, CASE observed WHEN 'detected' THEN 'tolerated' WHEN 'not_detected' THEN 'likely_failure' ELSE {_CLASS}[g.rank + 1] END AS class, observed IS NOT NULL AS tested
FROM (SELECT k, s, {primer_sql('q', 's')} AS g FROM {duck(PRIMERS)}) p LEFT JOIN {duck(EVIDENCE)} e ON p.s = e.site""",
)


def genomes(spark: SparkSession, sf: str) -> DataFrame:
    return inclusivity.genome_outcomes(best(spark, sf), view(spark, sf, CONTIGS), OLIGOS)


_graded = " UNION ALL ".join(
    f"SELECT accession, '{name}' AS oligo, mismatches, site, {probe_sql(repr(o), 'site', 'false') if name == 'probe' else primer_sql(repr(o), 'site')} AS g FROM best WHERE oligo = '{name}' AND NOT contains(site, 'N')"
    for name, o in OLIGOS
)
GENOMES_SQL = f"""{BEST_SQL}, graded AS ({_graded}),
masked AS (SELECT DISTINCT accession FROM best WHERE contains(site, 'N')),
wide AS (
  SELECT g.accession, g.release_year, g.level, g.taxid, count(r.oligo) AS n_sites, bool_or(m.accession IS NOT NULL) AS masked,
    min(CASE WHEN r.g.rank = 3 THEN 0 WHEN r.g.rank = 2 THEN 1 WHEN r.g.rank = 4 THEN 2 ELSE 3 END) AS worst,
    max(r.g.inner) FILTER (r.oligo = 'forward') AS f, max(r.g.inner) FILTER (r.oligo = 'reverse') AS rv, coalesce(sum(r.g.n), 0) AS mismatches
  FROM g LEFT JOIN graded r ON r.accession = g.accession LEFT JOIN masked m ON m.accession = g.accession GROUP BY ALL
), genomes AS (
  SELECT accession, release_year, level, taxid, CAST(mismatches AS BIGINT) AS mismatches, CASE WHEN masked THEN 'masked' WHEN n_sites = 0 THEN 'not_found' WHEN n_sites < 3 THEN 'no_site'
    ELSE ['likely_failure', 'at_risk', 'undetermined', 'detectable'][1 + least(worst, CASE WHEN (greatest(f, rv) >= 3 AND least(f, rv) >= 2) OR (greatest(f, rv) >= 4 AND least(f, rv) >= 1) THEN 0 ELSE 3 END)] END AS outcome
  FROM wide
)"""
register("genome_outcome", genomes, f"WITH {GENOMES_SQL} SELECT accession, release_year, level, taxid, mismatches, outcome FROM genomes")
_YEARS_SQL = f"""{GENOMES_SQL}, years AS (
  SELECT release_year AS year, count(*) AS listed, count(*) FILTER (outcome IN ('likely_failure', 'at_risk', 'undetermined', 'detectable')) AS with_region,
    count(*) FILTER (outcome = 'detectable') AS detectable, count(*) FILTER (outcome = 'at_risk') AS at_risk, count(*) FILTER (outcome = 'likely_failure') AS likely_failure,
    count(*) FILTER (outcome = 'undetermined') AS undetermined, count(*) FILTER (outcome = 'masked') AS masked
  FROM genomes GROUP BY 1)"""
register(
    "detection_by_year",
    lambda s, d: inclusivity.years(genomes(s, d)),
    f"""WITH {_YEARS_SQL} SELECT *, CASE WHEN with_region - undetermined > 0 THEN round(100.0 * (detectable + at_risk) / (with_region - undetermined), 6) END AS percent FROM years""",
)
register(
    "status_window",
    lambda s, d: inclusivity.pooled(inclusivity.years(genomes(s, d)), 3),
    f"""WITH {_YEARS_SQL} SELECT year, CAST(sum(with_region) OVER w AS BIGINT) AS with_region, CAST(sum(detectable) OVER w AS BIGINT) AS detectable, CAST(sum(undetermined) OVER w AS BIGINT) AS undetermined
FROM years WINDOW w AS (ORDER BY year RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
register(
    "inclusivity_verdict",
    lambda s, d: inclusivity.verdict(inclusivity.years(genomes(s, d)), 3, least=30),
    f"""WITH {_YEARS_SQL}, t AS (SELECT CAST(sum(with_region) AS BIGINT) AS with_region, CAST(sum(detectable + at_risk) AS BIGINT) AS detected, CAST(sum(undetermined) AS BIGINT) AS undetermined,
  coalesce(bool_or(with_region - undetermined >= 30 AND 100.0 * (detectable + at_risk) / (with_region - undetermined) < 80), false) AS drop
  FROM years WHERE year >= (SELECT max(year) - 3 FROM years)),
p AS (SELECT *, with_region - undetermined AS n, CASE WHEN with_region - undetermined > 0 THEN 100.0 * detected / (with_region - undetermined) END AS pct FROM t)
SELECT with_region, detected, undetermined, round(pct, 6) AS percent, CASE WHEN with_region = 0 OR n < 30 THEN 'INCOMPLETE' WHEN undetermined > 0.25 * (n + undetermined) THEN 'INCOMPLETE'
  WHEN pct < 80 THEN 'FAIL' WHEN pct < 95 THEN 'WARN' WHEN drop THEN 'WARN' ELSE 'PASS' END AS status FROM p""",
)
register(
    "level_coverage",
    lambda s, d: inclusivity.by_level(genomes(s, d)),
    f"""WITH {GENOMES_SQL} SELECT level, count(*) FILTER (outcome = 'detectable') AS detectable, count(*) FILTER (outcome = 'at_risk') AS at_risk, count(*) FILTER (outcome = 'likely_failure') AS likely_failure,
count(*) FILTER (outcome = 'undetermined') AS undetermined, count(*) FILTER (outcome = 'not_found') AS not_found FROM genomes GROUP BY 1""",
)

def _escape_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return inclusivity.escapes(inclusivity.missed_genomes(genomes(spark, sf)), view(spark, sf, CONTIGS)).withColumnRenamed("kind", "reason")


register(
    "escape_reasons",
    _escape_reasons,
    f"""WITH {GENOMES_SQL}, e AS (SELECT accession, level, CASE WHEN mismatches >= 4 THEN 'pair' ELSE 'mismatch' END AS reason FROM genomes WHERE outcome = 'likely_failure'),
r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY accession) AS n FROM e)
SELECT reason, count(*) AS genomes, count(*) FILTER (level = 'complete') AS complete, string_agg(accession, ',' ORDER BY accession) FILTER (n <= 10) AS examples FROM r GROUP BY 1""",
)
register(
    "copy_coverage",
    lambda s, d: inclusivity.coverage(genomes(s, d)),
    f"""WITH {GENOMES_SQL} SELECT count(*) AS listed, count(*) FILTER (outcome NOT IN ('not_found', 'masked')) AS found, count(*) FILTER (outcome = 'not_found') AS not_found, count(*) FILTER (outcome = 'masked') AS masked,
count(*) FILTER (outcome = 'no_site') AS cut, count(*) FILTER (outcome IN ('detectable', 'at_risk')) AS detected FROM genomes""",
)
_VARIANTS_SQL = f"""{BEST_SQL}, v AS (SELECT oligo, site, count(*) AS n, CAST(min(release_date) AS VARCHAR) AS first_seen, CAST(max(release_date) AS VARCHAR) AS last_seen, min(b.accession) AS example
  FROM best b JOIN g USING (accession) WHERE NOT contains(site, 'N') GROUP BY 1, 2)"""
register(
    "oligo_variants",
    lambda s, d: inclusivity.oligo_variants(best(s, d), view(s, d, CONTIGS)),
    f"WITH {_VARIANTS_SQL} SELECT oligo, site, n, round(100.0 * n / sum(n) OVER (PARTITION BY oligo), 6) AS percent, first_seen, last_seen, example FROM v",
)
register(
    "distinct_patterns",
    lambda s, d: inclusivity.patterns(best(s, d)),
    f"""WITH {BEST_SQL}, w AS (SELECT accession, max(site) FILTER (oligo = 'forward') AS f, max(site) FILTER (oligo = 'probe') AS p, max(site) FILTER (oligo = 'reverse') AS r FROM best GROUP BY 1),
x AS (SELECT f, p, r, count(*) AS n FROM w WHERE f IS NOT NULL AND p IS NOT NULL AND r IS NOT NULL GROUP BY ALL)
SELECT count(*) AS patterns, CAST(sum(n) AS BIGINT) AS genomes, max(n) AS largest FROM x""",
)
_POS = " UNION ALL ".join(f"SELECT accession, oligo, site, '{o}' AS q FROM best WHERE oligo = '{n}'" for n, o in OLIGOS)
register(
    "mismatch_positions",
    lambda s, d: inclusivity.positions(best(s, d), OLIGOS),
    f"""WITH {BEST_SQL}, x AS ({_POS}), e AS (SELECT oligo, length(q) - i + 1 AS pos, substr(q, i, 1) AS base, substr(site, i, 1) AS seen FROM (SELECT *, unnest(generate_series(1, length(q))) AS i FROM x))
SELECT oligo, CAST(pos AS INTEGER) AS pos, base, count(*) FILTER (seen = 'A') AS "A", count(*) FILTER (seen = 'C') AS "C", count(*) FILTER (seen = 'G') AS "G", count(*) FILTER (seen = 'T') AS "T", count(*) FILTER (seen = 'N') AS "N"
FROM e WHERE seen <> base GROUP BY 1, 2, 3""",
)
