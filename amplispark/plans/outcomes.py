"""Queries over missed genomes, coverage, labels and the overall verdict, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.operators import inclusivity, outcomes
from amplispark.plans.catalogue import register
from amplispark.plans.synthetic import dna, duck, view

_FAILS = "SELECT CAST(o_orderkey AS BIGINT) AS accession, CAST(l_linenumber AS INT) AS role, CASE WHEN l_returnflag = 'N' THEN 'ok' ELSE 'fail' END AS state, l_partkey % 4 = 0 AS alone_ok, CAST(l_suppkey % 4 AS INT) AS mismatches, CAST(l_partkey % 3 AS INT) AS gaps, l_partkey % 5 = 1 AS by_run, o_custkey % 9 = 0 AS rescued FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
_KINDS_SQL = f"""WITH f AS (SELECT *, CASE WHEN alone_ok THEN 3 WHEN by_run AND mismatches = 0 THEN 4 WHEN gaps > 0 THEN 1 ELSE 2 END AS r FROM {duck(_FAILS)} WHERE state = 'fail')
SELECT accession, CASE WHEN bool_or(rescued) THEN 'run_length' ELSE ['gap', 'mismatch', 'pair', 'run_length'][min(r)] END AS kind FROM f GROUP BY 1"""
register("escape_kinds", lambda s, d: outcomes.escape_kinds(view(s, d, _FAILS)), _KINDS_SQL)
_LEVELS = "SELECT CAST(o_orderkey AS BIGINT) AS accession, CASE WHEN o_orderkey % 4 = 0 THEN 'complete' ELSE 'contig' END AS level FROM {orders}"
register(
    "escapes_by_kind",
    lambda s, d: inclusivity.escapes(outcomes.escape_kinds(view(s, d, _FAILS)), view(s, d, _LEVELS)),
    f"""WITH k AS ({_KINDS_SQL}), r AS (SELECT k.*, level, row_number() OVER (PARTITION BY kind ORDER BY accession) AS n FROM k JOIN {duck(_LEVELS)} USING (accession))
SELECT kind, count(*) AS genomes, count(*) FILTER (level = 'complete') AS complete, string_agg(accession::VARCHAR, ',' ORDER BY accession) FILTER (n <= 10) AS examples FROM r GROUP BY 1""",
)
_GAPPED = f"""SELECT CAST(p_partkey AS BIGINT) AS k, CAST(1 + p_size % 3 AS INT) AS n, CAST(p_partkey % 3 AS INT) AS what,
CASE p_partkey % 3 WHEN 0 THEN substr({dna('p_partkey')}, 1, 6) || repeat('-', CAST(1 + p_size % 3 AS INT)) || substr({dna('p_partkey')}, 7, 14) WHEN 1 THEN substr({dna('p_partkey')}, 1, 20) ELSE 'YR' || substr({dna('p_partkey')}, 3, 18) END AS q,
CASE p_partkey % 3 WHEN 0 THEN substr({dna('p_partkey')}, 1, 6) || repeat('A', CAST(1 + p_size % 3 AS INT)) || substr({dna('p_partkey')}, 7, 14) WHEN 1 THEN substr({dna('p_partkey')}, 1, 4) || repeat('-', CAST(1 + p_size % 3 AS INT)) || substr({dna('p_partkey')}, CAST(6 + p_size % 3 AS INT), 20) ELSE 'T' || substr('ACGN.', CAST(1 + p_size % 5 AS INT), 1) || substr({dna('p_partkey')}, 3, 18) END AS s FROM {{part}}"""
register(
    "described_changes",
    lambda s, d: view(s, d, _GAPPED, spread=True).select("k", outcomes.described_changes(F.col("q"), F.substring("s", F.lit(1), F.length("q"))).alias("changes")),
    f"""SELECT k, CASE what WHEN 0 THEN CASE n WHEN 1 THEN 'insertion' ELSE n || '-base insertion' END || ' between -15 and -14'
WHEN 1 THEN CASE n WHEN 1 THEN '-16 deleted' ELSE '-16 to -' || (17 - n) || ' deleted (' || n || ' bases)' END
ELSE '-20 Y=T, ' || CASE substr(s, 2, 1) WHEN 'A' THEN '-19 R=A' WHEN 'G' THEN '-19 R=G' WHEN 'C' THEN '-19 R/C' WHEN 'N' THEN '-19 R=N' ELSE '-19 unaligned' END END AS changes FROM {duck(_GAPPED)}""",
)
_LISTED = "SELECT CAST(o_orderkey AS BIGINT) AS accession, CAST(year(o_orderdate) AS INT) AS year, o_orderkey % 3 > 0 AS done, o_custkey % 5 = 0 AS lost FROM {orders}"
register(
    "year_coverage",
    lambda s, d: outcomes.year_coverage(view(s, d, _LISTED).select("accession", "year"), view(s, d, _LISTED).where("done"), view(s, d, _LISTED).where("lost")),
    f"SELECT year, count(*) AS listed, count(*) FILTER (done) AS assessed, count(*) FILTER (lost AND NOT done) AS unavailable FROM {duck(_LISTED)} GROUP BY 1",
)
_PARTIAL = "SELECT CAST(l_orderkey AS BIGINT) AS hit, CAST(l_linenumber AS INT) AS hsp, CAST(l_quantity AS INT) % 9 AS lower_bound, CAST(l_suppkey % 6 AS INT) AS u3, CASE WHEN l_partkey % 2 = 0 THEN 5 ELSE 4 END AS most, CASE WHEN l_partkey % 2 = 0 THEN 3 ELSE 1 END AS clean3 FROM {lineitem}"
register(
    "worth_realigning",
    lambda s, d: view(s, d, _PARTIAL).select("hit", "hsp", *[outcomes.worth_realigning(F.col("lower_bound"), F.col("u3"), F.col("most"), F.col("clean3"), g).alias(n) for g, n in ((False, "ungraded"), (True, "graded"))]),
    f"SELECT hit, hsp, lower_bound <= most AND NOT (u3 > 0 AND u3 - 1 < clean3) AS ungraded, lower_bound <= most AS graded FROM {duck(_PARTIAL)}",
)
_NAMES = "SELECT CAST(p_partkey AS BIGINT) AS k, CASE WHEN p_size % 3 = 0 THEN p_name END AS species, CASE WHEN p_size % 5 < 2 THEN ' ' ELSE p_type END AS scientific, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS organism, CASE p_partkey % 3 WHEN 0 THEN 'probe' WHEN 1 THEN 'reverse' ELSE 'forward' END AS role FROM {part}"
register(
    "species_labels",
    lambda s, d: view(s, d, _NAMES).select("k", outcomes.species_label(F.col("species"), F.col("scientific"), F.col("organism")).alias("species"), outcomes.amplicon_order(F.col("role")).cast("long").alias("place"), outcomes.year_term(F.concat(F.lit("txid"), F.col("k").cast("string"), F.lit("[ORGN]")), F.lit(2020)).alias("term")),
    f"SELECT k, CASE WHEN species IS NOT NULL THEN species WHEN scientific <> ' ' THEN scientific WHEN organism IS NOT NULL THEN organism ELSE 'unknown organism' END AS species, CAST(CASE role WHEN 'forward' THEN 1 WHEN 'probe' THEN 2 ELSE 3 END AS BIGINT) AS place, 'txid' || k || '[ORGN] AND 2020/01/01:2020/12/31[PDAT]' AS term FROM {duck(_NAMES)}",
)
_TAXIDS = "SELECT CAST(CASE WHEN o_custkey % 50 > 0 THEN o_custkey END AS BIGINT) AS taxid, o_custkey % 4 = 0 AS cached FROM {orders}"
register(
    "missing_taxa",
    lambda s, d: outcomes.missing_ids(view(s, d, _TAXIDS), view(s, d, _TAXIDS).where("cached AND taxid IS NOT NULL")).select(F.explode("taxids").alias("taxid"), (F.size("taxids") <= outcomes.ASKED_AT_ONCE).alias("within")),
    f"SELECT DISTINCT taxid, true AS within FROM {duck(_TAXIDS)} WHERE taxid IS NOT NULL AND NOT cached",
)
_LABELS = "SELECT 'o' || CAST(p_partkey AS {STR}) || CASE WHEN p_size % 2 = 0 THEN '_v' || CAST(1 + p_size % 4 AS {STR}) ELSE '' END AS label, 'o' || CAST(p_partkey AS {STR}) AS oligo, CASE p_partkey % 3 WHEN 0 THEN 'probe' WHEN 1 THEN 'reverse' ELSE 'forward' END AS role FROM {part}"
register("label_roles", lambda s, d: outcomes.role_of(view(s, d, _LABELS).select("label"), view(s, d, _LABELS).select("oligo", "role")), f"SELECT label, role FROM {duck(_LABELS)}")
_BATCHES = "SELECT CAST(o_custkey AS {STR}) AS batch, o_orderkey FROM {orders}"
register(
    "retry_halves",
    lambda s, d: outcomes.retry_batches(view(s, d, _BATCHES).groupBy("batch").agg(F.sort_array(F.collect_list("o_orderkey")).alias("members"))).select("batch", F.size("members").alias("n"), F.array_max("members").cast("long").alias("last")),
    f"""WITH b AS (SELECT batch, list(o_orderkey ORDER BY o_orderkey) AS m FROM {duck(_BATCHES)} GROUP BY 1 HAVING count(*) > 1), h AS (SELECT batch, m, (len(m) + 1) // 2 AS k FROM b)
SELECT batch || '.0' AS batch, CAST(k AS INTEGER) AS n, CAST(m[k] AS BIGINT) AS last FROM h UNION ALL SELECT batch || '.1', CAST(len(m) - k AS INTEGER), CAST(m[len(m)] AS BIGINT) FROM h""",
)
_SECTIONS = "SELECT CAST(l_orderkey AS BIGINT) AS run, 's' || CAST(l_linenumber AS {STR}) AS section, CASE l_partkey % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'INCOMPLETE' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN l_suppkey % 7 = 0 THEN 'gap ' || CAST(l_suppkey AS {STR}) END AS gap FROM {lineitem}"
register(
    "overall_verdict",
    lambda s, d: outcomes.overall_verdict(view(s, d, _SECTIONS), view(s, d, _SECTIONS).where("gap IS NOT NULL").select("run", "gap")),
    f"""WITH x AS (SELECT * FROM {duck(_SECTIONS)}), w AS (SELECT run, max(CASE status WHEN 'FAIL' THEN 4 WHEN 'INCOMPLETE' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END) AS r FROM x GROUP BY 1), g AS (SELECT run, string_agg(DISTINCT gap, '; ' ORDER BY gap) AS gaps FROM x WHERE gap IS NOT NULL GROUP BY 1),
j AS (SELECT run, CASE WHEN gaps IS NULL THEN r ELSE greatest(r, 3) END AS r, coalesce(gaps, '') AS gaps FROM w LEFT JOIN g USING (run))
SELECT run, ['PASS', 'WARN', 'INCOMPLETE', 'FAIL'][r] AS verdict, CAST([0, 10, 30, 20][r] AS INTEGER) AS code, gaps FROM j""",
)
_STATES = "SELECT CAST(p_partkey AS BIGINT) AS k, p_name AS assay, p_type || p_brand AS inputs, p_size % 5 = 0 AS cached, CASE p_partkey % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'submitted' WHEN 2 THEN 'ready' ELSE 'failed' END AS state, p_size % 3 > 0 AS alive, CAST(p_size AS DOUBLE) AS waited FROM {part}"
register(
    "search_state",
    lambda s, d: view(s, d, _STATES).select("k", F.substring_index(outcomes.search_key(F.col("assay"), F.col("inputs")), "/", -1).alias("folder"), outcomes.needs_submission(F.col("cached"), F.col("state"), F.col("alive"), F.col("waited"), 30.0).alias("send")),
    f"SELECT k, 'search-' || left(sha256(inputs), 8) AS folder, NOT cached AND (NOT (state IN ('submitted', 'ready') AND alive) OR (state = 'submitted' AND waited >= 30)) AS send FROM {duck(_STATES)}",
)
_DESCRIBED = "SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS INT) AS n, CASE WHEN l_partkey % 3 = 0 THEN 'probe' ELSE 'forward' END AS role, 'NC_' || CAST(l_suppkey AS {STR}) AS accession, CASE WHEN l_suppkey % 4 > 0 THEN 'org ' || CAST(l_suppkey AS {STR}) END AS organism, CAST(l_quantity AS INT) % 5 AS mismatches, CAST(l_partkey % 2 AS INT) AS gaps, CAST(l_partkey % 9 AS INT) AS clean3, CAST(l_suppkey % 3 AS INT) AS unaligned FROM {lineitem}"
register(
    "site_descriptions",
    lambda s, d: view(s, d, _DESCRIBED).select("k", "n", outcomes.site_description(*map(F.col, ("role", "accession", "organism", "mismatches", "gaps", "clean3", "unaligned"))).alias("line")),
    f"SELECT k, n, role || ' on ' || accession || ' (' || coalesce(organism, 'unknown organism') || '): ' || mismatches || ' mismatch(es), ' || gaps || ' gap(s), ' || clean3 || ' clean at the 3'' end' || CASE WHEN unaligned > 0 THEN ', ' || unaligned || ' unaligned (worst case)' ELSE '' END AS line FROM {duck(_DESCRIBED)}",
)
