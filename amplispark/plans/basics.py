"""Queries over small functions that others build on, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.functions import grading, seq, thermo
from amplispark.operators import oligo_qc, reports, windows
from amplispark.plans.catalogue import register
from amplispark.plans.chemistry import _TMS
from amplispark.plans.synthetic import dna, duck, view
from amplispark.sources import files
from amplispark.streaming import store

_TEXTS = f"SELECT CAST(p_partkey AS BIGINT) AS k, ' ' || lower(substr({dna('p_partkey')}, 1, 7)) || chr(10) || 'ry' || chr(9) || substr({dna('p_partkey')}, 8, 5) || 'x-' AS t, substr('ACGTRYSWKMBDHVN', CAST(1 + p_partkey % 15 AS INT), 1) AS a, substr('ACGTRYSWKMBDHVN', CAST(1 + p_size % 15 AS INT), 1) AS b, p_size / 4.0 AS low, p_size / 4.0 + p_partkey % 3 AS high FROM {{part}}"
_BASES = "map {" + ", ".join(f"'{c}': '{b}'" for c, b in seq.CODES.items()) + "}"
register(
    "sequence_basics",
    lambda s, d: view(s, d, _TEXTS).select("k", seq.normalise(F.col("t")).alias("plain"), seq.sanitise(seq.normalise(F.col("t"))).alias("clean"), seq.compatible(F.col("a"), F.col("b")).alias("share"), seq.number_range(F.col("low"), F.col("high"), 2).alias("span")),
    f"""WITH t AS (SELECT *, upper(regexp_replace(t, '\\s+', '', 'g')) AS p FROM {duck(_TEXTS)})
SELECT k, p AS plain, regexp_replace(p, '[^ACGTRYSWKMBDHVN]', 'N', 'g') AS clean, len(list_intersect(string_split({_BASES}[a], ''), string_split({_BASES}[b], ''))) > 0 AS share, CASE WHEN low = high THEN printf('%.2f', low) ELSE printf('%.2f', low) || '-' || printf('%.2f', high) END AS span FROM t""",
)
_CLASSED = "SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS k, CAST(l_suppkey AS BIGINT) AS g, CASE l_partkey % 5 WHEN 0 THEN 'perfect' WHEN 1 THEN 'tolerated' WHEN 2 THEN 'at_risk' WHEN 3 THEN 'likely_failure' ELSE 'indeterminate' END AS class, l_suppkey % 4 = 0 AS gap FROM {lineitem}"
register(
    "site_states",
    lambda s, d: view(s, d, _CLASSED).groupBy("g", grading.site_state(F.col("class"), F.col("gap")).alias("state")).agg(F.count("*").alias("n"), F.max(grading.rank_of(F.col("class"))).alias("worst")),
    f"""SELECT g, CASE WHEN gap OR class = 'likely_failure' THEN 'fail' WHEN class = 'indeterminate' THEN 'undetermined' ELSE 'ok' END AS state, count(*) AS n, CAST(max(list_position(['perfect', 'tolerated', 'at_risk', 'likely_failure', 'indeterminate'], class) - 1) AS INTEGER) AS worst FROM {duck(_CLASSED)} GROUP BY 1, 2""",
)
_SPANS = "SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS k, CAST(l_partkey % 300 AS INT) AS a, CAST(l_partkey % 300 + l_suppkey % 50 AS INT) AS b, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand, CAST(400 + l_suppkey AS INT) AS n FROM {lineitem}"
register(
    "forward_spans",
    lambda s, d: view(s, d, _SPANS).select("k", "strand", "n", seq.forward_span(F.col("a"), F.col("b"), F.col("strand"), F.col("n")).alias("f")).select("k", "strand", "f.start", "f.end"),
    f"""SELECT k, strand, CASE strand WHEN '-' THEN n - b ELSE a END AS start, CASE strand WHEN '-' THEN n - a ELSE b END AS "end" FROM {duck(_SPANS)}""",
)
# Braces of the JSON are doubled, as a view fills in its tables by braces.
_REPORTS = """SELECT '{{"refseq_accession":' || CASE WHEN s_suppkey % 3 = 0 THEN '""' ELSE '"NC_' || CAST(s_suppkey AS {STR}) || '"' END || ',"genbank_accession":"CP' || CAST(s_suppkey AS {STR}) || '","role":"assembled-molecule","assigned_molecule_location_type":"' || CASE WHEN s_suppkey % 5 = 0 THEN 'Plasmid' ELSE 'Chromosome' END || '"}}' AS value FROM {supplier}"""
register(
    "sequence_roles",
    lambda s, d: files.sequence_roles(view(s, d, _REPORTS)),
    """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'Plasmid' ELSE 'Chromosome' END AS molecule FROM supplier)
SELECT 'NC_' || k AS accession, 'assembled-molecule' AS role, molecule FROM s WHERE k % 3 <> 0 UNION ALL SELECT 'CP' || k, 'assembled-molecule', molecule FROM s""",
)
_PAGES = """SELECT '{{"total_count":2,"next_page_token":"x","reports":[{{"accession":"GCA_' || CAST(o_orderkey AS {STR}) || '","organism":{{"tax_id":' || CAST(o_custkey AS {STR}) || ',"organism_name":"org"}},"assembly_info":{{"assembly_level":"Contig","release_date":"' || CAST(CAST(o_orderdate AS DATE) AS {STR}) || '"}}}},{{"accession":"GCF_' || CAST(o_orderkey AS {STR}) || '"}}]}}' AS value FROM {orders}"""
register(
    "assembly_listing",
    lambda s, d: files.assembly_listing(view(s, d, _PAGES)).withColumn("release_date", F.col("release_date").cast("string")),
    """SELECT 'GCA_' || o_orderkey AS accession, CAST(o_custkey AS BIGINT) AS taxid, 'org' AS organism, 'Contig' AS level, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS release_date FROM orders
UNION ALL SELECT 'GCF_' || o_orderkey, NULL, NULL, NULL, NULL FROM orders""",
)
_NEAR = "SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS accession, CAST(l_partkey % 48 AS INT) AS anchored, CASE WHEN l_suppkey % 6 > 0 THEN CAST(l_suppkey % 100 AS INT) / 100.0 END AS identity FROM {lineitem}"
register(
    "borderline_candidates",
    lambda s, d: reports.borderline(view(s, d, _NEAR)),
    f"SELECT accession, anchored, identity FROM {duck(_NEAR)} WHERE anchored < 32 AND identity >= 0.60 OR anchored BETWEEN 24 AND 31",
)
_CHECKS = f"SELECT oligo, role, 'tm' AS \"check\", low, high FROM {duck(_TMS)}"


def _tms(s, d):
    return view(s, d, _TMS).withColumn("check", F.lit("tm"))


register(
    "primer_tm_difference",
    lambda s, d: oligo_qc.pair_checks(_tms(s, d)).select(F.round("tm_diff", 6).alias("tm_diff"), "status"),
    f"""WITH c AS ({_CHECKS}), x AS (SELECT min(low) FILTER (role = 'forward') AS fl, max(high) FILTER (role = 'forward') AS fh, min(low) FILTER (role = 'reverse') AS rl, max(high) FILTER (role = 'reverse') AS rh FROM c), y AS (SELECT greatest(abs(fh - rl), abs(rh - fl)) AS v FROM x)
SELECT round(v, 6) AS tm_diff, CASE WHEN v > 6 THEN 'FAIL' WHEN v > 3 THEN 'WARN' ELSE 'PASS' END AS status FROM y""",
)
register(
    "role_tm_spread",
    lambda s, d: oligo_qc.role_spread(_tms(s, d)).select("role", "n", F.round("spread", 6).alias("spread")),
    f"SELECT role, count(DISTINCT oligo) AS n, round(max(high) - min(low), 6) AS spread FROM ({_CHECKS}) GROUP BY 1 HAVING count(DISTINCT oligo) > 1",
)
_STORED = "SELECT 'A' || CAST(o_custkey AS {STR}) AS accession, CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS {STR}) END AS collected FROM {orders}"
_READ = "SELECT 'A' || CAST(o_custkey AS {STR}) AS accession, CAST(o_orderkey AS BIGINT) AS seq_no, CAST(1900 + o_orderkey % 90 AS {STR}) AS collected FROM {orders} WHERE o_custkey % 4 = 1"
register(
    "late_dates",
    lambda s, d: store.with_dates(view(s, d, _STORED), view(s, d, _READ)).select("accession", "k", "collected"),
    f"WITH l AS (SELECT accession, arg_max(collected, seq_no) AS c FROM {duck(_READ)} GROUP BY 1) SELECT accession, k, coalesce(c, collected) AS collected FROM {duck(_STORED)} LEFT JOIN l USING (accession)",
)
_AVAILABLE = "SELECT CAST(l_suppkey AS BIGINT) AS g, count(*) AS assessed, count(CASE WHEN l_partkey % 19 = 0 THEN 1 END) AS unavailable FROM {lineitem} GROUP BY l_suppkey"
register(
    "too_many_unavailable",
    lambda s, d: view(s, d, _AVAILABLE).select("g", windows.too_many_unavailable(F.col("assessed"), F.col("unavailable")).alias("too_many")),
    f"SELECT g, unavailable > 0.05 * (assessed + unavailable) AS too_many FROM {duck(_AVAILABLE)}",
)
_SIGNALS = "SELECT l_returnflag || l_linestatus AS channel, count(CASE WHEN l_partkey % 1000 = 3 THEN 1 END) AS signals FROM {lineitem} GROUP BY l_returnflag, l_linestatus"
register("channels_shown", lambda s, d: windows.channels_shown(view(s, d, _SIGNALS)), f"SELECT count(*) > 1 OR coalesce(max(signals), 0) > 0 AS shown FROM {duck(_SIGNALS)}")
_MIXED = f"SELECT CAST(p_partkey AS BIGINT) AS k, substr('ACGTRYSWKMBDHVN', CAST(1 + p_partkey % 15 AS INT), 1) || substr({dna('p_partkey')}, 1, 6) || substr('RYN', CAST(1 + p_size % 3 AS INT), 1) AS oligo, substr({dna('p_partkey + 1')}, 1, 8) AS template FROM {{part}}"
_PICK = lambda i: f"CASE WHEN contains({_BASES}[substr(oligo, {i}, 1)], substr(template, {i}, 1)) THEN substr(template, {i}, 1) ELSE left({_BASES}[substr(oligo, {i}, 1)], 1) END"
register(
    "resolved_oligos",
    lambda s, d: view(s, d, _MIXED).select("k", thermo.resolve_against(F.col("oligo"), F.col("template")).alias("resolved")),
    f"SELECT k, {' || '.join(_PICK(i) for i in range(1, 9))} AS resolved FROM {duck(_MIXED)}",
)
