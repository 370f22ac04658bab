"""Queries over coverage, with their SQL: genomes from orders, their oligos from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.operators import coverage
from amplispark.plans.catalogue import register
from amplispark.plans.synthetic import duck, view

_CALLS = """SELECT 'G' || CAST(o_orderkey AS {STR}) AS accession, CAST(1 + o_custkey % 4 AS INT) AS copies, o_custkey % 11 <> 2 AS best_is_first, CAST(o_orderkey % 3 AS INT) AS detectable, CAST(o_custkey % 4 AS INT) AS detectable_other,
o_orderkey % 29 = 0 AS from_parts, CASE WHEN o_orderkey % 29 = 0 THEN 'from_parts' WHEN o_orderkey % 3 > 0 THEN 'detected' WHEN o_custkey % 5 = 0 THEN 'undetermined' WHEN o_custkey % 5 = 1 THEN 'unassembled' ELSE 'not_detected' END AS outcome FROM {orders}"""
_SITES = """SELECT 'G' || CAST(l_orderkey AS {STR}) AS accession, CASE l_linenumber % 3 WHEN 0 THEN 'forward' WHEN 1 THEN 'probe' ELSE 'reverse' END AS role, 'o' || CAST(l_linenumber AS {STR}) AS oligo,
CASE l_linenumber WHEN 1 THEN 'FAM' WHEN 4 THEN 'HEX' END AS reporter, (l_partkey + l_suppkey) % 4 > 0 AS good FROM {lineitem}"""
_STATES = "SELECT DISTINCT 'G' || CAST(l_orderkey AS {STR}) AS accession, CASE l_linenumber % 3 WHEN 0 THEN 'forward' WHEN 1 THEN 'probe' ELSE 'reverse' END AS role, CASE l_orderkey % 4 WHEN 0 THEN 'undetermined' WHEN 1 THEN 'fails' ELSE 'ok' END AS state FROM {lineitem}"
_C, _S = duck(_CALLS), duck(_SITES)

register(
    "coverage_totals",
    lambda s, d: coverage.copy_totals(view(s, d, _CALLS)),
    f"""SELECT count(*) AS genomes, count(*) FILTER (copies > 1) AS multi_copy, CAST(coalesce(max(copies), 0) AS BIGINT) AS max_copies, count(*) FILTER (NOT best_is_first) AS best_copy_not_first, count(*) FILTER (detectable > 0) AS with_detectable_copy,
count(*) FILTER (detectable > 0) AS with_detectable_copy_strict, count(*) FILTER (detectable_other > 0) AS with_detectable_copy_bulges, count(*) FILTER (from_parts) AS from_parts, coalesce(bool_or(from_parts AND detectable > 0), false) AS from_parts_counted,
count(*) FILTER (outcome = 'not_detected') AS escapes, count(*) FILTER (outcome = 'unassembled') AS unassembled, count(*) FILTER (outcome = 'undetermined') AS undetermined FROM {_C}""",
)
register(
    "outcome_examples",
    lambda s, d: coverage.outcome_examples(view(s, d, _CALLS)),
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY accession) AS n FROM {_C} WHERE outcome IN ('not_detected', 'undetermined', 'unassembled'))
SELECT outcome, count(*) AS genomes, string_agg(accession, ',' ORDER BY accession) FILTER (n <= 20) AS examples FROM c GROUP BY 1""",
)
register(
    "oligo_coverage",
    lambda s, d: coverage.oligo_coverage(view(s, d, _CALLS), view(s, d, _SITES)),
    f"""WITH j AS (SELECT s.* FROM {_S} s JOIN {_C} c USING (accession) WHERE outcome <> 'from_parts' AND good), o AS (SELECT accession, role, min(oligo) AS oligo FROM j GROUP BY 1, 2 HAVING count(DISTINCT oligo) = 1),
n AS (SELECT role, oligo, max(reporter) AS reporter FROM {_S} GROUP BY 1, 2)
SELECT role, oligo, CASE WHEN role = 'probe' THEN reporter END AS reporter, (SELECT count(DISTINCT accession) FROM j WHERE j.role = n.role AND j.oligo = n.oligo) AS covered, (SELECT count(*) FROM o WHERE o.role = n.role AND o.oligo = n.oligo) AS "only" FROM n""",
)
register(
    "role_gaps",
    lambda s, d: coverage.role_gaps(view(s, d, _CALLS), view(s, d, _SITES), view(s, d, _STATES)),
    f"""WITH r AS (SELECT DISTINCT role FROM {_S}), u AS (
  SELECT c.accession, r.role, coalesce(t.state = 'undetermined', false) AS u FROM {_C} c CROSS JOIN r LEFT JOIN {duck(_STATES)} t ON t.accession = c.accession AND t.role = r.role
  WHERE outcome <> 'from_parts' AND NOT EXISTS (SELECT 1 FROM {_S} s WHERE s.accession = c.accession AND s.role = r.role AND s.good)
), n AS (SELECT *, row_number() OVER (PARTITION BY role, u ORDER BY accession) AS n FROM u)
SELECT role, count(*) FILTER (NOT u) AS "none", count(*) FILTER (u) AS undetermined, coalesce(string_agg(accession, ',' ORDER BY accession) FILTER (NOT u AND n <= 20), '') AS examples FROM r LEFT JOIN n USING (role) GROUP BY 1""",
)
register(
    "channel_coverage",
    lambda s, d: coverage.channel_coverage(view(s, d, _CALLS), view(s, d, _SITES)),
    f"""WITH p AS (SELECT accession, oligo, coalesce(reporter, 'unspecified') AS reporter, good FROM {_S} WHERE role = 'probe'), n AS (SELECT reporter, string_agg(DISTINCT oligo, ',' ORDER BY oligo) AS probes FROM p GROUP BY 1),
g AS (SELECT DISTINCT p.accession, reporter FROM p JOIN {_C} c USING (accession) WHERE good AND outcome <> 'from_parts'), k AS (SELECT accession, count(*) AS k FROM g GROUP BY 1)
SELECT reporter, probes, (SELECT count(*) FROM g WHERE g.reporter = n.reporter) AS covered, (SELECT count(*) FROM k) AS any_channel, (SELECT count(*) FROM k WHERE k.k = (SELECT count(*) FROM n)) AS all_channels FROM n""",
)
_GENOMES = """SELECT CAST(o_orderkey AS BIGINT) AS accession, CASE o_orderkey % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'contig_break' ELSE 'found' END AS state, o_custkey % 7 = 0 AS masked, CASE o_custkey % 6 WHEN 0 THEN 'related' WHEN 1 THEN 'beside' WHEN 2 THEN 'flanked' END AS beside,
o_custkey % 13 <> 0 AS located, o_custkey % 3 = 0 AS by_fallback, o_custkey % 17 = 0 AS from_parts, CASE WHEN o_custkey % 2 = 0 THEN 'plasmid' END AS molecule FROM {orders}"""
register(
    "located_totals",
    lambda s, d: coverage.located_totals(view(s, d, _GENOMES)),
    f"""SELECT count(*) AS genomes, count(*) FILTER (state = 'found') AS found, count(*) FILTER (state = 'not_found' AND located) AS not_found, count(*) FILTER (NOT located) AS not_located, count(*) FILTER (state = 'contig_break') AS cut, count(*) FILTER (state = 'found' AND masked) AS masked,
count(*) FILTER (state = 'found' AND NOT masked) AS assessed, count(*) FILTER (beside = 'related') AS related, count(*) FILTER (beside = 'beside') AS beside, count(*) FILTER (beside = 'flanked') AS flanked, count(*) FILTER (state = 'found' AND by_fallback) AS by_fallback,
count(*) FILTER (from_parts) AS from_parts, count(*) FILTER (state = 'found' AND molecule = 'plasmid') AS on_plasmid FROM {duck(_GENOMES)}""",
)
_COMBOS = """SELECT CAST(p_partkey AS BIGINT) AS combo, CASE WHEN p_size % 10 < 5 THEN 'detectable' WHEN p_size % 10 = 5 THEN 'not_detected' WHEN p_size % 10 = 6 THEN 'undetermined' WHEN p_size = 7 THEN 'unassembled' WHEN p_size % 10 = 8 THEN 'at_risk' ELSE 'not_classified' END AS outcome,
CAST(floor(p_retailprice) AS BIGINT) % 211 + 1 AS n, p_brand AS kind FROM {part}"""
register(
    "fragment_view",
    lambda s, d: coverage.fragment_view(view(s, d, _COMBOS)),
    f"""WITH c AS (SELECT *, list_position(['not_detected', 'undetermined', 'unassembled', 'at_risk', 'not_classified', 'detectable'], outcome) AS o, row_number() OVER (PARTITION BY outcome ORDER BY n DESC, combo) AS r FROM {duck(_COMBOS)}),
q AS (SELECT *, row_number() OVER (ORDER BY o, r) AS q FROM c WHERE outcome <> 'detectable' AND r <= 5), f AS (SELECT *, row_number() OVER (ORDER BY n DESC, combo) AS q FROM c WHERE outcome <> 'detectable' AND r > 5),
s AS (SELECT combo FROM q WHERE q <= 30 UNION ALL SELECT combo FROM f WHERE q <= 30 - (SELECT least(30, count(*)) FROM q) UNION ALL SELECT combo FROM c WHERE outcome = 'detectable' AND r <= 10),
k AS (SELECT outcome, kind, sum(n) AS k, count(*) AS c FROM c WHERE combo NOT IN (SELECT combo FROM s) GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY k DESC, kind) AS r FROM k)
SELECT CASE WHEN outcome = 'detectable' THEN 'detectable' ELSE 'attention' END AS part, outcome, combo, CAST(1 AS BIGINT) AS combos, n AS records, CAST(NULL AS VARCHAR) AS kinds FROM c WHERE combo IN (SELECT combo FROM s)
UNION ALL SELECT CASE WHEN outcome = 'detectable' THEN 'rest' ELSE 'folded' END, outcome, NULL, CAST(sum(c) AS BIGINT), CAST(sum(k) AS BIGINT), string_agg(kind || '=' || CAST(k AS BIGINT), ',' ORDER BY r) FILTER (r <= 3) FROM t GROUP BY 2""",
)
