"""Queries over verdicts and findings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.operators import specificity, verdicts
from amplispark.plans.catalogue import register
from amplispark.plans.search import _LEVEL
from amplispark.plans.synthetic import HSPS, SITES, duck, view

# A run is a supplier's order lines by year; how often its genomes are detected hangs on the supplier, in one year in five more rarely.
_YEARS = """SELECT CAST(l_suppkey AS BIGINT) AS run, CAST(year(l_shipdate) AS INT) AS year, CASE WHEN l_partkey % 100 < 99 - l_suppkey % 7 * 3 AND NOT (l_suppkey % 3 = 0 AND year(l_shipdate) = 1996 AND l_partkey % 4 > 0) THEN 1 ELSE 0 END AS ok,
CASE WHEN l_orderkey % 100 < l_suppkey % 11 * 3 THEN 1 ELSE 0 END AS open, CAST(l_orderkey % 2 AS INT) AS risk FROM {lineitem}"""
_GROUPED = f"""SELECT run, year, CAST(sum((1 - open) * ok) AS BIGINT) AS detectable, CAST(sum((1 - open) * (1 - ok) * risk) AS BIGINT) AS at_risk, CAST(sum((1 - open) * (1 - ok) * (1 - risk)) AS BIGINT) AS not_detected, CAST(sum(open) AS BIGINT) AS undetermined
FROM ({_YEARS}) t GROUP BY run, year"""
_RUNS = "SELECT CAST(s_suppkey AS BIGINT) AS run, CASE WHEN s_suppkey % 4 = 0 THEN 1997 END AS last, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 40 END AS undated, CASE WHEN s_suppkey % 5 = 0 THEN 100 END AS with_region, s_suppkey % 6 <> 1 AS complete FROM {supplier} UNION ALL SELECT -1, NULL, NULL, NULL, true FROM {region} WHERE r_regionkey = 0"
_LIMITS = verdicts.Limits(least=40, least_year=12)
register(
    "fragment_verdict",
    lambda s, d: verdicts.fragment_verdict(view(s, d, _GROUPED), view(s, d, _RUNS), _LIMITS),
    f"""WITH y AS (SELECT *, detectable + at_risk + not_detected AS n_y FROM {duck(_GROUPED)}), r AS (SELECT * FROM {duck(_RUNS)}),
e AS (SELECT y.run, coalesce(max(r.last), max(year) FILTER (n_y + undetermined > 0)) AS e FROM y JOIN r USING (run) GROUP BY 1),
p AS (SELECT run, min(year) AS first, max(e) AS last, sum(detectable) AS d, sum(at_risk) AS a, sum(not_detected) AS f, sum(undetermined) AS u, sum(n_y) AS n, string_agg(year::VARCHAR, ',' ORDER BY year) FILTER (n_y >= 12 AND 100.0 * detectable < 80 * n_y) AS below
  FROM y JOIN e USING (run) WHERE year BETWEEN e - 3 AND e GROUP BY 1),
x AS (SELECT r.run, complete, first, p.last, CAST(coalesce(n, 0) AS BIGINT) AS n, u, round(100.0 * d / n, 6) AS percent, round(100.0 * (d + a) / n, 6) AS with_risk, round(100.0 * u / (n + u), 6) AS undetermined_share, round(100.0 * undated / with_region, 6) AS undated_share, coalesce(below, '') AS years_below,
  CASE WHEN n + u > 0 THEN round(100.0 * d / (n + u), 6) END AS low, CASE WHEN n + u > 0 THEN round(100.0 * (d + u) / (n + u), 6) END AS high FROM r LEFT JOIN p USING (run)),
z AS (SELECT *, CASE WHEN coalesce(n + u, 0) = 0 THEN 'no_genomes' WHEN n < 40 THEN 'too_few' WHEN undetermined_share > 25 THEN 'undetermined' WHEN undated_share > 25 THEN 'undated' WHEN percent < 80 THEN 'below_fail' WHEN percent < 95 THEN 'below_warn' WHEN years_below <> '' THEN 'year_below' ELSE 'passes' END AS reason FROM x),
w AS (SELECT *, CASE WHEN reason IN ('no_genomes', 'too_few', 'undetermined', 'undated') THEN 'INCOMPLETE' WHEN reason = 'below_fail' THEN 'FAIL' WHEN reason = 'passes' THEN 'PASS' ELSE 'WARN' END AS would_be FROM z)
SELECT run, CASE WHEN complete THEN would_be ELSE 'INCOMPLETE' END AS status, would_be, reason, first, last, n, percent, with_risk, low, high, undetermined_share, undated_share, coalesce(years_below, '') AS years_below FROM w""",
)
_PRODUCTS = """SELECT CASE l_returnflag WHEN 'A' THEN 'near' WHEN 'N' THEN 'background' ELSE 'other' END AS tier, CAST(l_orderkey AS BIGINT) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000000 AS left_id,
CAST(l_orderkey AS BIGINT) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000000 + 1 AS right_id, CASE WHEN l_partkey % 5 = 0 THEN CAST(l_partkey AS BIGINT) END AS probe_id, CAST(l_partkey % 37 AS {STR}) AS pattern FROM {lineitem} WHERE l_linenumber = 1"""
_COUNTS = f"SELECT tier, query, count(*) AS relevant, least(count(*), 900) AS assessed FROM ({HSPS}) t GROUP BY tier, query"
_FAILED = "SELECT CASE l_returnflag WHEN 'A' THEN 'near' ELSE 'out_of_scope' END AS tier, CAST(1 AS BIGINT) AS windows FROM {lineitem} WHERE l_linenumber = 7 AND l_returnflag <> 'N'"
_PERFECT = f"SELECT CASE query WHEN 'q0' THEN 'forward' WHEN 'q1' THEN 'probe' ELSE 'reverse' END AS role, CAST(1 AS BIGINT) AS hits FROM ({HSPS}) t WHERE identity = query_len AND gaps = 0"


def _findings(s, d):
    v = lambda q: view(s, d, q)
    sites = v(SITES).withColumn("level", specificity.level())
    saturated = specificity.saturation(v(HSPS), 500).where("saturated").select("tier", "query")
    cut = v(_PRODUCTS).groupBy("tier").agg(F.count("*").alias("n")).where("n > 500").select("tier")
    found = verdicts.Search(sites, v(_PRODUCTS), saturated, v(_COUNTS), v(_FAILED), cut, v(_PERFECT))
    return verdicts.search_findings(found, sites.select("tier"), ["near", "human", "exclusivity"], {"exclusivity": "none known", "near": "searched anyway"})


register(
    "search_findings",
    _findings,
    f"""WITH s AS (SELECT *, {_LEVEL} AS level FROM {duck(SITES)}), p AS (SELECT * FROM {duck(_PRODUCTS)}), i AS (SELECT DISTINCT unnest([left_id, right_id]) AS site_id FROM p),
a AS (SELECT s.*, i.site_id IS NOT NULL AS inside FROM s LEFT JOIN i USING (site_id) WHERE level <> 'minor'),
g AS (SELECT tier, CASE WHEN role = 'probe' THEN 'probe_site_' || level WHEN level = 'critical' AND NOT inside THEN 'primer_site_critical_no_product' ELSE 'primer_site_' || level END AS code, count(*) AS n, arg_min(site_id, row(mismatches + gaps, -clean3, site_id))::VARCHAR AS about FROM a GROUP BY 1, 2),
b AS (SELECT tier, query, hit, max(identity) AS best FROM {duck(HSPS)} GROUP BY 1, 2, 3), t AS (SELECT tier, query FROM b GROUP BY 1, 2 HAVING count(*) >= 500 AND min(best) >= 14), c AS (SELECT * FROM {duck(_COUNTS)}),
h AS (SELECT r.role, count(q.hits) AS hits FROM (VALUES ('forward'), ('probe'), ('reverse')) AS r(role) LEFT JOIN {duck(_PERFECT)} q ON q.role = r.role GROUP BY 1)
SELECT 'INFO' AS severity, 'search' AS topic, 'scope' AS code, NULL AS tier, string_agg(DISTINCT tier, ', ' ORDER BY tier) AS about, count(DISTINCT tier) AS n FROM s
UNION ALL SELECT 'INCOMPLETE', 'search', 'unsearched', 'human', NULL, 1
UNION ALL SELECT 'INFO', 'search', 'waived', 'exclusivity', 'none known', 1
UNION ALL SELECT 'INCOMPLETE', 'search', 'saturated', tier, string_agg(query, ', ' ORDER BY query), count(*) FROM t GROUP BY tier
UNION ALL SELECT 'INCOMPLETE', 'search', 'assessment_cut', tier, query, relevant - assessed FROM c WHERE assessed < relevant
UNION ALL SELECT CASE tier WHEN 'out_of_scope' THEN 'INFO' ELSE 'INCOMPLETE' END, 'search', 'fetch_failed', tier, NULL, count(*) FROM {duck(_FAILED)} GROUP BY tier
UNION ALL SELECT CASE WHEN starts_with(code, 'probe') THEN 'INFO' ELSE 'WARN' END, 'sites', code, tier, about, n FROM g
UNION ALL SELECT CASE WHEN probe_id IS NULL THEN 'WARN' ELSE 'FAIL' END, 'products', CASE WHEN probe_id IS NULL THEN 'product_not_detected' ELSE 'product_detected' END, tier, count(DISTINCT pattern) || ' patterns', count(*) FROM p GROUP BY 1, 3, 4
UNION ALL SELECT 'INCOMPLETE', 'products', 'products_cut', tier, NULL, 1 FROM p GROUP BY tier HAVING count(*) > 500
UNION ALL SELECT 'INFO', 'products', 'primer_only', NULL, NULL, count(*) FROM a WHERE role <> 'probe' AND NOT inside HAVING count(*) > 0
UNION ALL SELECT CASE WHEN min(hits) = 0 THEN 'WARN' ELSE 'INFO' END, 'search', 'intended_target', NULL, string_agg(role || ' ' || hits, ', ' ORDER BY role || ' ' || hits), count(*) FILTER (hits = 0) FROM h HAVING sum(hits) > 0""",
)
# Tiers by supplier nation; in some no probe lies in a product, in some no primer is above minor, and some names are not resolved.
_TIERED = f"SELECT site_id, role, CAST(taxid % 25 AS INT) AS tier, CASE WHEN taxid % 25 IN (3, 4) AND role <> 'probe' THEN 'minor' ELSE level END AS level FROM (SELECT *, {_LEVEL} AS level FROM ({SITES}) a) b"
_PAIRED = "SELECT CAST(l_suppkey % 25 AS INT) AS tier, CAST(l_orderkey AS BIGINT) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000000 AS left_id, CAST(-1 AS BIGINT) AS right_id, CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 25 > 9 THEN CAST(l_partkey AS BIGINT) END AS probe_id FROM {lineitem} WHERE l_suppkey % 25 > 4 AND l_linenumber % 3 = 1"
_ASKED = "SELECT CAST(n_nationkey AS INT) AS tier, n_nationkey % 7 <> 2 AS searched, CAST(5 AS BIGINT) AS organisms, CAST(5 - n_nationkey % 4 % 2 AS BIGINT) AS resolved FROM {nation}"
register(
    "exclusivity_verdict",
    lambda s, d: verdicts.exclusivity_verdict(view(s, d, _ASKED), view(s, d, _TIERED), view(s, d, _PAIRED)),
    f"""WITH s AS (SELECT * FROM {duck(_TIERED)}), p AS (SELECT * FROM {duck(_PAIRED)}), i AS (SELECT DISTINCT unnest([left_id, right_id]) AS site_id FROM p),
c AS (SELECT tier, CASE WHEN role = 'probe' THEN CASE WHEN level = 'critical' THEN 'INFO' END ELSE 'WARN' END AS w FROM s WHERE level <> 'minor' UNION ALL SELECT tier, CASE WHEN probe_id IS NULL THEN 'WARN' ELSE 'FAIL' END FROM p),
g AS (SELECT tier, string_agg(DISTINCT w, ',' ORDER BY w) AS w FROM c WHERE w IS NOT NULL GROUP BY 1)
SELECT tier, CASE WHEN NOT searched THEN 'INCOMPLETE' WHEN contains(coalesce(w, ''), 'FAIL') THEN 'FAIL' WHEN resolved < organisms THEN 'INCOMPLETE' WHEN contains(coalesce(w, ''), 'WARN') THEN 'WARN' ELSE 'PASS' END AS verdict, coalesce(w, '') AS severities, organisms, resolved
FROM {duck(_ASKED)} LEFT JOIN g USING (tier)""",
)
