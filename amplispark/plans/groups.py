"""Queries over the groups of reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.operators import groups, reports, specificity
from amplispark.plans.catalogue import register
from amplispark.plans.search import _ALL_PAIRS, _LEVEL, _S
from amplispark.plans.synthetic import SITES, duck, view
from amplispark.sources import sinks

#: Two suppliers of three have a species; its name is shared by suppliers of a nation.
_SPECIES = "SELECT CAST(s_suppkey AS BIGINT) AS taxid, 'species ' || CAST(s_nationkey AS {STR}) AS name FROM {supplier} WHERE s_suppkey % 3 > 0"
register(
    "products_by_species",
    lambda s, d: groups.product_groups(specificity.products(specificity.told_by_id(view(s, d, SITES)), per_tier=None, details=True), view(s, d, SITES), view(s, d, _SPECIES)),
    f"""WITH {_ALL_PAIRS}, j AS (SELECT c.*, probe_id, l.taxid, l.mismatches + l.gaps + r.mismatches + r.gaps AS defects FROM cut c JOIN s l ON l.site_id = c.left_id JOIN s r ON r.site_id = c.right_id LEFT JOIN best b ON b.left_id = c.left_id AND b.right_id = c.right_id),
o AS (SELECT tier, accession, start, "end", left_role, right_role, min(row(defects, probe_id IS NULL, left_id, right_id)) AS o, min(length) AS length, min(taxid) AS taxid, bool_or(probe_id IS NOT NULL) AS detected FROM j GROUP BY 1, 2, 3, 4, 5, 6),
g AS (SELECT tier, coalesce(name, 'unknown') AS species, count(*) AS products, count(DISTINCT accession) AS records, count(*) FILTER (detected) AS detected, min(length) AS shortest, max(length) AS longest, string_agg(DISTINCT left_role || '/' || right_role, ',' ORDER BY left_role || '/' || right_role) AS pairs, min(o) AS o
  FROM o LEFT JOIN {duck(_SPECIES)} p USING (taxid) GROUP BY 1, 2)
SELECT tier, species, products, records, detected, shortest, longest, pairs, o[3] AS best_left, o[4] AS best_right, o[1] AS best_defects FROM g""",
)
register(
    "sites_by_species",
    lambda s, d: groups.site_groups(view(s, d, SITES).withColumn("level", specificity.level()), view(s, d, _SPECIES)),
    f"""WITH s AS (SELECT *, {_LEVEL} AS level FROM {_S}), j AS (SELECT s.*, coalesce(name, 'unknown') AS species FROM s LEFT JOIN {duck(_SPECIES)} p USING (taxid) WHERE level <> 'minor')
SELECT tier, species, count(*) AS sites, count(DISTINCT accession) AS records, count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'warning') AS warning, arg_min(site_id, row(mismatches + gaps, -clean3, site_id)) AS closest, min(mismatches + gaps) AS defects FROM j GROUP BY 1, 2""",
)
_VARIANTS = """SELECT 'o' || CAST(l_suppkey % 7 AS {STR}) AS oligo, CAST(l_orderkey AS BIGINT) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000000 AS variant, CASE CAST(l_quantity AS INT) % 7 WHEN 0 THEN 'perfect' WHEN 1 THEN 'tolerated' WHEN 2 THEN 'at_risk' WHEN 3 THEN 'likely_failure' WHEN 4 THEN 'indeterminate' WHEN 5 THEN 'tolerated' END AS grade,
CASE WHEN l_partkey % 3 = 0 THEN CAST(1 + l_partkey % 40 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS n, CASE WHEN l_suppkey % 9 > 0 THEN 'species ' || CAST(l_suppkey % 9 AS {STR}) END AS kind FROM {lineitem}"""
register(
    "oligo_view",
    lambda s, d: groups.oligo_view(view(s, d, _VARIANTS)),
    f"""WITH v AS (SELECT oligo, variant, coalesce(grade, 'not_classified') AS grade, n, coalesce(kind, 'unknown') AS kind FROM {duck(_VARIANTS)}), r AS (SELECT *, row_number() OVER (PARTITION BY oligo, grade ORDER BY n DESC, variant) AS r FROM v),
p AS (SELECT *, CASE WHEN grade = 'perfect' THEN 'perfect' WHEN grade = 'tolerated' THEN CASE WHEN r <= 5 THEN 'listed' ELSE 'lumped' END WHEN n < 2 THEN 'singles' ELSE 'listed' END AS part FROM r),
k AS (SELECT oligo, part, grade, kind, count(*) AS c, sum(n) AS k FROM p WHERE part <> 'listed' GROUP BY 1, 2, 3, 4), t AS (SELECT *, row_number() OVER (PARTITION BY oligo, part, grade ORDER BY c DESC, kind) AS r FROM k)
SELECT oligo, part, grade, variant, CAST(1 AS BIGINT) AS variants, n AS records, CAST(NULL AS VARCHAR) AS kinds FROM p WHERE part = 'listed'
UNION ALL SELECT oligo, part, grade, NULL, CAST(sum(c) AS BIGINT), CAST(sum(k) AS BIGINT), CASE WHEN part = 'singles' THEN string_agg(kind || '=' || c, ',' ORDER BY r) FILTER (r <= 3) END FROM t GROUP BY 1, 2, 3""",
)
_TAXA = "SELECT DISTINCT 'tier' || CAST(l_suppkey % 7 AS {STR}) AS tier, CAST(1000 + l_partkey % 500 AS BIGINT) AS taxid FROM {lineitem}"
_WITHOUT = "SELECT DISTINCT 'tier' || CAST(l_suppkey % 7 AS {STR}) AS tier, CAST(2000 + l_suppkey % 11 AS BIGINT) AS taxid FROM {lineitem} WHERE l_suppkey % 7 > 1"
_ORGN = lambda c: f"string_agg('txid' || {c} || '[ORGN]', ' OR ' ORDER BY {c})"
register(
    "search_terms",
    lambda s, d: reports.search_terms(view(s, d, _TAXA), view(s, d, _WITHOUT)),
    f"""WITH t AS (SELECT *, (row_number() OVER (PARTITION BY tier ORDER BY taxid) - 1) // 20 AS chunk FROM {duck(_TAXA)}), c AS (SELECT tier, chunk, {_ORGN("taxid")} AS term FROM t GROUP BY 1, 2), w AS (SELECT tier, {_ORGN("taxid")} AS w FROM {duck(_WITHOUT)} GROUP BY 1)
SELECT tier, chunk, CASE WHEN w IS NULL THEN term ELSE '(' || term || ') NOT (' || w || ')' END AS term FROM c LEFT JOIN w USING (tier)""",
)


def _hit_table(s, d):
    sites = view(s, d, SITES).withColumn("level", specificity.level()).withColumnsRenamed({"s_start": "start", "s_end": "end", "clean3": "clean_3prime_nt"})
    return sinks.hit_rows(sites.withColumns({"query": F.col("role"), "defect_positions": F.sequence(F.lit(1), F.col("mismatches") + 1), "duplex_tm_c": F.when(F.col("gaps") == 0, 50 + F.col("mismatches") / 4)}))


register(
    "hit_table",
    _hit_table,
    f"""SELECT tier, role AS query, role, accession, taxid::VARCHAR AS taxid, '' AS organism, orientation, s_start::VARCHAR AS start, s_end::VARCHAR AS "end", {_LEVEL} AS level, '' AS source, mismatches::VARCHAR AS mismatches, gaps::VARCHAR AS gaps, '' AS ambiguous, '' AS unaligned,
'' AS mismatches_last5, clean3::VARCHAR AS clean_3prime_nt, array_to_string(generate_series(1, mismatches + 1), ',') AS defect_positions, CASE WHEN gaps = 0 THEN round(50 + mismatches / 4, 1)::VARCHAR ELSE '' END AS duplex_tm_c, '' AS delta_tm_c, '' AS duplex_dg_kcal,
'' AS oligo_alignment, '' AS subject_alignment, '' AS title FROM {_S}""",
)
