"""Queries over search hits, sites, products and taxa, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.operators import specificity, taxonomy
from amplispark.plans.catalogue import register
from amplispark.plans.synthetic import CONTIGS, HSPS, SITES, TAXA, dealt, duck, view
from amplispark.sources import search_hits

_H, _S, _T = duck(HSPS), duck(SITES), duck(TAXA)
_TIER_TAXA = "SELECT 'near' AS tier, CAST(10 AS BIGINT) AS taxid UNION ALL SELECT 'near', CAST(105 AS BIGINT) UNION ALL SELECT 'background', CAST(12 AS BIGINT) UNION ALL SELECT 'other', CAST(1 AS BIGINT) FROM {region} WHERE r_regionkey = 0"
_LISTED = "SELECT CASE l_returnflag WHEN 'A' THEN 'near' WHEN 'N' THEN 'background' ELSE 'other' END AS tier, CAST(CASE l_linenumber % 3 WHEN 0 THEN 10 + l_partkey % 5 WHEN 1 THEN 100 + l_partkey % 25 ELSE 1000 + l_suppkey END AS BIGINT) AS taxid FROM {lineitem}"
CLOSURE = f"""t AS (SELECT * FROM {_T}), up AS (
  SELECT taxid, taxid AS ancestor, 0 AS depth FROM t UNION ALL SELECT u.taxid, t.parent, u.depth + 1 FROM up u JOIN t ON u.ancestor = t.taxid WHERE t.parent IS NOT NULL)"""


def _closure(s, d):
    return taxonomy.ancestors(view(s, d, TAXA))


def _taxid_hits(s, d):
    return view(s, d, HSPS).withColumn("taxid", F.col("taxid") + 1000)


register("relevant_hits", lambda s, d: specificity.relevant(view(s, d, HSPS)).groupBy("tier", "query").agg(F.countDistinct("hit").alias("hits"), F.count("*").alias("hsps")), f"SELECT tier, query, count(DISTINCT hit) AS hits, count(*) AS hsps FROM {_H} WHERE identity >= 14 GROUP BY 1, 2")
register(
    "candidate_bound_topk",
    lambda s, d: specificity.candidates(view(s, d, HSPS), 200).select("tier", "query", "hit", "hsp", "u5", "u3", "lower_bound", "rank"),
    f"""WITH c AS (SELECT *, query_from - 1 AS u5, greatest(query_len - query_to, 0) AS u3 FROM {_H}),
b AS (SELECT *, CAST(greatest(align_len - identity - gaps, 0) + gaps + ceil(u5 / 4) + ceil(u3 / 4) AS INTEGER) AS lower_bound FROM c)
SELECT tier, query, hit, hsp, u5, u3, lower_bound, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tier, query ORDER BY lower_bound, identity DESC, evalue, hit, hsp) AS rank FROM b) WHERE rank <= 200""",
)
register(
    "candidate_bound_topk_2000",
    lambda s, d: specificity.candidates(view(s, d, HSPS)).select("tier", "query", "hit", "hsp", "u5", "u3", "lower_bound", "rank"),
    f"""WITH c AS (SELECT *, query_from - 1 AS u5, greatest(query_len - query_to, 0) AS u3 FROM {_H}),
b AS (SELECT *, CAST(greatest(align_len - identity - gaps, 0) + gaps + ceil(u5 / 4) + ceil(u3 / 4) AS INTEGER) AS lower_bound FROM c)
SELECT tier, query, hit, hsp, u5, u3, lower_bound, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tier, query ORDER BY lower_bound, identity DESC, evalue, hit, hsp) AS rank FROM b) WHERE rank <= 2000""",
)
_LEVEL = """CASE WHEN role = 'probe' THEN CASE WHEN mismatches <= 3 AND gaps <= 0 THEN 'critical' WHEN mismatches <= 5 AND gaps <= 1 THEN 'warning' ELSE 'minor' END
  ELSE CASE WHEN mismatches <= 3 AND gaps <= 0 AND clean3 >= 5 THEN 'critical' WHEN mismatches <= 5 AND gaps <= 1 AND clean3 >= 3 THEN 'warning' ELSE 'minor' END END"""
register(
    "site_levels",
    lambda s, d: specificity.site_variants(view(s, d, SITES)),
    f"SELECT role, level, count(*) AS sites, count(DISTINCT accession) AS records, string_agg(DISTINCT tier, ',' ORDER BY tier) AS tiers FROM (SELECT *, {_LEVEL} AS level FROM {_S}) GROUP BY 1, 2",
)
register(
    "kept_sites",
    lambda s, d: specificity.kept_sites(view(s, d, SITES)).select("site_id", "tier", "role", "level"),
    f"""SELECT site_id, tier, role, level FROM (SELECT *, row_number() OVER (PARTITION BY tier, role, level ORDER BY mismatches, gaps, clean3 DESC, site_id) AS n FROM (SELECT *, {_LEVEL} AS level FROM {_S})) WHERE level <> 'minor' OR n <= 25""",
)
register(
    "saturation",
    lambda s, d: specificity.saturation(view(s, d, HSPS), 500),
    f"WITH b AS (SELECT tier, query, hit, max(identity) AS best FROM {_H} GROUP BY 1, 2, 3) SELECT tier, query, count(*) AS n_hits, min(best) AS weakest, count(*) >= 500 AND min(best) >= 14 AS saturated FROM b GROUP BY 1, 2",
)
_SEARCHES = "SELECT CAST(s_suppkey AS BIGINT) AS search, CASE s_suppkey % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'background' ELSE 'other' END AS tier, 'q' || CAST(s_nationkey % 4 AS {STR}) AS query, CAST(17 + s_nationkey % 10 AS INT) AS length, 811905916.0 * (1 + s_suppkey % 7) AS space, power(10.0, CAST(2 + s_suppkey % 4 AS INT)) AS evalue FROM {supplier}"


def _floored(s, d):
    floor = specificity.score_floor(F.lit(0.711), F.lit(1.374), F.col("space"), F.col("evalue"))
    return view(s, d, _SEARCHES).withColumn("floor", floor)


_FLOORED = f"(SELECT *, greatest(1, CAST(ceil(ln(0.711::DOUBLE * space / evalue) / 1.374::DOUBLE - 1e-9) AS INTEGER)) AS floor FROM {duck(_SEARCHES)})"
register(
    "score_floor",
    lambda s, d: _floored(s, d).select("search", "floor", specificity.always_reported(F.col("length"), F.col("floor")).alias("always")),
    f"SELECT search, floor, CAST(coalesce(list_max(list_filter(generate_series(0, length), lambda m: length - 4 * m >= floor AND ceil((length - m) / (m + 1)) >= 7)), -1) AS INTEGER) AS always FROM {_FLOORED}",
)
register(
    "merge_sites",
    lambda s, d: specificity.merge_sites(view(s, d, SITES)),
    f"""WITH a AS (SELECT *, max(s_end) OVER (PARTITION BY tier, accession, role, orientation ORDER BY s_start, s_end, site_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_S}),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR s_start > before THEN 1 ELSE 0 END) OVER (PARTITION BY tier, accession, role, orientation ORDER BY s_start, s_end, site_id) AS island FROM a)
SELECT tier, accession, role, orientation, min(s_start) AS s_start, max(s_end) AS s_end, count(*) AS n, arg_min(site_id, row(mismatches, gaps, -clean3, site_id)) AS site_id FROM b GROUP BY tier, accession, role, orientation, island""",
)
_PAIRS = f"""s AS (SELECT * FROM {_S}), pairs AS (
  SELECT l.tier, l.accession, l.site_id AS left_id, r.site_id AS right_id, l.role AS left_role, r.role AS right_role, l.s_start AS start, r.s_end AS "end", r.s_end - l.s_start + 1 AS length
  FROM s l JOIN s r ON l.tier = r.tier AND l.accession = r.accession AND l.orientation = '+' AND r.orientation = '-' AND l.role <> 'probe' AND r.role <> 'probe'
   AND l.s_start < r.s_start AND l.s_end < r.s_end AND r.s_end - l.s_start + 1 <= 2000),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY accession, start, "end", left_id, right_id) AS n FROM pairs) WHERE n <= 500),
best AS (SELECT c.left_id, c.right_id, arg_min(p.site_id, row(p.mismatches + p.gaps, CAST(p.site_id AS VARCHAR))) AS probe_id FROM cut c JOIN s p ON p.role = 'probe' AND p.tier = c.tier AND p.accession = c.accession AND p.s_start >= c.start AND p.s_end <= c."end" GROUP BY 1, 2)"""
#: The same with nothing cut.
_ALL_PAIRS = _PAIRS.replace(" WHERE n <= 500", "")
register(
    "predict_products",
    lambda s, d: specificity.products(view(s, d, SITES)),
    f'WITH {_PAIRS} SELECT c.tier, c.accession, c.left_id, c.right_id, left_role, right_role, start, "end", length, probe_id FROM cut c LEFT JOIN best b USING (left_id, right_id)',
)
register(
    "product_groups",
    lambda s, d: specificity.product_patterns(specificity.products(view(s, d, SITES), per_tier=None)),
    f"WITH {_ALL_PAIRS} SELECT tier, left_role, right_role, probe_id IS NOT NULL AS detected, count(*) AS n, count(DISTINCT accession) AS records, min(length) AS shortest FROM cut LEFT JOIN best USING (left_id, right_id) GROUP BY 1, 2, 3, 4",
)
register(
    "overlap_antijoin",
    lambda s, d: specificity.not_overlapping(view(s, d, SITES).where("role = 'forward'"), view(s, d, SITES).where("role = 'probe' AND mismatches = 0")).select("site_id"),
    f"WITH s AS (SELECT * FROM {_S}) SELECT site_id FROM s WHERE role = 'forward' AND NOT EXISTS (SELECT 1 FROM s k WHERE k.role = 'probe' AND k.mismatches = 0 AND k.tier = s.tier AND k.accession = s.accession AND s.s_start <= k.s_end AND k.s_start <= s.s_end)",
)
_VERSIONS = f"SELECT accession FROM ({CONTIGS}) t UNION ALL SELECT split_part(accession, '.', 1) || '.' || CAST(k % 12 AS {{STR}}) FROM ({CONTIGS}) u WHERE k % 2 = 0"
register(
    "latest_version",
    lambda s, d: specificity.latest_versions(view(s, d, _VERSIONS)),
    f"SELECT split_part(accession, '.', 1) AS base, arg_max(accession, CAST(split_part(accession, '.', 2) AS INTEGER)) AS accession, max(CAST(split_part(accession, '.', 2) AS INTEGER)) AS version FROM {duck(_VERSIONS)} GROUP BY 1",
)
register(
    "store_listing",
    lambda s, d: specificity.listed_store(view(s, d, CONTIGS).select("accession", "level"), view(s, d, CONTIGS).where("k % 4 <> 0"), cut=False),
    f"SELECT accession, level FROM {duck(CONTIGS)} WHERE k % 4 <> 0",
)
register("tier_dedupe", lambda s, d: taxonomy.dedupe_tiers(view(s, d, _LISTED)), f"WITH l AS (SELECT DISTINCT tier, taxid FROM {duck(_LISTED)}) SELECT taxid, ['near', 'background', 'other'][min(list_position(['near', 'background', 'other'], tier))] AS tier, count(*) AS named FROM l GROUP BY 1")
_DEDUPED = f"d AS (SELECT taxid, ['near', 'background', 'other'][min(list_position(['near', 'background', 'other'], tier))] AS tier FROM {duck(_LISTED)} GROUP BY 1)"
register(
    "tier_lineage",
    lambda s, d: taxonomy.lineage_rules(taxonomy.dedupe_tiers(view(s, d, _LISTED)), _closure(s, d), 103),
    f"""WITH RECURSIVE {CLOSURE}, {_DEDUPED}, r AS (SELECT *, list_position(['near', 'background', 'other'], tier) AS r FROM d)
SELECT d.taxid, d.tier, CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.taxid = d.taxid AND ancestor = 103) THEN 'refused' WHEN EXISTS (SELECT 1 FROM up WHERE up.taxid = 103 AND ancestor = d.taxid) THEN 'exclude_target' ELSE 'plain' END AS rule,
(SELECT count(*) FROM up JOIN r o ON up.taxid = o.taxid WHERE up.ancestor = d.taxid AND depth > 0 AND o.r < d.r) AS excluded FROM r d""",
)
register(
    "outside_target",
    lambda s, d: taxonomy.outside(view(s, d, _LISTED).select("taxid").distinct(), _closure(s, d), 11),
    f"WITH RECURSIVE {CLOSURE} SELECT DISTINCT taxid FROM {duck(_LISTED)} WHERE taxid NOT IN (SELECT taxid FROM up WHERE ancestor = 11)",
)
register(
    "tier_restriction",
    lambda s, d: taxonomy.in_tier(_taxid_hits(s, d), view(s, d, _TIER_TAXA), _closure(s, d)).groupBy("tier").agg(F.count(F.when(F.col("inside"), 1)).alias("inside"), F.count(F.when(~F.col("inside"), 1)).alias("set_aside"), F.count(F.when(~F.col("checkable"), 1)).alias("not_checkable")),
    f"""WITH RECURSIVE {CLOSURE}, x AS (SELECT h.tier, (SELECT count(*) FROM up JOIN {duck(_TIER_TAXA)} tt ON up.ancestor = tt.taxid WHERE up.taxid = h.taxid + 1000 AND tt.tier = h.tier) > 0 AS below, h.taxid + 1000 IN (SELECT taxid FROM t) AS known FROM {_H} h)
SELECT tier, count(*) FILTER (below OR NOT known) AS inside, count(*) FILTER (NOT below AND known) AS set_aside, count(*) FILTER (NOT known) AS not_checkable FROM x GROUP BY 1""",
)
_ASKED = "SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'Supplier#' || CAST(p_partkey % 30 AS {STR}) WHEN 1 THEN substr(p_type, 1, 5) ELSE p_brand END AS name FROM {part}"
_NAMES = "SELECT CASE WHEN p_partkey % 7 < 4 THEN substr(p_type, 1, 5) ELSE p_type END AS name, CAST(p_size AS BIGINT) AS taxid FROM {part}"
_SYN = "SELECT p_brand AS name, CASE WHEN right(p_brand, 1) IN ('1', '3') THEN CAST(5000 AS BIGINT) ELSE CAST(p_partkey AS BIGINT) END AS taxid FROM {part}"
register(
    "name_resolution",
    lambda s, d: taxonomy.resolve_names(view(s, d, _ASKED), view(s, d, _NAMES), view(s, d, _SYN)),
    f"""WITH f AS (SELECT name, count(DISTINCT taxid) AS n, min(taxid) AS id FROM {duck(_NAMES)} GROUP BY 1), y AS (SELECT name, count(DISTINCT taxid) AS n, min(taxid) AS id FROM {duck(_SYN)} GROUP BY 1),
r AS (SELECT a.name, coalesce(f.n, y.n, 0) AS n, coalesce(f.id, y.id) AS id FROM {duck(_ASKED)} a LEFT JOIN f ON f.name = a.name LEFT JOIN y ON y.name = a.name)
SELECT name, CASE WHEN n = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS taxid FROM r""",
)
_LIN_SQL = f"{CLOSURE}, lin AS (SELECT up.taxid, max(name) FILTER (rank = 'species') AS species, max(name) FILTER (rank = 'genus') AS genus, max(name) FILTER (rank = 'family') AS family FROM up JOIN t ON t.taxid = up.ancestor GROUP BY 1)"
register("lineage_by_rank", lambda s, d: taxonomy.lineage(view(s, d, TAXA), _closure(s, d)), f"WITH RECURSIVE {_LIN_SQL} SELECT * FROM lin")
register(
    "taxonomy_rollup",
    lambda s, d: taxonomy.rollup(view(s, d, SITES).select((F.col("taxid") + 1000).alias("taxid")), taxonomy.lineage(view(s, d, TAXA), _closure(s, d))),
    f"WITH RECURSIVE {_LIN_SQL} SELECT family, genus, species, count(*) AS n, CAST(grouping_id(family, genus, species) AS INTEGER) AS g FROM {_S} x LEFT JOIN lin ON lin.taxid = x.taxid + 1000 GROUP BY GROUPING SETS ((family, genus, species), (family, genus), (family), ())",
)
_ORGANISMS = "SELECT CAST(10 + r_regionkey AS BIGINT) AS taxid FROM {region} UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT) FROM {nation} WHERE n_nationkey % 2 = 0 UNION ALL SELECT CAST(900000 + r_regionkey AS BIGINT) FROM {region}"
register(
    "exclusivity_rows",
    lambda s, d: taxonomy.exclusivity(
        view(s, d, _ORGANISMS),
        view(s, d, SITES).select("site_id", (F.col("taxid") + 1000).alias("taxid"), F.when(specificity.level() == "critical", 2).when(specificity.level() == "warning", 1).otherwise(0).alias("level_rank"), (F.col("mismatches") + F.col("gaps")).alias("defects")),
        _closure(s, d),
    ),
    f"""WITH RECURSIVE {CLOSURE}, o AS (SELECT * FROM {duck(_ORGANISMS)}), x AS (SELECT site_id, taxid + 1000 AS taxid, list_position(['minor', 'warning', 'critical'], {_LEVEL}) AS r, mismatches + gaps AS defects FROM {_S}),
a AS (SELECT site_id, arg_min(ancestor, row(depth, -ancestor)) AS listed, any_value(r) AS r, any_value(defects) AS defects FROM x JOIN up ON up.taxid = x.taxid JOIN o ON o.taxid = up.ancestor GROUP BY 1),
c AS (SELECT listed, count(*) AS n, arg_max(site_id, row(r, -defects, -site_id)) AS best FROM a GROUP BY 1)
SELECT o.taxid, coalesce(n, 0) AS n, best FROM o LEFT JOIN c ON c.listed = o.taxid""",
)
_ROLES = "SELECT CAST(100 + n_nationkey AS BIGINT) AS taxid, CASE n_nationkey % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'nontarget' ELSE 'out_of_scope' END AS role, CAST(n_nationkey AS INT) AS pos FROM {nation} WHERE n_nationkey % 4 <> 0 UNION ALL SELECT CAST(11 AS BIGINT), 'target', 99 FROM {region} WHERE r_regionkey = 0"
register(
    "channel_membership",
    lambda s, d: taxonomy.membership(view(s, d, SITES).select((F.col("taxid") + 1000).alias("taxid")).distinct(), view(s, d, _ROLES), _closure(s, d)),
    f"WITH RECURSIVE {CLOSURE}, r AS (SELECT * FROM {duck(_ROLES)}) SELECT x.taxid, coalesce(arg_min(role, pos), 'unknown') AS role FROM (SELECT DISTINCT taxid + 1000 AS taxid FROM {_S}) x LEFT JOIN up ON up.taxid = x.taxid LEFT JOIN r ON r.taxid = up.ancestor GROUP BY 1",
)
_KEYED = "SELECT CAST(c_custkey AS BIGINT) AS taxid, CAST(c_nationkey AS INT) AS tier, CAST(15 + c_custkey % 20 AS INT) AS len FROM {customer}"
register(
    "chunk_balance",
    lambda s, d: taxonomy.chunks(view(s, d, _KEYED), 20, "tier", "taxid").select("tier", "taxid", "chunk"),
    f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY tier) AS n, row_number() OVER (PARTITION BY tier ORDER BY taxid) - 1 AS r FROM {duck(_KEYED)}),
k AS (SELECT *, CAST(ceil(n / 20) AS BIGINT) AS k FROM n), e AS (SELECT *, n // k AS s, n % k AS e FROM k)
SELECT tier, taxid, CAST(1 + CASE WHEN r < e * (s + 1) THEN r // (s + 1) ELSE e + (r - e * (s + 1)) // s END AS INTEGER) AS chunk FROM e""",
)
register(
    "query_batches",
    lambda s, d: taxonomy.batches(view(s, d, _KEYED), 100, "tier", "taxid", "len"),
    f"""WITH RECURSIVE o AS (SELECT tier, len, row_number() OVER (PARTITION BY tier ORDER BY taxid) AS r FROM {duck(_KEYED)}),
b AS (SELECT tier, r, len AS used, 0 AS batch FROM o WHERE r = 1 UNION ALL
  SELECT o.tier, o.r, CASE WHEN b.used + o.len > 100 THEN o.len ELSE b.used + o.len END, b.batch + CASE WHEN b.used + o.len > 100 THEN 1 ELSE 0 END FROM b JOIN o ON o.tier = b.tier AND o.r = b.r + 1)
SELECT tier, string_agg(CAST(batch AS VARCHAR), ',' ORDER BY r) AS batches FROM b GROUP BY 1""",
)
register(
    "unsearched_tiers",
    lambda s, d: taxonomy.not_searched(view(s, d, _LISTED), view(s, d, _LISTED).where("taxid = 1001 AND tier = 'near'"), view(s, d, _LISTED).where("taxid < 0")),
    f"WITH l AS (SELECT * FROM {duck(_LISTED)}) SELECT DISTINCT tier FROM l WHERE tier NOT IN (SELECT tier FROM l WHERE taxid = 1001 AND tier = 'near')",
)


def _reports(s, d):
    """Search reports as JSON text, one per order, from lineitem."""
    hsp = "struct(1 AS num, 40.1D AS bit_score, score, evalue, identity, query_from, query_to, 100 AS hit_from, 120 AS hit_to, 'Plus' AS hit_strand, align_len, gaps, 'ACGT' AS qseq, 'ACGT' AS hseq)"
    hits = view(s, d, HSPS).selectExpr("hit AS report", "query", "query_len", f"struct(hsp AS num, array(struct(concat('gb|AB', taxid, '.', hsp, '|') AS id, concat('AB', taxid) AS accession, 'x' AS title, taxid, 'y' AS sciname)) AS description, 900 AS len, array({hsp}) AS hsps) AS h")
    each = dealt(s, d, "lineitem", hits, "report", "query").groupBy("report", "query").agg(F.max("query_len").alias("query_len"), F.sort_array(F.collect_list("h")).alias("hits"))
    search = F.expr("struct(query AS query_title, query_len, hits, struct(1000000L AS db_len, 0D AS eff_space, 0.711D AS kappa, 1.374D AS lambda) AS stat)")
    report = F.struct(F.array(F.struct(F.struct(F.lit("blastn").alias("program"), F.struct(search.alias("search")).alias("results")).alias("report"))).alias("BlastOutput2"))
    return each.select(F.to_json(report).alias("value"))


register(
    "blast_flatten",
    lambda s, d: search_hits.parse_reports(_reports(s, d), stretch=("score", "identity")).groupBy("query", "accession", "taxid").agg(F.count("*").alias("hsps"), F.sum("score").alias("score"), F.max("identity").alias("identity")),
    f"SELECT query, 'AB' || taxid || '.' || hsp AS accession, taxid, count(*) AS hsps, CAST(sum(score) AS BIGINT) AS score, max(identity) AS identity FROM {_H} GROUP BY 1, 2, 3",
)
register(
    "search_space",
    lambda s, d: search_hits.effective_space(_reports(s, d)).groupBy("query", "source").agg(F.count("*").alias("n"), F.round(F.log(F.max("space")), 6).alias("log_space")),
    f"WITH r AS (SELECT hit, query, max(evalue / (0.711 * exp(-1.374 * score))) AS space FROM {_H} GROUP BY 1, 2) SELECT query, 'hits' AS source, count(*) AS n, round(ln(max(space)), 6) AS log_space FROM r GROUP BY 1",
)
