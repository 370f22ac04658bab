"""Queries over report tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.operators import assess, reports, specificity
from amplispark.plans.catalogue import register
from amplispark.plans.grades import EVIDENCE, PRIMERS
from amplispark.plans.search import _ALL_PAIRS, _LEVEL, _PAIRS
from amplispark.plans.sequences import DEGENERATE
from amplispark.plans.synthetic import CONTIGS, HSPS, SITES, duck, view

_H, _S = duck(HSPS), duck(SITES)
register(
    "site_changes",
    lambda s, d: view(s, d, PRIMERS).select("k", reports.site_changes(F.col("q"), F.col("s")).alias("changes")),
    f"""SELECT k, coalesce(array_to_string(list_transform(list_filter(generate_series(1, 20), lambda i: substr(q, i, 1) <> substr(s, i, 1)), lambda i: '-' || (21 - i) || ' ' || substr(q, i, 1) || '-' || translate(substr(s, i, 1), 'ACGT', 'TGCA')), ', '), '') AS changes FROM {duck(PRIMERS)}""",
)
_TIER_LIST = "SELECT CASE WHEN n_nationkey < 22 THEN 'near' ELSE 'background' END AS tier, CAST(n_nationkey AS BIGINT) AS taxid FROM {nation}"
_ALL_OLIGOS = f"SELECT 'o' || CAST(k AS {{STR}}) AS oligo, sequence FROM ({DEGENERATE}) t"
register(
    "planned_searches",
    lambda s, d: reports.planned_searches(view(s, d, _ALL_OLIGOS, spread=True), view(s, d, _TIER_LIST)).groupBy("tier", "chunk", "term").agg(F.count("*").alias("searches"), F.countDistinct("key").alias("keys"), F.countDistinct("label").alias("labels")),
    f"""WITH t AS (SELECT *, (row_number() OVER (PARTITION BY tier ORDER BY taxid) - 1) // 20 AS chunk FROM {duck(_TIER_LIST)}), c AS (SELECT tier, chunk, string_agg('txid' || taxid || '[ORGN]', ' OR ' ORDER BY taxid) AS term FROM t GROUP BY 1, 2),
n AS (SELECT CAST(sum(list_product(list_transform(regexp_extract_all(sequence, '[^ACGT]'), lambda c: CASE WHEN c = 'N' THEN 4 WHEN c IN ('B', 'D', 'H', 'V') THEN 3 ELSE 2 END))) AS BIGINT) AS n FROM {duck(_ALL_OLIGOS)})
SELECT tier, chunk, term, n AS searches, n AS keys, n AS labels FROM c, n""",
)
_ASKED = "SELECT 'GCA_' || lpad(CAST(o_orderkey + o_orderkey % 2 * 500000 AS {STR}), 9, '0') || '.' || CAST(1 + o_orderkey % 2 AS {STR}) AS accession, CAST(1 + o_custkey % 100 AS INT) AS start, CAST(20 + o_custkey % 100 AS INT) AS stop FROM {orders}"
register(
    "window_fetch",
    lambda s, d: reports.fetch_windows(view(s, d, _ASKED), view(s, d, CONTIGS)),
    f"SELECT a.accession, start, stop, substr(c.seq, start, stop - start + 1) AS window FROM {duck(_ASKED)} a LEFT JOIN {duck(CONTIGS)} c ON a.accession = c.accession",
)
_CACHE = "SELECT CAST(o_custkey AS BIGINT) AS key, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS value, o_orderdate + CAST(o_orderkey AS INT) * INTERVAL '1' SECOND AS created FROM {orders}"
register(
    "cache_entries",
    lambda s, d: reports.fresh(view(s, d, _CACHE), F.expr("TIMESTAMP '2000-01-01 00:00:00'"), 900).select("key", "value"),
    f"SELECT key, arg_max(value, created) AS value FROM {duck(_CACHE)} WHERE value IS NOT NULL AND created > TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 900 DAYS GROUP BY 1",
)
_GRADES = "CASE site_id % 5 WHEN 0 THEN 'perfect' WHEN 1 THEN 'tolerated' WHEN 2 THEN 'at_risk' WHEN 3 THEN 'likely_failure' ELSE 'indeterminate' END"
register(
    "acting_sites",
    lambda s, d: view(s, d, SITES).withColumn("level", specificity.level()).withColumn("grade", F.expr(_GRADES)).withColumn("acts", reports.acts(F.col("grade"), F.col("level"), F.col("tier") == "near")).groupBy("tier", "role", "acts").agg(F.count("*").alias("n")),
    f"""SELECT tier, role, CASE WHEN grade = 'likely_failure' THEN false WHEN grade IN ('perfect', 'tolerated') THEN true WHEN tier = 'near' THEN level <> 'minor' ELSE level = 'critical' END AS acts, count(*) AS n
FROM (SELECT *, {_LEVEL} AS level, {_GRADES} AS grade FROM {_S}) GROUP BY 1, 2, 3""",
)
register(
    "perfect_hits",
    lambda s, d: reports.perfect_hits(view(s, d, HSPS)),
    f"WITH p AS (SELECT query, hit, bool_or(identity = query_len AND gaps = 0) AS p FROM {_H} GROUP BY 1, 2) SELECT query, count(*) FILTER (p) AS perfect, count(*) AS hits FROM p GROUP BY 1",
)
register(
    "hits_per_query",
    lambda s, d: reports.hits_per_query(view(s, d, HSPS), ["near", "background", "other"]),
    f"SELECT query, count(DISTINCT hit) FILTER (tier = 'near') AS near, count(DISTINCT hit) FILTER (tier = 'background') AS background, count(DISTINCT hit) FILTER (tier = 'other') AS other FROM {_H} GROUP BY 1",
)
_MOLECULES = "SELECT CAST(l_orderkey AS BIGINT) AS accession, CASE l_linenumber % 4 WHEN 0 THEN 'plasmid' WHEN 1 THEN 'chromosome' ELSE NULL END AS role, CASE WHEN l_partkey % 2 = 0 THEN 'strain x plasmid pA' ELSE 'strain x chromosome' END AS title FROM {lineitem}"
register(
    "plasmid_majority",
    lambda s, d: reports.majority_plasmid(view(s, d, _MOLECULES)),
    f"SELECT accession, avg(CASE WHEN coalesce(role = 'plasmid', title LIKE '%plasmid%') THEN 1.0 ELSE 0.0 END) >= 0.5 AS on_plasmid, count(*) AS copies FROM {duck(_MOLECULES)} GROUP BY 1",
)
_CUT = "SELECT CAST(o_orderkey AS BIGINT) AS accession, CASE WHEN o_orderkey % 4 = 0 THEN 'complete' ELSE 'contig' END AS level, CAST(o_custkey % 3 AS INT) AS anchored, o_custkey % 5 AS seen_n, o_orderkey % 3 = 0 AS sites_ok, CASE WHEN o_custkey % 2 = 0 THEN 'reverse' ELSE 'forward' END AS lost1 FROM {orders}"
register(
    "cut_reasons",
    lambda s, d: reports.cut_kinds(view(s, d, _CUT).withColumn("seen", F.expr("CASE WHEN seen_n = 0 THEN array() ELSE array(seen_n) END")).withColumn("lost", F.array("lost1", F.lit("probe")))),
    f"""SELECT CASE WHEN anchored = 0 THEN 'not_assembled' WHEN seen_n = 0 THEN 'no_site' WHEN NOT sites_ok THEN 'sites_fail' WHEN lost1 = 'reverse' THEN 'site_cut_ok:probe,reverse' ELSE 'site_cut_ok:forward,probe' END AS kind,
count(*) AS genomes, count(*) FILTER (level = 'complete') AS complete FROM {duck(_CUT)} GROUP BY 1""",
)
_STATES = "SELECT CAST(l_orderkey AS BIGINT) AS accession, CASE WHEN l_linenumber % 2 = 0 THEN 'FAM' ELSE 'HEX' END AS channel, CAST(l_partkey % 3 AS BIGINT) AS copy, CASE WHEN l_quantity < 10 THEN 'fail' WHEN l_quantity < 15 THEN 'undetermined' ELSE 'ok' END AS state FROM {lineitem}"
register(
    "channel_states",
    lambda s, d: reports.channel_states(view(s, d, _STATES)),
    f"WITH c AS (SELECT accession, channel, copy, max(list_position(['ok', 'undetermined', 'fail'], state)) AS r FROM {duck(_STATES)} GROUP BY 1, 2, 3) SELECT accession, channel, ['ok', 'undetermined', 'fail'][min(r)] AS state, count(*) AS copies FROM c GROUP BY 1, 2",
)
_RUN_LABELS = "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'complete' ELSE 'contig' END AS level, 'A' || CAST(o_custkey % 13 AS {STR}) AS label, CAST(o_orderkey AS BIGINT) AS pos FROM {orders}"
register(
    "run_lengths",
    lambda s, d: reports.run_lengths(view(s, d, _RUN_LABELS)),
    f"WITH n AS (SELECT level, label, count(*) AS n, min(pos) AS first FROM {duck(_RUN_LABELS)} GROUP BY 1, 2) SELECT level, label, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, first) AS r FROM n) WHERE r <= 5",
)
_ALT = "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'undetermined' WHEN 1 THEN 'likely_failure' ELSE 'detectable' END AS outcome, o_custkey % 5 = 0 AS bulge, CAST(o_custkey % 4 AS INT) AS f, CAST(o_orderkey % 5 AS INT) AS r FROM {orders}"
register(
    "alternative_share",
    lambda s, d: reports.alternative_share(view(s, d, _ALT)),
    f"""SELECT count(*) AS judged, round(100.0 * count(*) FILTER (outcome = 'detectable') / count(*), 6) AS percent, round(100.0 * count(*) FILTER (outcome = 'detectable' AND NOT bulge) / count(*), 6) AS without_bulges,
count(*) FILTER (f >= 2 AND r >= 2) AS two_and_two, count(*) FILTER (f = 0 AND r >= 3) AS reverse_only FROM {duck(_ALT)} WHERE outcome <> 'undetermined'""",
)
register(
    "tier_overview",
    lambda s, d: reports.tier_overview(view(s, d, SITES), specificity.products(view(s, d, SITES), per_tier=None)),
    f"""WITH {_ALL_PAIRS}, c AS (SELECT tier, count(*) AS sites, min(mismatches + gaps) AS closest FROM s WHERE role <> 'probe' GROUP BY 1),
m AS (SELECT tier, count(*) AS products, count(DISTINCT accession) AS records, count(probe_id) AS detected FROM cut LEFT JOIN best USING (left_id, right_id) GROUP BY 1)
SELECT coalesce(c.tier, m.tier) AS tier, coalesce(sites, 0) AS sites, coalesce(closest, 0) AS closest, coalesce(products, 0) AS products, coalesce(records, 0) AS records, coalesce(detected, 0) AS detected FROM c FULL JOIN m ON c.tier = m.tier""",
)
_FOUND = f"""(WITH s AS (SELECT *, {_LEVEL} AS level FROM {_S}) SELECT CASE WHEN role = 'probe' THEN 'INFO' ELSE 'WARN' END AS severity, CASE WHEN role = 'probe' THEN 'probe site' ELSE 'primer site' END AS topic, tier, count(*) AS n FROM s WHERE level <> 'minor' GROUP BY 1, 2, 3)"""


def _findings(s, d):
    sites = view(s, d, SITES).withColumn("level", specificity.level())
    return assess.findings(sites, sites.select("tier").distinct())


register("decision_lines", lambda s, d: reports.decision_lines(_findings(s, d)), f"SELECT severity, topic, string_agg(DISTINCT tier, ', ' ORDER BY tier) AS tiers, CAST(sum(n) AS BIGINT) AS n FROM {_FOUND} GROUP BY 1, 2")
register("findings_verdict", lambda s, d: reports.findings_verdict(_findings(s, d)), f"SELECT CASE WHEN bool_or(severity = 'WARN') THEN 'WARN' ELSE 'PASS' END AS verdict, count(*) AS n FROM {_FOUND}")
_DESCRIBED = "SELECT CASE l_returnflag WHEN 'A' THEN 'near' WHEN 'N' THEN 'background' ELSE 'other' END AS tier, l_partkey % 3 = 0 AS inside, 'org' || CAST(l_suppkey % 40 AS {STR}) AS organism FROM {lineitem}"
register(
    "restriction_summary",
    lambda s, d: reports.set_aside(view(s, d, _DESCRIBED)),
    f"""WITH n AS (SELECT tier, inside, organism, count(*) AS n FROM {duck(_DESCRIBED)} GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n DESC, organism) AS r FROM n WHERE NOT inside)
SELECT n.tier, CAST(coalesce(sum(n) FILTER (inside), 0) AS BIGINT) AS inside, CAST(coalesce(sum(n) FILTER (NOT inside), 0) AS BIGINT) AS outside, (SELECT string_agg(organism, ', ' ORDER BY r) FROM t WHERE r <= 5 AND t.tier = n.tier) AS others FROM n GROUP BY 1""",
)
_EVIDENCE = f"SELECT 'forward' AS oligo, site, observed FROM ({EVIDENCE}) e WHERE observed IS NOT NULL"
register(
    "evidence_use",
    lambda s, d: reports.evidence_use(view(s, d, PRIMERS).select(F.lit("forward").alias("oligo"), F.col("s").alias("site")), view(s, d, _EVIDENCE)),
    f"SELECT 'forward' AS oligo, e.site, observed, (SELECT count(*) FROM {duck(PRIMERS)} p WHERE p.s = e.site) AS n FROM {duck(EVIDENCE)} e WHERE observed IS NOT NULL",
)
register(
    "merged_patterns",
    lambda s, d: reports.merged_patterns(view(s, d, PRIMERS).groupBy(F.lit("forward").alias("oligo"), F.col("s").alias("site"), "q").agg(F.count("*").alias("n")).withColumn("pattern", F.regexp_replace(reports.site_changes(F.col("q"), F.col("site")), " [ACGT]-[ACGT]", "")).drop("q")),
    f"""WITH v AS (SELECT s AS site, count(*) AS n, coalesce(array_to_string(list_transform(list_filter(generate_series(1, 20), lambda i: substr(any_value(q), i, 1) <> substr(s, i, 1)), lambda i: '-' || (21 - i)), ', '), '') AS pattern FROM {duck(PRIMERS)} GROUP BY 1)
SELECT 'forward' AS oligo, pattern, CAST(sum(n) AS BIGINT) AS n, count(*) AS variants, arg_min(site, row(-n, site)) AS site FROM v GROUP BY 2""",
)
register(
    "spread_sample",
    lambda s, d: reports.spread_sample(view(s, d, "SELECT CAST(p_partkey AS BIGINT) AS k FROM {part}"), 37, "k"),
    "WITH p AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS p, count(*) OVER () AS n FROM part) SELECT CAST(k AS BIGINT) AS k FROM p WHERE n <= 37 OR p = 0 OR floor(p * 37 / n) <> floor((p - 1) * 37 / n)",
)
