"""Queries over score floors, with their SQL: one search an order line, its taxa from the supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.operators import floors, specificity
from amplispark.plans.catalogue import register
from amplispark.plans.synthetic import duck, view

_SEARCHES = """SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS search, 'tier' || CAST(l_suppkey % 23 AS {STR}) AS tier, 'q' || CAST(l_partkey % 6 AS {STR}) AS query, CAST(17 + l_partkey % 6 * 2 AS INT) AS length,
CASE WHEN l_orderkey % 1000 = 7 AND l_suppkey % 23 > 3 OR l_suppkey % 23 = 22 AND l_partkey % 6 < 4 THEN CAST(NULL AS DOUBLE) ELSE 81190.0 * (1 + l_suppkey % 7) * (1 + l_partkey % 6) END AS space, power(10.0, CAST(2 + l_suppkey % 23 % 4 AS INT)) AS evalue,
CASE WHEN l_orderkey % 97 = 0 THEN 'upper_bound' WHEN l_orderkey % 7 = 0 THEN 'from_hits' ELSE 'reported' END AS source, l_orderkey % 4099 = 1 AND l_suppkey % 23 > 6 AS list_full,
CAST(100 + l_suppkey % 3 AS BIGINT) AS t1, CAST(200 + l_suppkey % 2 AS BIGINT) AS t2, l_suppkey % 5 = 0 AS one FROM {lineitem}"""
_FLOORED = f"""f AS (SELECT *, greatest(1, CAST(ceil(ln(0.711::DOUBLE * space / evalue) / 1.374::DOUBLE - 1e-9) AS INTEGER)) AS floor, CASE WHEN one THEN t1::VARCHAR ELSE t1 || ',' || t2 END AS "group" FROM {duck(_SEARCHES)}),
g AS (SELECT tier, query, "group", max(floor) FILTER (space IS NOT NULL) AS floor FROM f GROUP BY 1, 2, 3),
s AS (
  SELECT tier, query, max(length) AS length, max(floor) FILTER (space IS NOT NULL) AS floor, count(*) AS searches, count(*) FILTER (space IS NULL) AS without_statistics, bool_or(list_full) AS list_full,
    ['reported', 'from_hits', 'upper_bound'][coalesce(max(list_position(['reported', 'from_hits', 'upper_bound'], source)) FILTER (space IS NOT NULL), 1)] AS space_source,
    arg_max(search, row(floor, -search)) FILTER (space IS NOT NULL) AS set_by, arg_max("group", row(floor, -search)) FILTER (space IS NOT NULL) AS set_by_group
  FROM f GROUP BY 1, 2
), m AS (SELECT *, CASE WHEN floor IS NOT NULL THEN CAST(coalesce(list_max(list_filter(generate_series(0, length), lambda m: length - 4 * m >= floor AND ceil((length - m) / (m + 1)) >= 7)), -1) AS INTEGER) END AS always FROM s)"""


def _floors(s, d):
    rows = view(s, d, _SEARCHES)
    floor = F.when(F.col("space").isNotNull(), specificity.score_floor(F.lit(0.711), F.lit(1.374), F.col("space"), F.col("evalue")))
    taxids = F.when(F.col("one"), F.array("t1")).otherwise(F.array("t1", "t2"))
    return floors.floors(rows.withColumns({"floor": floor, "taxids": taxids}))


def _text(groups):
    return F.array_join(F.transform(groups, lambda g: F.concat(g["group"], F.lit("="), F.coalesce(g["floor"].cast("string"), F.lit("?")))), ";")


register(
    "floors_by_tier",
    lambda s, d: _floors(s, d).withColumn("per_group", _text(F.col("per_group"))),
    f"""WITH {_FLOORED}, t AS (SELECT tier, query, string_agg("group" || '=' || coalesce(floor::VARCHAR, '?'), ';' ORDER BY "group") AS per_group FROM g GROUP BY 1, 2)
SELECT tier, query, length, floor, always, searches, without_statistics, list_full, space_source, set_by, set_by_group, per_group FROM m JOIN t USING (tier, query)""",
)
_PROBES = [("q0", 17, True), ("q2", 21, False), ("q5", 27, False)]


def _bound(s, d):
    found = _floors(s, d)
    tiers = found.groupBy("tier").agg((F.max("length") < 0).alias("gapped_can_bind")).withColumn("gapped_can_bind", F.col("tier").isin("tier1", "tier9"))
    cut = view(s, d, "SELECT DISTINCT 'tier' || CAST(l_suppkey % 23 AS {STR}) AS tier, 'q2' AS query FROM {lineitem} WHERE l_suppkey % 23 = 4")
    return floors.probe_bound(tiers, s.createDataFrame(_PROBES, "query string, length int, mgb boolean"), found, cut, least=9)


register(
    "probe_bound",
    _bound,
    f"""WITH {_FLOORED}, p AS (SELECT * FROM (VALUES {", ".join(f"('{q}', {n}, {m})" for q, n, m in _PROBES)}) AS v(query, n, mgb)), x AS (SELECT DISTINCT tier, tier IN ('tier1', 'tier9') AS gapped FROM m),
e AS (SELECT x.tier, p.query, CASE WHEN floor IS NULL OR without_statistics > 0 THEN 'unknown' WHEN list_full OR (x.tier = 'tier4' AND p.query = 'q2') THEN 'cut' WHEN always < CASE WHEN mgb THEN 1 ELSE 2 END THEN 'mismatches'
  WHEN n - 4 * CASE WHEN mgb THEN 1 ELSE 2 END < 9 THEN 'short' END AS reason FROM x CROSS JOIN p LEFT JOIN m ON m.tier = x.tier AND m.query = p.query),
b AS (SELECT tier, arg_min(reason, query) AS reason, min(query) AS query FROM e WHERE reason IS NOT NULL GROUP BY 1)
SELECT tier, NOT gapped AND reason IS NULL AS bounded, CASE WHEN gapped THEN 'gapped' ELSE reason END AS reason, CASE WHEN NOT gapped THEN query END AS query FROM x LEFT JOIN b USING (tier)""",
)
register(
    "floor_findings",
    lambda s, d: floors.floor_findings(_floors(s, d)),
    f"""WITH {_FLOORED}, w AS (SELECT tier, query, CASE WHEN floor IS NULL THEN query || ': not known' WHEN always < 0 THEN query || ': score ' || floor || ', no site is certain'
  ELSE query || ': score ' || floor || ', up to ' || always || ' mismatches' || CASE WHEN list_full THEN ' unless cut from the full list' ELSE '' END || CASE WHEN space_source = 'reported' THEN '' ELSE ' (' || space_source || ')' END END AS w FROM m),
l AS (SELECT tier, count(*) AS oligos, string_agg(w, '; ' ORDER BY query) AS line FROM w GROUP BY 1),
h AS (SELECT tier, "group", min(floor) AS lo, max(floor) AS hi FROM g GROUP BY 1, 2),
k AS (SELECT tier, count(*) AS n, string_agg('[' || "group" || ']: ' || CASE WHEN lo IS NULL THEN 'no statistics' WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, '; ' ORDER BY '[' || "group" || ']: ' || CASE WHEN lo IS NULL THEN 'no statistics' WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END) AS s FROM h GROUP BY 1)
SELECT tier, 'INFO' AS severity, 'search' AS topic, oligos, line, CASE WHEN n > 1 THEN s END AS per_search FROM l JOIN k USING (tier)""",
)
