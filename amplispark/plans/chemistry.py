"""Queries over oligo checks beyond the bands, with their SQL; no check and no row is left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.functions import thermo
from amplispark.operators import chemistry, oligo_qc
from amplispark.plans.catalogue import register
from amplispark.plans.sequences import _EIGHTS, _OLIGO_ROWS, _QC_SQL, _TM, DEGENERATE, _table
from amplispark.plans.synthetic import duck, view

_VARIANTS = _QC_SQL[: _QC_SQL.index("), t AS (")] + ")"
_SUM = lambda t, x: f"list_sum(list_transform(generate_series(1, length({x}) - 1), lambda i: ({_table(t)})[substr({x}, i, 2)]))"
_WORST = "['INFO', 'PASS', 'WARN', 'FAIL'][max(r)]"


def _worst(checks):
    ranks = checks.withColumn("r", oligo_qc.rank(F.col("status")))
    return ranks.groupBy("oligo", "role", "check").agg(
        oligo_qc.status_of(F.max("r")).alias("status"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.count("*").alias("n_variants")
    )


register(
    "qc_end_checks",
    lambda s, d: _worst(chemistry.end_checks(view(s, d, _OLIGO_ROWS, spread=True))),
    f"""{_VARIANTS}, v AS (SELECT oligo, role, v, right(v, 5) AS last5 FROM e WHERE rest = ''), c AS (
SELECT oligo, role, 'gc_last5' AS "check", CAST(length(regexp_replace(last5, '[^GC]', '', 'g')) AS DOUBLE) AS value, CASE WHEN length(regexp_replace(last5, '[^GC]', '', 'g')) BETWEEN 1 AND 3 THEN 2 ELSE 3 END AS r FROM v WHERE role <> 'probe'
UNION ALL SELECT oligo, role, 'three_prime_dg', {_SUM(thermo.DG, "last5")}, 1 FROM v WHERE role <> 'probe'
UNION ALL SELECT oligo, role, 'g_minus_c', CAST(length(regexp_replace(v, '[^G]', '', 'g')) - length(regexp_replace(v, '[^C]', '', 'g')) AS DOUBLE),
  CASE WHEN length(regexp_replace(v, '[^G]', '', 'g')) > length(regexp_replace(v, '[^C]', '', 'g')) THEN 3 ELSE 2 END FROM v WHERE role = 'probe')
SELECT oligo, role, "check", {_WORST} AS status, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) AS n_variants FROM c GROUP BY 1, 2, 3""",
)
register(
    "qc_melting",
    lambda s, d: _worst(oligo_qc.variant_checks(view(s, d, _OLIGO_ROWS, spread=True)).where(F.col("check") == "tm")),
    f"""{_VARIANTS}, {_TM}, g AS (SELECT *, CASE WHEN role = 'probe' THEN 1 WHEN tm BETWEEN 58 AND 66 THEN 2 WHEN tm BETWEEN 54 AND 70 THEN 3 ELSE 4 END AS r FROM m)
SELECT oligo, role, 'tm' AS "check", {_WORST} AS status, round(min(tm), 6) AS low, round(max(tm), 6) AS high, count(*) AS n_variants FROM g GROUP BY 1, 2""",
)
register(
    "qc_overall_all_checks",
    lambda s, d: oligo_qc.overall(_worst(oligo_qc.variant_checks(view(s, d, _OLIGO_ROWS, spread=True)).unionByName(chemistry.end_checks(view(s, d, _OLIGO_ROWS, spread=True))))),
    f"""{_VARIANTS}, n AS (SELECT count(DISTINCT oligo) FILTER (role = 'probe') AS p, count(DISTINCT oligo) FILTER (role <> 'probe') AS q FROM e), {_TM}
SELECT CASE WHEN bool_or(length(v) > 40 OR length(v) < 12 OR regexp_matches(v, 'A{{7}}|C{{7}}|T{{7}}|G{{6}}') OR 100.0 * length(regexp_replace(v, '[^GC]', '', 'g')) / length(v) NOT BETWEEN CASE WHEN role = 'probe' THEN 20 ELSE 30 END AND CASE WHEN role = 'probe' THEN 90 ELSE 70 END)
  OR (SELECT bool_or(tm NOT BETWEEN 54 AND 70) FROM m WHERE role <> 'probe') THEN 'FAIL' END AS status,
  (SELECT CAST(p * 6 + q * 7 AS BIGINT) FROM n) AS n_checks FROM e WHERE rest = ''""",
)
_TMS = "SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS assay, CAST(p_partkey AS {STR}) AS oligo, CASE WHEN p_partkey % 8 < 3 THEN 'forward' WHEN p_partkey % 8 < 6 THEN 'reverse' ELSE 'probe' END AS role, CASE WHEN p_partkey % 8 < 6 THEN 55.0 ELSE 60.0 END + p_size / 4.0 AS low, CASE WHEN p_partkey % 8 < 6 THEN 55.0 ELSE 60.0 END + p_size / 4.0 + p_partkey % 3 AS high, p_partkey % 5 = 0 AS unreliable FROM {part}"
_DIFF_RANK = lambda x: f"CASE WHEN {x} BETWEEN 5 AND 12 THEN 1 WHEN {x} BETWEEN 0 AND 15 THEN 2 ELSE 3 END"
register(
    "probe_tm_difference",
    lambda s, d: chemistry.probe_tm_difference(view(s, d, _TMS)),
    f"""WITH t AS (SELECT * FROM {duck(_TMS)}), p AS (SELECT assay, max(high) FILTER (role = 'forward') AS fh, max(high) FILTER (role = 'reverse') AS rh, min(low) FILTER (role = 'forward') AS fl, min(low) FILTER (role = 'reverse') AS rl FROM t GROUP BY 1),
x AS (SELECT assay, oligo, unreliable, low - (fh + rh) / 2 AS low, high - (fl + rl) / 2 AS high FROM t JOIN p USING (assay) WHERE role = 'probe')
SELECT assay, oligo, low, high, CASE greatest({_DIFF_RANK("low")}, {_DIFF_RANK("high")}) WHEN 1 THEN 'PASS' WHEN 2 THEN 'WARN' ELSE CASE WHEN unreliable THEN 'WARN' ELSE 'FAIL' END END AS status FROM x WHERE low IS NOT NULL""",
)
_DYES = f"SELECT CAST(k AS {{STR}}) AS oligo, CASE k % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'G' ELSE '' END || sequence AS sequence, CASE k % 4 WHEN 0 THEN '6-fam' WHEN 1 THEN 'HEX' WHEN 2 THEN ' FITC' END AS reporter FROM ({DEGENERATE}) t"
register(
    "five_prime_g",
    lambda s, d: chemistry.five_prime_g(view(s, d, _DYES)),
    f"""WITH o AS (SELECT *, left(sequence, 1) AS a, upper(trim(coalesce(reporter, ''))) AS dye FROM {duck(_DYES)})
SELECT oligo, CASE a WHEN 'R' THEN 'A/G' ELSE a END AS bases, CASE WHEN a NOT IN ('G', 'R') THEN 'PASS' WHEN dye = '' OR contains(dye, 'FAM') OR contains(dye, 'FITC') THEN 'WARN' ELSE 'INFO' END AS status FROM o""",
)
_FOUND = "SELECT CAST(p_partkey % 97 AS BIGINT) AS assay, CASE p_partkey % 2 WHEN 0 THEN 'hairpin' ELSE 'self_dimer' END AS kind, 'o' || CAST(p_size % 4 AS {STR}) AS label, 'v' || CAST(p_partkey AS {STR}) AS variant, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS DOUBLE) + p_partkey % 17 END AS tm, CASE WHEN p_partkey % 3 > 0 THEN -CAST(p_size AS DOUBLE) END AS dg FROM {part}"
register(
    "structure_results",
    lambda s, d: chemistry.worst_structures(view(s, d, _FOUND)),
    f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY assay, kind, label ORDER BY tm DESC NULLS LAST, variant DESC) AS r, count(*) OVER (PARTITION BY assay, kind, label) AS variants FROM {duck(_FOUND)})
SELECT assay, kind, label, tm IS NOT NULL AS found, tm, dg, CASE WHEN tm >= 60 THEN 'FAIL' WHEN tm >= 47 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN variants > 1 AND tm IS NOT NULL THEN variant END AS variant, variants FROM f WHERE r = 1""",
)
register("structures", lambda s, d: chemistry.structures(view(s, d, _EIGHTS, spread=True)).groupBy("kind", "status").agg(F.count("*").alias("n"), F.sum(F.col("found").cast("int")).alias("found")))
