"""Queries over sequence strings and oligo checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.functions import seq, thermo
from amplispark.operators import oligo_qc
from amplispark.plans.catalogue import register
from amplispark.plans.synthetic import CONTIGS, OLIGOS, dna, duck, view

PARTS = f"SELECT CAST(p_partkey AS BIGINT) AS k, {dna('p_partkey')} AS d, p_name, p_type FROM {{part}}"
#: Oligos with degenerate codes, one per part.
DEGENERATE = f"""
SELECT CAST(p_partkey AS BIGINT) AS k, substr({dna('p_partkey')}, 1, 8) || substr('RYSWKMBDHVN', CAST(1 + p_partkey % 11 AS INT), 1)
    || substr({dna('p_partkey')}, 9, 8) || substr('NACGTRYACGT', CAST(1 + p_partkey % 11 AS INT), 1) || substr({dna('p_partkey')}, 17, 3) AS sequence,
  CASE p_size % 3 WHEN 0 THEN 'probe' WHEN 1 THEN 'forward' ELSE 'reverse' END AS role
FROM {{part}}
"""
_CODE_SQL = "(VALUES " + ", ".join(f"('{c}', '{b}')" for c, b in seq.CODES.items()) + ") AS codes(c, b)"
_MASK_LIST = "MAP {" + ", ".join(f"'{c}': {m}" for c, m in seq.MASKS.items()) + "}"
_MASK = lambda x: f"({_MASK_LIST})[{x}]"


register(
    "seq_revcomp",
    lambda s, d: view(s, d, DEGENERATE).select("k", seq.reverse_complement(F.col("sequence")).alias("revcomp"), seq.is_degenerate(F.col("sequence")).alias("degenerate"), seq.combinations(F.col("sequence")).alias("n")),
    f"""SELECT k, reverse(translate(sequence, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS revcomp, regexp_matches(sequence, '[^ACGT]') AS degenerate,
CAST(list_product(list_transform(regexp_extract_all(sequence, '[^ACGT]'), lambda c: CASE WHEN c = 'N' THEN 4 WHEN c IN ('B', 'D', 'H', 'V') THEN 3 ELSE 2 END)) AS BIGINT) AS n
FROM {duck(DEGENERATE)}""",
)

register(
    "seq_expand",
    lambda s, d: view(s, d, DEGENERATE).select("k", F.posexplode(seq.expand(F.col("sequence"))).alias("pos", "variant")),
    f"""WITH RECURSIVE o AS (SELECT k, sequence FROM {duck(DEGENERATE)}), codes AS (SELECT * FROM {_CODE_SQL}),
e AS (
  SELECT k, sequence AS rest, '' AS variant FROM o
  UNION ALL
  SELECT k, substr(rest, 2), variant || substr(b, i, 1)
  FROM (SELECT k, rest, variant, b, unnest(generate_series(1, length(b))) AS i FROM e JOIN codes ON c = substr(rest, 1, 1) WHERE rest <> '')
)
SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY variant) - 1 AS INTEGER) AS pos, variant FROM e WHERE rest = ''""",
)

register(
    "seq_runs_gc",
    lambda s, d: view(s, d, CONTIGS).select("accession", seq.gc_percent(F.col("seq")).alias("gc"), seq.longest_run(F.col("seq")).alias("run"), seq.longest_run(F.col("seq"), "G").alias("g_run")),
    f"""SELECT accession, 100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) AS gc,
CAST(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))) AS INTEGER) AS run,
CAST(coalesce(list_max(list_transform(regexp_extract_all(seq, 'G+'), lambda x: length(x))), 0) AS INTEGER) AS g_run FROM {duck(CONTIGS)}""",
)

register(
    "gap_stats",
    lambda s, d: view(s, d, CONTIGS).select("accession", seq.sequence_stats(F.col("seq")).alias("x"), seq.n_run_after(F.col("seq"), F.lit(99)).alias("n_after")).select("accession", "x.*", "n_after"),
    f"""SELECT accession, CAST(length(seq) AS BIGINT) AS length, CAST(length(seq) - length(replace(seq, 'N', '')) AS BIGINT) AS n_count,
CAST(len(regexp_extract_all(seq, 'N{{10,}}')) AS BIGINT) AS gaps, CAST(length(regexp_extract(substr(seq, 100), '^(N*)', 1)) AS INTEGER) AS n_after FROM {duck(CONTIGS)}""",
)

register(
    "iupac_hamming",
    lambda s, d: view(s, d, DEGENERATE).select("k", seq.count_mismatches(F.col("sequence"), F.lit("ACGTNRYACGTACGTACGTNN")).alias("mismatches"), F.size(seq.find_invalid(F.concat(F.col("sequence"), F.lit("XU")))).alias("invalid")),
    f"""SELECT k, CAST(len(list_filter(generate_series(1, 21), lambda i: ({_MASK('substr(sequence, i, 1)')} & {_MASK("substr('ACGTNRYACGTACGTACGTNN', i, 1)")}) = 0)) AS INTEGER) AS mismatches, 2 AS invalid
FROM {duck(DEGENERATE)}""",
)

_ALIGNED = f"SELECT CAST(p_partkey AS BIGINT) AS k, substr({dna('p_partkey')}, 1, 20) AS q, substr({dna('p_partkey + 1')}, 1, 9) || '-' || substr({dna('p_partkey')}, 11, 9) || 'N' AS s FROM {{part}}"
_CH = lambda x: f"substr({x}, i, 1)"
register(
    "alignment_strings",
    lambda s, d: view(s, d, _ALIGNED).select("k", seq.midline(F.col("q"), F.col("s")).alias("midline"), seq.site_string(F.col("q"), F.col("s")).alias("site")),
    f"""SELECT k, array_to_string(list_transform(generate_series(1, 20), lambda i: CASE WHEN {_CH('q')} = {_CH('s')} THEN '|' WHEN {_CH('s')} = 'N' THEN ':' ELSE ' ' END), '') AS midline,
array_to_string(list_transform(generate_series(1, 20), lambda i: CASE WHEN {_CH('s')} = '-' THEN '-' WHEN {_CH('q')} = {_CH('s')} OR {_CH('s')} = 'N' THEN '.' ELSE {_CH('s')} END), '') AS site
FROM {duck(_ALIGNED)}""",
)

_LABELS = "SELECT CAST(p_partkey AS BIGINT) AS k, lower(replace(p_type, ' ', '_')) || CASE WHEN p_size % 2 = 0 THEN '_v' || CAST(p_size AS {STR}) ELSE '' END AS label, substr('NM_NC_XRZNG_AB', CAST(1 + p_partkey % 10 AS INT), 3) || CAST(p_partkey AS {STR}) AS accession, p_type || CASE WHEN p_size % 3 = 0 THEN ' mRNA, complete' WHEN p_size % 3 = 1 THEN ' Plasmid genome' ELSE ' record (Scaffold)' END AS title, 'zen; mgb,' || lower(p_brand) || ',MGB' AS mods FROM {part}"
register(
    "label_functions",
    lambda s, d: view(s, d, _LABELS).select(
        "k", seq.oligo_of(F.col("label")).alias("oligo"), seq.slug(F.col("title")).alias("slug"), seq.record_type(F.col("accession"), F.col("title")).alias("record_type"), seq.is_plasmid(F.col("title")).alias("plasmid"),
        seq.level_of_title(F.col("title")).alias("level"), F.array_join(seq.modification_list(F.col("mods")), "|").alias("mods"), seq.has_mgb(seq.modification_list(F.col("mods")), F.lit("FAM"), F.lit(None).cast("string")).alias("mgb"),
        seq.redact(F.concat(F.lit("https://u:p@x.org?api_key="), F.col("label"))).alias("message"), seq.record_url(F.col("accession")).alias("url"),
    ),
    f"""SELECT k, regexp_replace(label, '_v[0-9]+$', '') AS oligo, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
CASE WHEN regexp_matches(accession, '^(NM|NR|XM|XR)_') THEN 'transcript' WHEN regexp_matches(accession, '^(NC|NG|NT|NW|NZ|AC)_') THEN 'genomic'
  WHEN title LIKE '%mRNA%' THEN 'transcript' WHEN title LIKE '%genome%' OR title LIKE '%(Scaffold)' THEN 'genomic' ELSE 'other' END AS record_type,
title LIKE '%Plasmid%' AS plasmid, CASE WHEN title LIKE '%(Scaffold)' THEN 'Scaffold' ELSE '' END AS level,
'ZEN|MGB|' || upper(regexp_extract(mods, 'mgb,(.*),MGB', 1)) AS mods, true AS mgb, 'https://***@x.org?api_key=***' AS message, 'https://www.ncbi.nlm.nih.gov/nuccore/' || accession AS url
FROM {duck(_LABELS)}""",
)

_DATES = "SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderdate AS ts, CASE o_orderkey % 6 WHEN 0 THEN CAST(year(o_orderdate) AS {STR}) WHEN 1 THEN 'Mar-' || CAST(year(o_orderdate) AS {STR}) WHEN 2 THEN '2019-04/2020-01' WHEN 3 THEN 'missing' WHEN 4 THEN '12345-1899' ELSE NULL END AS raw FROM {orders}"
register(
    "collection_year",
    lambda s, d: view(s, d, _DATES).select("k", seq.collection_year(F.col("raw"), F.lit(1997)).alias("year")),
    f"""SELECT k, CASE WHEN y <= 1997 THEN y END AS year FROM (SELECT k, TRY_CAST(nullif(regexp_extract(raw, '(^|[^0-9])(1[89][0-9]{{2}}|20[0-9]{{2}})([^0-9]|$)', 2), '') AS INTEGER) AS y FROM {duck(_DATES)})""",
)

_table = lambda t: "MAP {" + ", ".join(f"'{k}': CAST({v} AS DOUBLE)" for k, v in t.items()) + "}"
_fold = lambda t: f"list_sum(list_transform(generate_series(1, 19), lambda i: ({_table(t)})[substr(o, i, 2)]))"
register(
    "tm_nn",
    lambda s, d: view(s, d, PARTS).select("k", F.substring("d", 1, 20).alias("o")).select("k", F.round(thermo.nn_dg37(F.col("o")), 6).alias("dg"), F.round(thermo.melting_temp(F.col("o")), 6).alias("tm")),
    f"""WITH o AS (SELECT k, substr(d, 1, 20) AS o FROM {duck(PARTS)}), x AS (
SELECT k, o, {_fold(thermo.DG)} AS dg, reverse(translate(o, 'ACGT', 'TGCA')) = o AS own,
  {_fold(thermo.DH)} + CASE WHEN substr(o, 1, 1) IN ('A', 'T') THEN 2.3 ELSE 0.1 END + CASE WHEN substr(o, 20, 1) IN ('A', 'T') THEN 2.3 ELSE 0.1 END AS dh,
  {_fold(thermo.DS)} + CASE WHEN substr(o, 1, 1) IN ('A', 'T') THEN 4.1 ELSE -2.8 END + CASE WHEN substr(o, 20, 1) IN ('A', 'T') THEN 4.1 ELSE -2.8 END AS ds FROM o)
SELECT k, round(dg, 6) AS dg, round(1000.0 * dh / (ds + CASE WHEN own THEN -1.4 ELSE 0 END + 0.368 * 19 * ln((50 + 120.0 * sqrt(3.0 - 0.8)) / 1000.0) + 1.987 * ln(CASE WHEN own THEN 400.0 / 1e9 ELSE 400.0 / 4e9 END)) - 273.15, 6) AS tm FROM x""",
)

_OLIGO_ROWS = f"SELECT CAST(k AS {{STR}}) AS oligo, role, sequence FROM ({DEGENERATE}) t"


def _checks(s, d):
    checks = oligo_qc.worst_checks(oligo_qc.variant_checks(view(s, d, _OLIGO_ROWS, spread=True)))
    return checks.withColumns({c: F.round(c, 6) for c in ("low", "high", "worst_value")})


_sum = lambda t, x: f"list_sum(list_transform(generate_series(1, length({x}) - 1), lambda i: ({_table(t)})[substr({x}, i, 2)]))"
#: CTEs t, h and m: the melting temperature of every variant in e.
_TM = f"""t AS (SELECT *, reverse(translate(v, 'ACGT', 'TGCA')) = v AS own, CASE WHEN role = 'probe' THEN 200.0 ELSE 400.0 END AS nm FROM e WHERE rest = ''), h AS (
SELECT *, {_sum(thermo.DH, "v")} + CASE WHEN left(v, 1) IN ('A', 'T') THEN 2.3 ELSE 0.1 END + CASE WHEN right(v, 1) IN ('A', 'T') THEN 2.3 ELSE 0.1 END AS dh,
  {_sum(thermo.DS, "v")} + CASE WHEN left(v, 1) IN ('A', 'T') THEN 4.1 ELSE -2.8 END + CASE WHEN right(v, 1) IN ('A', 'T') THEN 4.1 ELSE -2.8 END AS ds FROM t), m AS (
SELECT oligo, role, 1000.0 * dh / (ds + CASE WHEN own THEN -1.4 ELSE 0 END + 0.368 * (length(v) - 1) * ln((50 + 120.0 * sqrt(3.0 - 0.8)) / 1000.0) + 1.987 * ln(CASE WHEN own THEN nm / 1e9 ELSE nm / 4e9 END)) - 273.15 AS tm FROM h)"""

_QC_SQL = f"""WITH RECURSIVE o AS (SELECT CAST(k AS VARCHAR) AS oligo, role, sequence FROM {duck(DEGENERATE)}), codes AS (SELECT * FROM {_CODE_SQL}),
e AS (
  SELECT oligo, role, sequence AS rest, '' AS v FROM o
  UNION ALL
  SELECT oligo, role, substr(rest, 2), v || substr(b, i, 1)
  FROM (SELECT oligo, role, rest, v, b, unnest(generate_series(1, length(b))) AS i FROM e JOIN codes ON c = substr(rest, 1, 1) WHERE rest <> '')
), {_TM}, c AS (
  SELECT oligo, role, unnest(['length', 'gc', 'run', 'g_run']) AS "check",
    unnest([CAST(length(v) AS DOUBLE), 100.0 * length(regexp_replace(v, '[^GC]', '', 'g')) / length(v),
      CAST(list_max(list_transform(regexp_extract_all(v, 'A+|C+|G+|T+'), lambda x: length(x))) AS DOUBLE),
      CAST(coalesce(list_max(list_transform(regexp_extract_all(v, 'G+'), lambda x: length(x))), 0) AS DOUBLE)]) AS value
  FROM e WHERE rest = ''
  UNION ALL SELECT oligo, role, 'tm', tm FROM m
), s AS (
  SELECT *, CASE "check"
    WHEN 'length' THEN CASE WHEN role = 'probe' THEN CASE WHEN value BETWEEN 15 AND 30 THEN 2 WHEN value BETWEEN 12 AND 40 THEN 3 ELSE 4 END
                            ELSE CASE WHEN value BETWEEN 18 AND 30 THEN 2 WHEN value BETWEEN 15 AND 40 THEN 3 ELSE 4 END END
    WHEN 'gc' THEN CASE WHEN role = 'probe' THEN CASE WHEN value BETWEEN 30 AND 80 THEN 2 WHEN value BETWEEN 20 AND 90 THEN 3 ELSE 4 END
                        ELSE CASE WHEN value BETWEEN 40 AND 60 THEN 2 WHEN value BETWEEN 30 AND 70 THEN 3 ELSE 4 END END
    WHEN 'tm' THEN CASE WHEN role = 'probe' THEN 1 WHEN value BETWEEN 58 AND 66 THEN 2 WHEN value BETWEEN 54 AND 70 THEN 3 ELSE 4 END
    WHEN 'run' THEN CASE WHEN value >= 7 THEN 4 WHEN value >= 5 THEN 3 ELSE 2 END
    ELSE CASE WHEN value >= 6 THEN 4 WHEN value >= 4 THEN 3 ELSE 2 END END AS r,
    round(abs(value - (min(value) OVER (PARTITION BY oligo, "check") + max(value) OVER (PARTITION BY oligo, "check")) / 2), 6) AS far
  FROM c
), w AS (
  SELECT oligo, role, "check", ['INFO', 'PASS', 'WARN', 'FAIL'][max(r)] AS status, round(min(value), 6) AS low, round(max(value), 6) AS high,
    round(arg_max(value, row(r, far, value)), 6) AS worst_value, count(*) AS n_variants
  FROM s GROUP BY ALL
)"""
register("qc_bands", lambda s, d: _checks(s, d), f"{_QC_SQL} SELECT * FROM w")
register(
    "qc_overall",
    lambda s, d: oligo_qc.overall(_checks(s, d)),
    f"{_QC_SQL} SELECT ['INFO', 'PASS', 'WARN', 'FAIL'][max(list_position(['INFO', 'PASS', 'WARN', 'FAIL'], status))] AS status, count(*) AS n_checks FROM w",
)
#: Eight oligos an assay, over all parts.
_EIGHTS = f"SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS assay, CAST(p_partkey AS BIGINT) AS pos, CAST(p_partkey AS {{STR}}) AS oligo, substr({dna('p_partkey')}, 1, 20) AS sequence FROM {{part}}"
register(
    "qc_pairs",
    lambda s, d: oligo_qc.oligo_pairs(view(s, d, _EIGHTS)).select("assay", "oligo_a", "oligo_b", seq.count_mismatches(F.col("sequence_a"), F.col("sequence_b")).alias("mismatches")),
    f"WITH o AS (SELECT * FROM {duck(_EIGHTS)}) SELECT a.assay, a.oligo AS oligo_a, b.oligo AS oligo_b, CAST(hamming(a.sequence, b.sequence) AS INTEGER) AS mismatches FROM o a JOIN o b ON a.assay = b.assay AND a.pos < b.pos",
)


def _by_position(s, d):
    k = F.col("oligo").cast("long")
    return _checks(s, d).withColumns({"assay": F.floor(k / 8), "oligo": (k % 8).cast("string")})


register(
    "qc_pivot",
    lambda s, d: oligo_qc.matrix(_by_position(s, d), [str(i) for i in range(8)], ("assay", "check")),
    f"""{_QC_SQL} SELECT CAST(floor(CAST(oligo AS BIGINT) / 8) AS BIGINT) AS assay, "check", {", ".join(f"max(status) FILTER (CAST(oligo AS BIGINT) % 8 = {i}) AS \"{i}\"" for i in range(8))} FROM w GROUP BY 1, 2""",
)


def _windows(names: tuple[str, ...], most: int) -> str:
    """DuckDB CTEs ``sites``: every window of every contig with few mismatches."""
    rows = []
    for name, o in OLIGOS:
        if name in names:
            rc = o.translate(str.maketrans("ACGT", "TGCA"))[::-1]
            for strand, x in (("+", o), ("-", rc)):
                w = f"substr(seq, i, {len(o)})"
                site = w if strand == "+" else f"reverse(translate({w}, 'ACGTN', 'TGCAN'))"
                rows.append(f"SELECT accession, '{name}' AS oligo, '{strand}' AS strand, CAST(i - 1 AS INTEGER) AS start, CAST(hamming({w}, '{x}') AS INTEGER) AS mismatches, {site} AS site FROM (SELECT accession, seq, unnest(generate_series(1, length(seq) - {len(o) - 1})) AS i FROM g) WHERE hamming({w}, '{x}') <= {most}")
    return f"g AS (SELECT * FROM {duck(CONTIGS)}), sites AS ({' UNION ALL '.join(rows)})"


SITES_SQL = _windows(("forward", "probe", "reverse"), 5)
BEST_SQL = f"""{SITES_SQL}, best AS (
  SELECT accession, oligo, strand, start, mismatches, site
  FROM (SELECT *, row_number() OVER (PARTITION BY accession, oligo ORDER BY mismatches, strand, start) AS r FROM sites) WHERE r = 1
)"""


def best(s, d):
    return oligo_qc.best_sites(oligo_qc.find_sites(view(s, d, CONTIGS), OLIGOS, 5))


register("find_sites", lambda s, d: oligo_qc.find_sites(view(s, d, CONTIGS), OLIGOS, 5), f"WITH {SITES_SQL} SELECT * FROM sites")
register("best_copy", best, f"WITH {BEST_SQL} SELECT * FROM best")
register(
    "amplicon_geometry",
    lambda s, d: oligo_qc.geometry(best(s, d)),
    f"""WITH {BEST_SQL}, e AS (SELECT *, start + length(site) AS stop FROM best),
p AS (SELECT f.accession, f.strand AS fs, r.strand AS rs, least(f.start, r.start) AS l, greatest(f.stop, r.stop) AS r, p.start AS ps, p.stop AS pe
  FROM e f JOIN e r ON f.accession = r.accession AND f.oligo = 'forward' AND r.oligo = 'reverse' LEFT JOIN e p ON p.accession = f.accession AND p.oligo = 'probe')
SELECT accession, CAST(r - l AS INTEGER) AS product_length, coalesce(ps >= l AND pe <= r, false) AS probe_inside, CASE WHEN fs = rs THEN 'FAIL' ELSE 'PASS' END AS orientation FROM p""",
)
