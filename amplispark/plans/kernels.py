"""Queries over alignment kernels, fragment variants, sources and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from amplispark.functions.session import shared_dir
from amplispark.operators import alignment, inclusivity, oligo_qc, partners
from amplispark.plans.catalogue import register
from amplispark.plans.sequences import BEST_SQL, _windows, best
from amplispark.plans.synthetic import CONTIGS, FORWARD, PROBE, REVERSE, dealt, dna, duck, view
from amplispark.sources import files
from amplispark.streaming import store

_WINDOWS = f"SELECT CAST(p_partkey AS BIGINT) AS k, '{FORWARD}' AS oligo_seq, substr({dna('p_partkey')}, 1, 8) || CASE p_size % 3 WHEN 0 THEN '{FORWARD}' WHEN 1 THEN substr('{FORWARD}', 1, 9) || substr('{FORWARD}', 11) ELSE substr('{FORWARD}', 1, 9) || 'A' || substr('{FORWARD}', 10) END || substr({dna('p_partkey')}, 9, 8) AS window FROM {{part}}"
register("align_semiglobal", lambda s, d: alignment.semi_global(view(s, d, _WINDOWS, spread=True)).select("k", "q_aln", "s_aln", "s_start", "s_end", "score"))
register(
    "run_length",
    lambda s, d: alignment.run_length(view(s, d, _WINDOWS, spread=True)).select("k", "shift"),
    f"""WITH w AS (SELECT * FROM {duck(_WINDOWS)}),
v AS (SELECT * FROM (VALUES (1, -1), (2, 1), (3, -2), (4, 2), (5, -3), (6, 3)) AS t(o, shift), (SELECT unnest([5, 11]) AS pos)),
c AS (SELECT k, o, shift FROM w, v WHERE (pos = 5 AND contains(w."window", 'GA' || repeat('C', 4 + shift) || 'AAAATCAGCGAAAT') AND 4 + shift >= 2) OR (pos = 11 AND contains(w."window", 'GACCCC' || repeat('A', 4 + shift) || 'TCAGCGAAAT') AND 4 + shift >= 2))
SELECT w.k, CAST(arg_min(shift, o) AS INTEGER) AS shift FROM w LEFT JOIN c USING (k) GROUP BY 1""",
)
_ALN = f"SELECT CAST(p_partkey AS BIGINT) AS k, substr({dna('p_partkey')}, 1, 20) AS q, substr({dna('p_partkey')}, 1, CAST(5 + p_partkey % 9 AS INT)) || substr({dna('p_partkey + 3')}, 1, CAST(15 - p_partkey % 9 AS INT)) AS s FROM {{part}}"
register(
    "alignment_measures",
    lambda s, d: view(s, d, _ALN).select("k", alignment.measure(F.col("q"), F.col("s")).alias("m")).select("k", "m.*"),
    f"""WITH a AS (SELECT k, list_transform(generate_series(1, 20), lambda i: substr(q, i, 1) = substr(s, i, 1)) AS m FROM {duck(_ALN)})
SELECT k, CAST(len(list_filter(m, lambda x: x)) AS INTEGER) AS matches, CAST(len(list_filter(m, lambda x: NOT x)) AS INTEGER) AS mismatches, 0 AS gaps,
CAST(20 - coalesce(list_max(list_filter(generate_series(1, 20), lambda i: NOT m[i])), 0) AS INTEGER) AS clean3 FROM a""",
)
_PAIR_ROWS = f"SELECT CAST(p_partkey AS BIGINT) AS k, substr({dna('p_partkey')}, 1, 20) AS seq_a, substr({dna('p_partkey % 10')}, 1, 20) AS seq_b FROM {{part}}"
register("pair_structures", lambda s, d: alignment.pair_structures(view(s, d, _PAIR_ROWS, spread=True)).select("k", F.round("tm", 3).alias("tm"), F.round("dg", 3).alias("dg")))


def _anchors(s, d):
    """What a search reports here: the sites of both primers without a mismatch."""
    sites = oligo_qc.find_sites(view(s, d, CONTIGS), (("forward", FORWARD), ("reverse", REVERSE)), 0)
    return sites.select(
        F.lit("near").alias("tier"), "accession", F.concat_ws(":", "accession", "oligo", "start").alias("site_id"), F.col("oligo").alias("role"), "oligo", F.col("strand").alias("orientation"),
        (F.col("start") + 1).alias("s_start"), (F.col("start") + F.length("site")).alias("s_end"), F.lit("critical").alias("level"),
    )


def _scan(s, d):
    anchors = _anchors(s, d)
    oligos = s.createDataFrame([("forward", "forward", FORWARD), ("reverse", "reverse", REVERSE)], "oligo string, role string, oligo_seq string")
    anchors, contigs = (dealt(s, d, "orders", x, "accession") for x in (anchors, view(s, d, CONTIGS)))
    return partners.partner_scan(anchors, contigs, oligos, anchors).select("accession", "oligo", "orientation", "anchor_id", "s_start", "s_end", "mismatches", "gaps", "clean3", "level")


# In these contigs a partner differs from its oligo by substitutions only, so that its best alignment has no gap.
_CLEAN = lambda o: f"CAST(length(regexp_extract(list_aggregate(list_transform(generate_series(1, {len(o)}), lambda i: CASE WHEN substr(site, i, 1) = substr('{o}', i, 1) THEN 'm' ELSE 'x' END), 'string_agg', ''), 'm*$')) AS INTEGER)"
register(
    "partner_scan",
    _scan,
    f"""WITH {_windows(("forward", "reverse"), 5)}, x AS (
  SELECT accession, oligo, strand AS orientation, start + 1 AS s_start, start + length(site) AS s_end, mismatches, CASE oligo WHEN 'forward' THEN {_CLEAN(FORWARD)} ELSE {_CLEAN(REVERSE)} END AS clean3 FROM sites
), l AS (SELECT *, CASE WHEN mismatches <= 3 AND clean3 >= 5 THEN 'critical' WHEN clean3 >= 3 THEN 'warning' ELSE 'minor' END AS level FROM x),
p AS (
  SELECT b.*, a.accession || ':' || a.oligo || ':' || (a.s_start - 1) AS anchor_id, row_number() OVER (PARTITION BY a.accession, a.oligo, a.s_start, b.oligo ORDER BY b.mismatches, b.clean3 DESC) AS r
  FROM l a JOIN l b ON a.accession = b.accession AND a.mismatches = 0 AND a.oligo <> b.oligo AND a.orientation <> b.orientation
   AND CASE a.orientation WHEN '+' THEN a.s_start < b.s_start AND a.s_end < b.s_end AND b.s_end <= a.s_start + 1999 ELSE b.s_start < a.s_start AND b.s_end < a.s_end AND b.s_start >= a.s_end - 1999 END
), n AS (SELECT * FROM p WHERE r = 1 AND level <> 'minor' AND mismatches > 0)
SELECT accession, oligo, orientation, min(anchor_id) AS anchor_id, s_start, s_end, mismatches, 0 AS gaps, clean3, level FROM n GROUP BY ALL""",
)


register(
    "fragment_variants",
    lambda s, d: inclusivity.fragment_variants(best(s, d), view(s, d, CONTIGS)),
    f"""WITH {BEST_SQL}, w AS (SELECT accession, max(site) FILTER (oligo = 'forward') AS forward, max(site) FILTER (oligo = 'probe') AS probe, max(site) FILTER (oligo = 'reverse') AS reverse FROM best WHERE NOT contains(site, 'N') GROUP BY 1),
e AS (SELECT forward, probe, reverse, level, taxid, count(*) AS n, min(release_year) AS a, max(release_year) AS b FROM w JOIN g USING (accession) WHERE forward IS NOT NULL AND probe IS NOT NULL AND reverse IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
l AS (SELECT forward, probe, reverse, level, sum(n) AS n FROM e GROUP BY 1, 2, 3, 4), o AS (SELECT forward, probe, reverse, taxid, sum(n) AS n, row_number() OVER (PARTITION BY forward, probe, reverse ORDER BY sum(n) DESC, taxid) AS r FROM e GROUP BY 1, 2, 3, 4)
SELECT forward, probe, reverse, CAST(sum(n) AS BIGINT) AS n, (SELECT arg_max(level, row(n, level)) FROM l WHERE l.forward = e.forward AND l.probe = e.probe AND l.reverse = e.reverse) AS level, min(a) AS first_year, max(b) AS last_year,
  count(DISTINCT taxid) AS organisms, (SELECT string_agg(taxid || '=' || CAST(n AS BIGINT), ',' ORDER BY r) FROM o WHERE o.forward = e.forward AND o.probe = e.probe AND o.reverse = e.reverse AND r <= 3) AS most FROM e GROUP BY forward, probe, reverse""",
)
_FASTA = "SELECT 'db|E' || CAST(s_suppkey AS {STR}) || '|A some title' || chr(10) || 'acgt' || chr(10) || 'NNA' || chr(10) AS value FROM {supplier}"
register(
    "fasta_parse",
    lambda s, d: files.parse_fasta(view(s, d, _FASTA)),
    "SELECT unnest(['db|E' || s_suppkey || '|A', 'E' || s_suppkey || '_A']) AS contig, 'some title' AS description, 'ACGTNNA' AS seq FROM supplier",
)
_DOCSUM = "SELECT CAST(p_partkey AS BIGINT) AS k, CASE WHEN p_size % 4 = 0 THEN 'n/a' ELSE '2020/0' || CAST(1 + p_size % 9 AS {STR}) || '/11 00:00' END AS created, 'strain|collection_date|host' AS names, CASE WHEN p_size % 3 = 0 THEN 'x|2019' ELSE p_brand || '|20' || CAST(10 + p_size AS {STR}) || '|man' END AS vals FROM {part}"
register(
    "docsum_fields",
    lambda s, d: view(s, d, _DOCSUM).select("k", files.record_date(F.col("created")).cast("string").alias("created"), files.paired_value(F.col("names"), F.col("vals"), "collection_date").alias("collected")),
    f"SELECT k, CASE WHEN created LIKE '2020%' THEN replace(left(created, 10), '/', '-') END AS created, CASE WHEN vals <> 'x|2019' THEN string_split(vals, '|')[2] END AS collected FROM {duck(_DOCSUM)}",
)
_STORE = "SELECT 'k' || CAST(l_linenumber % 2 AS {STR}) AS key, 'A' || CAST(l_suppkey AS {STR}) AS accession, CAST(l_orderkey AS BIGINT) * 10000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) AS seq_no, l_quantity > 20 AS ok, CAST(l_quantity AS INT) AS payload FROM {lineitem}"
register(
    "store_current",
    lambda s, d: store.current(view(s, d, _STORE)).select("key", "accession", "payload"),
    f"SELECT key, accession, payload FROM (SELECT *, row_number() OVER (PARTITION BY key, accession ORDER BY seq_no DESC) AS n FROM {duck(_STORE)}) WHERE n = 1",
)
register(
    "store_failures",
    lambda s, d: store.with_failures(view(s, d, _STORE)),
    f"""WITH s AS (SELECT * FROM {duck(_STORE)}), l AS (SELECT *, max(seq_no) FILTER (ok) OVER (PARTITION BY key, accession) AS ok_at FROM s),
f AS (SELECT key, accession, count(*) FILTER (NOT ok AND (ok_at IS NULL OR seq_no > ok_at)) AS failures FROM l GROUP BY 1, 2)
SELECT key, accession, CASE WHEN failures >= 2 THEN 'unavailable' WHEN failures > 0 THEN 'failed' ELSE 'done' END AS state, failures FROM f""",
)


def _incremental(s, d):
    """Orders as a stream into an empty store, read back."""
    at = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    schema = s.read.parquet(f"{d}/orders.parquet").schema
    source = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/orders.parquet*")
    rows = source.select(store.store_key(F.lit(1), F.lit("refs")).alias("key"), F.concat(F.lit("A"), F.pmod("o_custkey", F.lit(500)).cast("string")).alias("accession"), F.to_date("o_orderdate").alias("release_date"))
    store.collect(rows, f"{at}/table", f"{at}/checkpoint")
    return s.read.parquet(f"{at}/table").groupBy("key").agg(F.count("*").alias("genomes"), F.countDistinct("accession").alias("distinct_genomes"))


register("incremental_store", _incremental, "SELECT sha256('{\"col1\":1,\"col2\":\"refs\"}') AS key, count(DISTINCT o_custkey % 500) AS genomes, count(DISTINCT o_custkey % 500) AS distinct_genomes FROM orders")
