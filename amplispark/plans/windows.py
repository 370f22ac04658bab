"""Queries over windows, flanks and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.operators import locate, specificity, taxonomy, windows
from amplispark.plans.catalogue import register
from amplispark.plans.search import _ALL_PAIRS, _LEVEL, CLOSURE
from amplispark.plans.synthetic import CONTIGS, FORWARD, FRAGMENT, HSPS, REVERSE, SITES, TAXA, dealt, duck, view

_S = duck(SITES)
_SPANS = "SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS INT) AS n, CAST(1 + l_partkey % 90 AS INT) AS a, CAST(1 + l_partkey % 90 + l_suppkey % 20 AS INT) AS b, CAST(l_quantity AS INT) % 4 AS u5, CAST(l_suppkey % 5 AS INT) AS u3, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand FROM {lineitem}"


def _fetch(s, d):
    f = view(s, d, _SPANS).select("k", "n", windows.footprint(F.col("a"), F.col("b"), F.col("u5"), F.col("u3"), F.col("strand")).alias("f"))
    return f.select("k", "n", "f.lo", "f.hi", windows.window_of(F.col("f.lo"), F.col("f.hi"), F.lit(100)).alias("w")).select("k", "n", "lo", "hi", "w.start", "w.stop")


register(
    "site_windows",
    _fetch,
    f"""WITH f AS (SELECT k, n, a - CASE WHEN strand = '+' THEN u5 ELSE u3 END AS lo, b + CASE WHEN strand = '+' THEN u3 ELSE u5 END AS hi FROM {duck(_SPANS)})
SELECT k, n, lo, hi, greatest(lo - 10, 1) AS start, least(hi + 10, 100) AS stop FROM f""",
)
register(
    "worst_case_sites",
    lambda s, d: view(s, d, _SPANS).select("k", "n", windows.worst_case(F.lit("ACGTNACGT"), windows.off_target_site(F.lit("ACNT")), F.col("u5"), F.col("u3")).alias("w")).select("k", "n", "w.q_aln", "w.s_aln"),
    f"SELECT k, n, 'ACGTNACGT' AS q_aln, repeat('.', u5) || 'AC.T' || repeat('.', u3) AS s_aln FROM {duck(_SPANS)}",
)
_SEARCHES = "SELECT CASE s_suppkey % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'background' ELSE 'other' END AS tier, CAST(s_nationkey AS BIGINT) AS t1, CAST(s_suppkey % 7 AS BIGINT) AS t2 FROM {supplier}"
register(
    "searched_taxa",
    lambda s, d: windows.searched_taxa(view(s, d, _SEARCHES).withColumn("taxa", F.array("t1", "t2"))),
    f"WITH x AS (SELECT tier, t1 AS t FROM {duck(_SEARCHES)} UNION SELECT tier, t2 FROM {duck(_SEARCHES)}) SELECT tier, (SELECT count(*) FROM {duck(_SEARCHES)} y WHERE y.tier = x.tier) AS searches, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS taxa FROM x GROUP BY 1",
)
register(
    "any_saturated",
    lambda s, d: windows.any_saturated(specificity.saturation(view(s, d, HSPS), 50), "near"),
    f"WITH b AS (SELECT tier, query, hit, max(identity) AS best FROM {duck(HSPS)} WHERE tier <> 'near' GROUP BY 1, 2, 3), g AS (SELECT count(*) >= 50 AND min(best) >= 14 AS s FROM b GROUP BY tier, query) SELECT bool_or(s) AS saturated FROM g",
)
register(
    "gapped_probes",
    lambda s, d: windows.gapped_probe_binds(view(s, d, SITES).withColumn("level", specificity.level())),
    f"SELECT tier, bool_or(gaps > 0 AND level <> 'minor') AS binds FROM (SELECT *, {_LEVEL} AS level FROM {_S}) WHERE role = 'probe' GROUP BY 1",
)
register("copy_flanks", lambda s, d: windows.flanks(locate.copies(view(s, d, CONTIGS), FRAGMENT, flank=40), 40))
_CUT = lambda x: f"CASE WHEN strpos({x}, '{FORWARD}') > 0 AND strpos(substr({x}, strpos({x}, '{FORWARD}')), '{REVERSE.translate(str.maketrans('ACGT', 'TGCA'))[::-1]}') > 0 THEN substr({x}, strpos({x}, '{FORWARD}'), strpos(substr({x}, strpos({x}, '{FORWARD}')), '{REVERSE.translate(str.maketrans('ACGT', 'TGCA'))[::-1]}') + {len(REVERSE) - 1}) END"
register(
    "cut_fragments",
    lambda s, d: windows.cut_fragment(view(s, d, CONTIGS), FORWARD, REVERSE),
    f"SELECT accession, coalesce({_CUT('seq')}, {_CUT('rc')}) AS fragment FROM (SELECT accession, seq, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc FROM {duck(CONTIGS)})",
)
_PLACED = "SELECT CAST(l_orderkey AS BIGINT) AS accession, CASE l_linenumber % 2 WHEN 0 THEN 'forward' ELSE 'reverse' END AS role, 'o' || CAST(l_partkey AS {STR}) AS oligo, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand, CAST(floor(l_extendedprice) AS BIGINT) AS start, CAST(floor(l_extendedprice) AS BIGINT) + 20 AS \"end\" FROM {lineitem}"
register(
    "oligo_windows",
    lambda s, d: windows.oligo_windows(view(s, d, _PLACED.replace('"end"', "end"))),
    f"""WITH p AS (SELECT * FROM {duck(_PLACED)}), f AS (SELECT accession, role, arg_min(strand, row(start, oligo)) AS s FROM p GROUP BY 1, 2)
SELECT p.accession, p.role, min(start) AS start, max("end") AS "end", count(*) AS oligos FROM p JOIN f ON f.accession = p.accession AND f.role = p.role AND f.s = p.strand GROUP BY 1, 2""",
)
_COPIES = "SELECT CAST(l_orderkey AS BIGINT) AS accession, CAST(l_partkey AS BIGINT) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) AS copy, CAST(l_quantity AS INT) % 3 AS fails, CAST(l_linenumber % 2 AS INT) AS undetermined, CAST(l_suppkey % 5 AS INT) AS defects, CAST(l_partkey % 6 AS INT) AS clean3 FROM {lineitem}"
register(
    "best_copies",
    lambda s, d: windows.best_copies(view(s, d, _COPIES)),
    f"SELECT accession, copy, fails, undetermined, defects, clean3 FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY fails, undetermined, defects, clean3 DESC, copy) AS n FROM {duck(_COPIES)}) WHERE n = 1",
)
register(
    "deduplicated_copies",
    lambda s, d: windows.deduplicated(dealt(s, d, "lineitem", view(s, d, SITES).select("accession", F.col("orientation").alias("strand"), F.col("s_start").alias("start"), F.col("s_end").alias("end")), "accession", "strand")),
    f"""WITH p AS (SELECT accession, orientation AS strand, s_start AS start, s_end AS "end", count(*) AS k FROM {_S} GROUP BY ALL),
o AS (SELECT *, CASE WHEN start - lag(start) OVER w <= 20 THEN 0 ELSE 1 END AS o FROM p WINDOW w AS (PARTITION BY accession, strand ORDER BY start, "end")),
i AS (SELECT *, sum(o) OVER (PARTITION BY accession, strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM o)
SELECT accession, strand, min(start) AS start, max("end") AS "end", CAST(sum(k) AS BIGINT) AS n FROM i GROUP BY accession, strand, i""",
)
register(
    "lineage_sites",
    lambda s, d: windows.in_lineage(view(s, d, SITES).withColumn("taxid", F.col("taxid") + 1000), taxonomy.ancestors(view(s, d, TAXA)), 12).groupBy("tier", "role").agg(F.count("*").alias("n")),
    f"WITH RECURSIVE {CLOSURE} SELECT tier, role, count(*) AS n FROM {_S} WHERE taxid + 1000 IN (SELECT taxid FROM up WHERE ancestor = 12) GROUP BY 1, 2",
)
register(
    "cut_products",
    lambda s, d: windows.cut_products(specificity.products(view(s, d, SITES), per_tier=None), 500),
    f"""WITH {_ALL_PAIRS}
SELECT tier, count(*) AS products, count(*) FILTER (n > 500) AS cut, count(*) > 500 AS truncated, count(probe_id) FILTER (n > 500) = 0 AS harmless FROM cut LEFT JOIN best USING (left_id, right_id) GROUP BY 1""",
)
_SCANS = "SELECT 't' || CAST(n_nationkey AS {STR}) AS tier, CAST(n_nationkey * 3 AS INT) AS windows, CAST(n_regionkey * 20 AS INT) AS scanned, n_nationkey % 2 = 0 AS bounded FROM {nation}"
register("scan_findings", lambda s, d: windows.scan_findings(view(s, d, _SCANS)), f"SELECT CASE WHEN bounded THEN 'INFO' ELSE 'INCOMPLETE' END AS severity, tier, windows - scanned AS n FROM {duck(_SCANS)} WHERE windows > scanned")
register(
    "checked_parts",
    lambda s, d: windows.checked({"sites": view(s, d, SITES), "taxa": view(s, d, TAXA), "none": view(s, d, SITES).where("site_id < 0")}),
    f"SELECT 'sites' AS part, count(*) AS rows FROM {_S} UNION ALL SELECT 'taxa', count(*) FROM {duck(TAXA)} UNION ALL SELECT 'none', 0",
)
