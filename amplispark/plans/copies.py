"""Queries over copies, assessments, verdicts and runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from amplispark.operators import assess, locate, specificity
from amplispark.plans.catalogue import register
from amplispark.plans.search import _LEVEL
from amplispark.plans.sequences import BEST_SQL, best
from amplispark.plans.synthetic import CONTIGS, FRAGMENT, OLIGOS, SITES, dealt, duck, view

_SEEDS = "(VALUES " + ", ".join(f"({p}, '{k}')" for p, k in locate.seeds(FRAGMENT)) + ") AS seeds(place, kmer)"
_HITS_SQL = f"""g AS (SELECT accession, '+' AS strand, seq AS s FROM {duck(CONTIGS)} UNION ALL SELECT accession, '-', reverse(translate(seq, 'ACGTN', 'TGCAN')) FROM {duck(CONTIGS)}),
k AS (SELECT accession, strand, i - 1 AS start, substr(s, i, 16) AS kmer FROM (SELECT *, unnest(generate_series(1, length(s) - 15)) AS i FROM g)),
hits AS (SELECT accession, strand, CAST(place AS INTEGER) AS place, CAST(start AS INTEGER) AS start FROM (SELECT *, count(*) OVER (PARTITION BY accession, strand, place) AS n FROM k JOIN {_SEEDS} USING (kmer)) WHERE n <= 50)"""
register("seed_hits", lambda s, d: locate.seed_hits(view(s, d, CONTIGS), FRAGMENT), f"WITH {_HITS_SQL} SELECT * FROM hits")
_BLOCKS_SQL = f"""{_HITS_SQL}, a AS (SELECT *, max(place + 16) OVER (PARTITION BY accession, strand, start - place ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR place > before THEN 1 ELSE 0 END) OVER (PARTITION BY accession, strand, start - place ORDER BY place) AS block FROM a),
blocks AS (SELECT accession, strand, min(place) AS place, min(start) AS start, CAST(max(place) + 16 - min(place) AS INTEGER) AS length FROM b GROUP BY accession, strand, start - place, block)"""
register("exact_blocks", lambda s, d: locate.seed_blocks(view(s, d, CONTIGS), FRAGMENT).drop("contig", "size"), f"WITH {_BLOCKS_SQL} SELECT * FROM blocks")
# In these contigs the fragment lies at place 64 of its strand (35 bases before the start where the contig is cut), without gaps: what is anchored are its exact blocks.
_CHAIN_SQL = f"""{_BLOCKS_SQL}, o AS (SELECT accession, strand, CAST(sum(length) AS INTEGER) AS anchored FROM blocks GROUP BY 1, 2),
c AS (SELECT k, accession, CASE WHEN k % 5 = 0 THEN '-' ELSE '+' END AS strand, CASE WHEN k % 13 = 0 THEN -35 ELSE 64 END AS start FROM {duck(CONTIGS)} WHERE k % 3 <> 2)"""
register("chain_copies", lambda s, d: locate.copies(view(s, d, CONTIGS), FRAGMENT).select("accession", "strand", "start", "end", "anchored", "identity", "cut", "context_left", "context_right", "kind"))
# The same without the identity: an alignment with gaps may count one base more than the places compared one by one.
register(
    "chain_places",
    lambda s, d: locate.copies(view(s, d, CONTIGS), FRAGMENT).select("accession", "strand", "start", "end", "anchored", "cut", "context_left", "context_right", "kind"),
    f"""WITH {_CHAIN_SQL} SELECT accession, strand, CAST(start AS INTEGER) AS start, CAST(start + 128 AS INTEGER) AS "end", anchored, start < 0 AS cut, 0 AS context_left, 0 AS context_right, 'exact' AS kind FROM c JOIN o USING (accession, strand)""",
)


def _routed(s, d):
    """Contigs that are cut are short and scanned whole; of the others the blocks of seeds are the hits of a search, those of short ones are leaks."""
    contigs = view(s, d, CONTIGS)
    lo = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("size") - F.col("start") - F.col("length"))
    hits = locate.seed_blocks(contigs, FRAGMENT).select("accession", F.col("accession").alias("contig"), (lo + 1).alias("hit_from"), (lo + F.col("length")).alias("hit_to"))
    contigs, hits = (dealt(s, d, "orders", x, "accession", "contig") for x in (contigs.withColumn("contig", F.col("accession")), hits))
    return locate.partitioned_copies(contigs, hits, [locate.Reference(FRAGMENT)], 200).select("accession", "strand", "start", "end", "anchored", "found_by")


register(
    "partitioned_copies",
    _routed,
    f"""WITH {_CHAIN_SQL} SELECT accession, strand, CAST(start AS INTEGER) AS start, CAST(start + 128 AS INTEGER) AS "end", anchored, CASE WHEN start < 0 THEN 'direct_scan' ELSE 'search' END AS found_by FROM c JOIN o USING (accession, strand)""",
)


def _with_context(s, d):
    contigs = view(s, d, CONTIGS)
    left, right = locate.context(locate.copies(contigs, FRAGMENT), contigs)
    return locate.copies(contigs, FRAGMENT, left=left, right=right)


register(
    "copy_states",
    lambda s, d: locate.classify(_with_context(s, d), view(s, d, CONTIGS)).groupBy("state").agg(F.count("*").alias("genomes"), F.sum("copies").alias("copies")),
    f"""SELECT CASE WHEN k % 3 = 2 THEN 'not_found' WHEN k % 13 = 0 THEN 'contig_break' ELSE 'found' END AS state, count(*) AS genomes, CAST(sum(CASE WHEN k % 3 = 2 THEN 0 ELSE 1 END) AS BIGINT) AS copies FROM {duck(CONTIGS)} GROUP BY 1""",
)
_CANDIDATES = "SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS INT) AS n, CAST(l_partkey % 64 AS INT) AS anchored, CAST(l_suppkey % 100 AS INT) / 100.0 AS identity, CAST(l_quantity AS INT) AS ctx_left, CAST(l_partkey % 50 AS INT) AS ctx_right, l_linestatus = 'O' AS touches FROM {lineitem}"
register(
    "copy_rule",
    lambda s, d: view(s, d, _CANDIDATES).select("k", "n", locate.is_copy(F.col("anchored"), F.col("identity"), F.col("ctx_left"), F.col("ctx_right"), F.col("touches")).alias("is_copy")),
    f"SELECT k, n, anchored >= 32 OR ((ctx_left >= 32 OR ctx_right >= 32) AND touches) OR (ctx_left >= 32 AND ctx_right >= 32) OR (identity >= 0.75 AND anchored >= 16) AS is_copy FROM {duck(_CANDIDATES)}",
)
_CALLS = "SELECT CAST(o_orderkey AS BIGINT) AS accession, CASE WHEN o_orderkey % 4 = 0 THEN 'complete' ELSE 'contig' END AS level, CAST(o_custkey % 6 AS INT) AS copies, CAST(o_orderkey % 3 AS INT) AS detectable, o_orderpriority || CAST(o_custkey % 1009 AS {STR}) AS pattern FROM {orders}"
register(
    "unassembled_rule",
    lambda s, d: assess.unassembled(view(s, d, _CALLS)),
    f"""WITH c AS (SELECT * FROM {duck(_CALLS)}), m AS (SELECT median(copies) AS m, count(*) AS n FROM c WHERE level = 'complete')
SELECT accession, copies FROM c, m WHERE level <> 'complete' AND detectable = 0 AND n >= 5 AND m >= 2 AND copies * 2 < m AND pattern NOT IN (SELECT pattern FROM c WHERE level = 'complete' AND detectable = 0)""",
)
_PARTS = "SELECT CAST(l_orderkey AS BIGINT) AS accession, CASE l_linenumber % 3 WHEN 0 THEN 'probe' WHEN 1 THEN 'forward' ELSE 'reverse' END AS oligo, CAST(l_partkey AS BIGINT) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) AS copy, CAST(l_quantity AS INT) % 5 AS mismatches, CAST(l_quantity AS INT) % 5 <= 2 AS ok FROM {lineitem}"
register(
    "from_parts",
    lambda s, d: assess.from_parts(view(s, d, _PARTS), ["forward", "probe", "reverse"]),
    f"WITH b AS (SELECT accession, oligo, arg_min(ok, row(mismatches, copy)) AS ok FROM {duck(_PARTS)} GROUP BY 1, 2) SELECT accession, count(*) = 3 AND bool_and(ok) AS detectable FROM b GROUP BY 1",
)


def _site_positions(s, d):
    q = F.create_map(*[F.lit(x) for kv in OLIGOS for x in kv])
    n = F.length("site")
    at = F.filter(F.sequence(F.lit(1), n), lambda p: F.substring(q[F.col("oligo")], n - p + 1, F.lit(1)) != F.substring("site", n - p + 1, F.lit(1)))
    return best(s, d).join(view(s, d, CONTIGS).select("accession", F.col("release_year").alias("year")), "accession").select("oligo", "year", at.alias("positions"), n.alias("length"))


_POSITIONS_SQL = " UNION ALL ".join(f"SELECT oligo, release_year AS year, {len(o)} AS length, list_filter(generate_series(1, {len(o)}), lambda p: substr('{o}', {len(o)} - p + 1, 1) <> substr(site, {len(o)} - p + 1, 1)) AS pos FROM best JOIN g USING (accession) WHERE oligo = '{n}'" for n, o in OLIGOS)
register(
    "year_stats",
    lambda s, d: assess.year_stats(_site_positions(s, d)),
    f"""WITH {BEST_SQL}, x AS ({_POSITIONS_SQL}), a AS (SELECT oligo, year, max(length) AS length, count(*) FILTER (len(pos) = 0) AS perfect, count(*) FILTER (len(pos) = 1) AS one, count(*) FILTER (len(pos) > 1) AS more, flatten(list(pos)) AS pos FROM x GROUP BY 1, 2)
SELECT oligo, year, perfect, one, more, array_to_string(list_transform(generate_series(1, length), lambda i: len(list_filter(pos, lambda p: p = i))), ',') AS histogram FROM a""",
)
_COLLECTED = "SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year, o_orderkey % 10 <> 3 AS read, CAST(o_custkey % 2 AS INT) AS detectable FROM {orders}"
register(
    "collection_axis",
    lambda s, d: assess.collection_axis(view(s, d, _COLLECTED), 1997),
    f"""WITH b AS (SELECT CASE WHEN NOT read THEN 'not read' WHEN year IS NULL THEN 'undated' WHEN year < 1997 THEN 'earlier' ELSE CAST(year AS VARCHAR) END AS label, detectable FROM {duck(_COLLECTED)})
SELECT label, count(*) AS n, CAST(sum(detectable) AS BIGINT) AS detectable, round(100.0 * sum(detectable) / count(*), 6) AS percent FROM b GROUP BY 1""",
)
_LISTING = "SELECT 'GCA_' || CAST(o_orderkey AS {STR}) AS accession, CAST(year(o_orderdate) AS INT) AS year, o_orderkey % 5 = 0 AS done FROM {orders}"
register(
    "budgeted_listing",
    lambda s, d: assess.budgeted(view(s, d, _LISTING).select("accession", "year"), view(s, d, _LISTING).where("done").select("accession"), 700),
    f"SELECT accession, year FROM (SELECT *, row_number() OVER (ORDER BY year DESC, accession) AS n FROM {duck(_LISTING)} WHERE NOT done) WHERE n <= 700",
)
register(
    "shown_years",
    lambda s, d: assess.shown_years(view(s, d, _LISTING).groupBy("year").agg(F.count("*").alias("listed")), 10, 2003),
    f"SELECT CAST(y AS INTEGER) AS year, coalesce(n, 0) AS listed FROM generate_series(1994, 2003) AS s(y) LEFT JOIN (SELECT year, count(*) AS n FROM {duck(_LISTING)} GROUP BY 1) l ON l.year = y",
)
_CHANNELS = "SELECT CASE l_linenumber % 3 WHEN 0 THEN 'FAM' WHEN 1 THEN 'HEX' ELSE 'CY5' END AS channel, CASE WHEN l_partkey % 50 = 0 AND l_linenumber % 3 = 0 THEN 'nontarget' WHEN l_partkey % 9 = 1 THEN 'out_of_scope' WHEN l_partkey % 9 = 2 THEN 'unknown' ELSE 'target' END AS role, CASE WHEN l_quantity < 3 THEN 'fail' WHEN l_quantity < 5 THEN 'undetermined' ELSE 'ok' END AS state FROM {lineitem}"
register(
    "channel_results",
    lambda s, d: assess.channel_results(view(s, d, _CHANNELS)),
    f"""SELECT channel, count(*) FILTER (role = 'target' AND state = 'ok') AS detected, count(*) FILTER (role = 'target' AND state = 'fail') AS missed, count(*) FILTER (role = 'target' AND state = 'undetermined') AS undetermined,
count(*) FILTER (role = 'nontarget' AND state = 'ok') AS signals, count(*) FILTER (role = 'nontarget' AND state <> 'ok') AS silent, count(*) FILTER (role = 'out_of_scope') AS out_of_scope, count(*) FILTER (role = 'unknown') AS unknown FROM {duck(_CHANNELS)} GROUP BY 1""",
)
register(
    "channel_verdicts",
    lambda s, d: assess.channel_verdicts(assess.channel_results(view(s, d, _CHANNELS))),
    f"""WITH c AS (SELECT channel, count(*) FILTER (role = 'target' AND state = 'ok') AS ok, count(*) FILTER (role = 'target' AND state = 'fail') AS bad, count(*) FILTER (role = 'nontarget' AND state = 'ok') AS signals FROM {duck(_CHANNELS)} GROUP BY 1)
SELECT channel, round(100.0 * ok / (ok + bad), 6) AS percent, CASE WHEN signals > 0 THEN 'FAIL' WHEN ok + bad = 0 THEN 'INCOMPLETE' WHEN 100.0 * ok / (ok + bad) < 80 THEN 'FAIL' WHEN 100.0 * ok / (ok + bad) < 95 THEN 'WARN' ELSE 'PASS' END AS status FROM c""",
)
_SECTIONS = "SELECT CAST(l_orderkey AS BIGINT) AS run, CASE l_linenumber % 3 WHEN 0 THEN 'qc' WHEN 1 THEN 'specificity' ELSE 'inclusivity' END AS section, CASE CAST(l_partkey % 9 AS INT) WHEN 0 THEN 'FAIL' WHEN 1 THEN 'INCOMPLETE' WHEN 2 THEN 'WARN' WHEN 3 THEN 'INFO' ELSE 'PASS' END AS status FROM {lineitem}"
register(
    "combine_verdict",
    lambda s, d: assess.combined_verdict(view(s, d, _SECTIONS), ["qc", "specificity"]),
    f"""WITH r AS (SELECT run, max(CASE status WHEN 'INFO' THEN 1 WHEN 'PASS' THEN 1 WHEN 'WARN' THEN 2 WHEN 'INCOMPLETE' THEN 3 ELSE 4 END) AS r, 2 - count(DISTINCT section) FILTER (section IN ('qc', 'specificity')) AS missing FROM {duck(_SECTIONS)} GROUP BY 1),
x AS (SELECT run, missing, CASE WHEN missing > 0 THEN greatest(r, 3) ELSE r END AS r FROM r)
SELECT run, ['PASS', 'WARN', 'INCOMPLETE', 'FAIL'][r] AS verdict, [0, 10, 30, 20][r] AS code, CAST(missing AS INTEGER) AS missing FROM x""",
)
_LOG = "SELECT CAST(user_id AS BIGINT) AS job, CAST(event_id AS BIGINT) AS line, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS stage, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS {STR}) END AS detail FROM {events}"
register(
    "progress_fold",
    lambda s, d: assess.progress(view(s, d, _LOG)),
    f"SELECT job, line, max(stage) OVER w AS stage, last_value(detail IGNORE NULLS) OVER w AS detail FROM {duck(_LOG)} WINDOW w AS (PARTITION BY job ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
_RUNS = "SELECT CAST(o_custkey AS BIGINT) AS assay, CAST(o_orderkey AS BIGINT) AS run, CAST(o_orderdate AS DATE) AS generated_at, o_orderstatus AS status FROM {orders}"
register(
    "run_index",
    lambda s, d: assess.newest_runs(view(s, d, _RUNS)).select("assay", "run", "status"),
    f"SELECT assay, run, status FROM (SELECT *, row_number() OVER (PARTITION BY assay ORDER BY generated_at DESC, run DESC) AS n FROM {duck(_RUNS)}) WHERE n = 1",
)
_ROWS = "SELECT CAST(p_size % 7 AS INT) AS grp, CAST(p_partkey AS BIGINT) AS k, CAST(floor(p_retailprice) AS BIGINT) AS n, p_partkey % 11 = 0 AS always FROM {part}"
register(
    "shown_rows",
    lambda s, d: assess.shown_rows(view(s, d, _ROWS), 5),
    f"""WITH r AS (SELECT *, always OR row_number() OVER (PARTITION BY grp, always ORDER BY n DESC, k) <= 5 AS shown FROM {duck(_ROWS)})
SELECT grp, count(*) FILTER (shown) AS shown, count(*) FILTER (NOT shown) AS hidden, CAST(coalesce(sum(n) FILTER (NOT shown), 0) AS BIGINT) AS hidden_n FROM r GROUP BY 1""",
)
_TIERS = "SELECT 'near' AS tier FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'human' FROM {region} WHERE r_regionkey = 0"
register(
    "findings",
    lambda s, d: assess.findings(view(s, d, SITES).withColumn("level", specificity.level()), view(s, d, _TIERS)),
    f"""WITH s AS (SELECT *, {_LEVEL} AS level FROM {duck(SITES)})
SELECT CASE WHEN role = 'probe' THEN 'INFO' ELSE 'WARN' END AS severity, CASE WHEN role = 'probe' THEN 'probe site' ELSE 'primer site' END AS topic, tier, count(*) AS n FROM s WHERE level <> 'minor' GROUP BY 1, 2, 3
UNION ALL SELECT 'INCOMPLETE', 'unsearched', tier, 0 FROM {duck(_TIERS)} WHERE tier NOT IN (SELECT tier FROM s)""",
)
_BRACKET = "SELECT CAST(o_custkey AS BIGINT) AS k, CAST(o_orderkey % 50 AS INT) AS ok, CAST(o_orderkey % 7 AS INT) AS bad, CAST(o_orderkey % 5 AS INT) AS open, o_orderkey % 2 = 0 AS complete, CASE o_orderkey % 3 WHEN 0 THEN 'WARN' WHEN 1 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(o_orderkey AS BIGINT) AS o FROM {orders}"
register(
    "bracket_holdback",
    lambda s, d: view(s, d, _BRACKET).select("o", assess.bracket(F.col("ok"), F.col("bad"), F.col("open")).alias("b"), assess.hold_back(F.col("status"), F.col("complete")).alias("status")).select("o", "b.low", "b.high", "status"),
    f"SELECT o, CASE WHEN ok + bad + open > 0 THEN round(100.0 * ok / (ok + bad + open), 6) END AS low, CASE WHEN ok + bad + open > 0 THEN round(100.0 * (ok + open) / (ok + bad + open), 6) END AS high, CASE WHEN complete THEN status ELSE 'INCOMPLETE' END AS status FROM {duck(_BRACKET)}",
)
