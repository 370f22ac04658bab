"""Queries over the audit of rules, the cache and tables of names, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from amplispark.functions import seq
from amplispark.functions.session import shared_dir
from amplispark.operators import audit, oligo_qc, specificity, taxonomy
from amplispark.plans.catalogue import register
from amplispark.plans.synthetic import CONTIGS, OLIGOS, duck, view
from amplispark.sources import cache, tables


def _violations(s, d):
    """Every relevant partial hit on a site of up to five mismatches of every oligo, with ten bases around it; a hit of full length leaves no end to a rule."""
    contigs, q = view(s, d, CONTIGS), F.create_map(*[F.lit(x) for kv in OLIGOS for x in kv])
    sites = oligo_qc.find_sites(contigs, OLIGOS, 5).withColumns({"oligo_seq": q[F.col("oligo")], "role": F.col("oligo")})
    hits = specificity.relevant(audit.partial_hits(sites.where("mismatches > 0"))).where("u5 > 0 OR u3 > 0")  # a perfect site is found whole
    j = hits.join(contigs.select("accession", "seq"), "accession")
    lo = F.greatest(F.col("start") - 10, F.lit(0))
    cut = F.substring("seq", lo + 1, F.col("start") + F.length("site") + 10 - lo)
    window = F.when(F.col("strand") == "-", seq.reverse_complement(cut)).otherwise(cut)
    rows = j.select("accession", "oligo", "strand", "start", "role", "oligo_seq", window.alias("window"), "u3", "lower_bound")
    return audit.rule_violations(rows).select("accession", "oligo", "strand", "start", "check", "defects", "clean3", "level")


register(
    "rule_violations",
    _violations,
    f"SELECT accession, '' AS oligo, '' AS strand, 0 AS start, '' AS \"check\", 0 AS defects, 0 AS clean3, '' AS level FROM {duck(CONTIGS)} WHERE false",
)
_ENTRIES = "SELECT CASE o_orderkey % 2 WHEN 0 THEN 'window' ELSE 'search' END AS kind, CAST(o_custkey AS {STR}) AS request, 'text ' || CAST(o_orderkey AS {STR}) AS text, CAST(o_orderkey AS BIGINT) AS k FROM {orders}"


def _cached(s, d):
    """Two batches, the later one of every third order; entries of the first are 40 days old, of the second 3."""
    root, now = f"{shared_dir(s)}/cache-{uuid.uuid4().hex}", F.expr("TIMESTAMP '2024-06-01 00:00:00'")
    rows = view(s, d, _ENTRIES).withColumn("key", cache.content_key(F.col("kind"), F.col("request")))
    one = lambda x: x.groupBy("kind", "key").agg(F.max_by("text", "k").alias("text"))
    cache.put(one(rows), root, now - F.expr("INTERVAL 40 DAYS"))
    cache.put(one(rows.where("k % 3 = 0")), root, now - F.expr("INTERVAL 3 DAYS"))
    asked = rows.select("kind", "request", "key").distinct()
    old, fresh = cache.get(asked, root, None, now), cache.get(asked, root, 7, now).withColumnRenamed("text", "fresh")
    return asked.join(old, ["kind", "key"]).join(fresh, ["kind", "key"]).select("kind", "request", "text", "fresh")


register(
    "cache_protocol",
    _cached,
    f"""WITH e AS (SELECT * FROM {duck(_ENTRIES)}), n AS (SELECT kind, request, arg_max(text, k) AS text FROM e WHERE k % 3 = 0 GROUP BY 1, 2), o AS (SELECT kind, request, arg_max(text, k) AS text FROM e GROUP BY 1, 2)
SELECT kind, request, coalesce(n.text, o.text) AS text, n.text AS fresh FROM o LEFT JOIN n USING (kind, request)""",
)
# A page of four lines a part: a header, a rule, a row whose name is a link or has an escaped bar, and, after a gap, a line with a bar that is no table.
_LINES = """SELECT 'f' || CAST(p_partkey AS {STR}) AS path, CAST(CASE WHEN n = 3 THEN 5 ELSE n END AS INT) AS line_no, CASE n WHEN 0 THEN '| Name | Group |' WHEN 1 THEN '|:-----|------:|' WHEN 2 THEN
CASE p_partkey % 3 WHEN 0 THEN '| [' || p_brand || '](http://x/y) | *' || CAST(p_size AS {STR}) || '* |' WHEN 1 THEN '| ' || p_brand || '\\\\|' || CAST(p_size % 5 AS {STR}) || ' | a | extra |' ELSE '| `' || p_type || '`' END ELSE 'text | without a rule' END AS value
FROM {part}, (SELECT r_regionkey AS n FROM {region} WHERE r_regionkey < 4) r"""


def _panel(s, d):
    names = tables.listed_names(tables.markdown_tables(view(s, d, _LINES)), "Name")
    known = view(s, d, "SELECT DISTINCT p_brand AS name, CAST(length(p_brand) * 10 + CAST(right(p_brand, 1) AS INT) AS BIGINT) AS taxid FROM {part}")
    synonyms = view(s, d, "SELECT DISTINCT p_type AS name, CAST(900 + length(p_type) AS BIGINT) AS taxid FROM {part}")
    return taxonomy.resolve_names(names, known, synonyms).select("name", "status", F.col("taxid").cast("long").alias("taxid"))


register(
    "panel_names",
    _panel,
    """WITH n AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || '|' || (p_size % 5) ELSE p_type END AS name FROM part),
k AS (SELECT DISTINCT p_brand AS name, CAST(length(p_brand) * 10 + CAST(right(p_brand, 1) AS INT) AS BIGINT) AS taxid FROM part), y AS (SELECT DISTINCT p_type AS name, CAST(900 + length(p_type) AS BIGINT) AS taxid FROM part)
SELECT name, CASE WHEN coalesce(k.taxid, y.taxid) IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, coalesce(k.taxid, y.taxid) AS taxid FROM n LEFT JOIN k USING (name) LEFT JOIN y USING (name)""",
)
