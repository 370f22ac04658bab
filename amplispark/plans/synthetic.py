"""Assay inputs derived from the driver's tables by SQL that Spark and DuckDB read alike.

The tables hold no DNA; digests of their keys, letters for hex digits, stand in
for it, with a known fragment in two genomes of three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORWARD, PROBE, REVERSE = "GACCCCAAAATCAGCGAAAT", "ACCCCGCATTACGTTTGGTGGACC", "TCTGGTTACTGCCAGTTGAATCTG"
_RC = str.maketrans("ACGT", "TGCA")
GAPS = ("ACGTTGCAAGCTTAGGCATCGATCCGTAAC", "TGCATCCGATAGGCTTAACGCATGCTAGTA")
FRAGMENT = FORWARD + GAPS[0] + PROBE + GAPS[1] + REVERSE.translate(_RC)[::-1]
#: Oligos as they stand on the sense strand of the fragment: the reverse primer is its reverse complement.
OLIGOS = (("forward", FORWARD), ("probe", PROBE), ("reverse", REVERSE))


def dna(x: str) -> str:
    """SQL for 32 bases of a key."""
    return f"translate(md5(CAST({x} AS {{STR}})), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def revcomp(x: str) -> str:
    return f"reverse(translate({x}, 'ACGTN', 'TGCAN'))"


_OTHER = " || ".join(dna(f"k + {n}000000") for n in (2, 3, 4, 5))
CONTIGS = f"""
WITH g0 AS (SELECT o_orderkey AS k, o_orderdate, o_orderpriority, o_custkey FROM {{orders}}),
g1 AS (
  SELECT *, CASE WHEN k % 7 IN (1, 2, 3) THEN substr('{FRAGMENT}', 1, CAST((k * 37) % 128 AS INT)) || substr('ACGT', CAST(1 + k % 4 AS INT), 1)
              || substr('{FRAGMENT}', CAST(2 + (k * 37) % 128 AS INT)) ELSE '{FRAGMENT}' END AS frag FROM g0
), g2 AS (
  SELECT *, {dna("k")} || {dna("k + 1000000")} || CASE WHEN k % 3 = 2 THEN {_OTHER} ELSE frag END || {dna("k + 6000000")} || {dna("k + 7000000")} AS s0 FROM g1
), g3 AS (
  SELECT *, CASE WHEN k % 11 = 0 THEN substr(s0, 1, 99) || repeat('N', 12) || substr(s0, 112) ELSE s0 END AS s1 FROM g2
), g4 AS (
  SELECT *, CASE WHEN k % 13 = 0 THEN substr(s1, 100) ELSE s1 END AS s2 FROM g3
)
SELECT k, 'GCA_' || lpad(CAST(k AS {{STR}}), 9, '0') || '.' || CAST(1 + k % 2 AS {{STR}}) AS accession,
       CASE WHEN k % 5 = 0 THEN {revcomp("s2")} ELSE s2 END AS seq, CAST(o_orderdate AS DATE) AS release_date,
       CAST(year(o_orderdate) AS INT) AS release_year,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'complete' WHEN '2' THEN 'chromosome' WHEN '3' THEN 'scaffold' ELSE 'contig' END AS level,
       CAST(o_custkey AS BIGINT) AS taxid
FROM g4
"""

#: One row per binding site of an off-target search, from lineitem.
SITES = """
SELECT CAST(l_orderkey AS BIGINT) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 100000000 AS site_id,
       CASE WHEN l_linenumber % 3 = 0 THEN 'probe' WHEN l_linenumber % 3 = 1 THEN 'forward' ELSE 'reverse' END AS role,
       CASE l_returnflag WHEN 'A' THEN 'near' WHEN 'N' THEN 'background' ELSE 'other' END AS tier,
       'NC_' || lpad(CAST(l_suppkey AS {STR}), 6, '0') AS accession, CAST(l_suppkey AS BIGINT) AS taxid,
       CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS orientation,
       CAST(floor(l_extendedprice) AS BIGINT) % 20000 AS s_start, CAST(floor(l_extendedprice) AS BIGINT) % 20000 + 19 AS s_end,
       CAST(l_quantity AS INT) % 6 AS mismatches, CAST(l_partkey % 2 AS INT) AS gaps, CAST(l_partkey % 8 AS INT) AS clean3
FROM {lineitem}
"""

#: Search hits: one row per aligned stretch.
HSPS = """
SELECT CAST(l_orderkey AS BIGINT) AS hit, CAST(l_linenumber AS INT) AS hsp, 'q' || CAST(l_linenumber % 4 AS {STR}) AS query,
       CASE l_returnflag WHEN 'A' THEN 'near' WHEN 'N' THEN 'background' ELSE 'other' END AS tier, CAST(l_suppkey AS BIGINT) AS taxid,
       CAST(20 + l_linenumber % 3 AS INT) AS query_len, CAST(1 + l_partkey % 4 AS INT) AS query_from,
       CAST(20 + l_linenumber % 3 - l_suppkey % 4 AS INT) AS query_to, CAST(10 + CAST(l_quantity AS INT) % 11 AS INT) AS identity,
       CAST(l_partkey % 2 AS INT) AS gaps, CAST(18 + l_suppkey % 3 AS INT) AS align_len, l_extendedprice / 1000.0 AS evalue, CAST(l_quantity AS INT) AS score
FROM {lineitem}
"""

#: Species, genera and families: (taxid, parent, rank, name).
TAXA = """
SELECT CAST(1 AS BIGINT) AS taxid, CAST(NULL AS BIGINT) AS parent, 'root' AS rank, 'root' AS name
UNION ALL SELECT CAST(10 + r_regionkey AS BIGINT), CAST(1 AS BIGINT), 'family', r_name FROM {region}
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(10 + n_regionkey AS BIGINT), 'genus', n_name FROM {nation}
UNION ALL SELECT CAST(1000 + s_suppkey AS BIGINT), CAST(100 + s_nationkey AS BIGINT), 'species', s_name FROM {supplier}
"""


def fill(sql: str, **tables: str) -> str:
    """A view's SQL with its dialect and table names put in."""
    for name, value in tables.items():
        sql = sql.replace("{" + name + "}", value)
    return sql


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")


def duck(sql: str) -> str:
    """A view as a DuckDB subquery."""
    return "(" + fill(sql, STR="VARCHAR", **{t: t for t in _TABLES}) + ")"


#: Where kernels work on the derived rows, the columns that they derive from.
_KERNEL_INPUT = {"orders": ("o_orderkey", "o_orderdate", "o_orderpriority", "o_custkey")}


#: Rows that one task of costly expressions or kernels takes, about: a task stays short however large the table is.
ROWS_A_TASK = 50_000


def tasks_of(rows: DataFrame) -> int:
    """How many tasks the rows of a table are dealt over."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))


def _spread(keys: DataFrame) -> DataFrame:
    """The rows dealt evenly over tasks by their number; as they lie, a small file or a large row group leaves them to few tasks."""
    return keys.repartition(tasks_of(keys))


def dealt(spark: SparkSession, sf_dir: str, table: str, rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a view dealt over tasks by keys, as many as its table's rows need: what is grouped by these keys is not shuffled again, nor its tasks joined to a few."""
    return rows.repartition(tasks_of(spark.read.parquet(f"{sf_dir}/{table}.parquet")), *keys)


def view(spark: SparkSession, sf_dir: str, sql: str, spread: bool = False) -> DataFrame:
    """A view as a DataFrame; ``spread`` deals its tables' rows over tasks by their number, for what is costly a row."""
    used = [t for t in _TABLES if "{" + t + "}" in sql]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    if sql == CONTIGS:
        frames = {t: _spread(f.select(*_KERNEL_INPUT[t])) for t, f in frames.items()}
    elif spread:
        frames = {t: _spread(f) for t, f in frames.items()}
    return spark.sql(sql.replace("{STR}", "STRING"), **frames)
