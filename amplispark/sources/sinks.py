"""Where results go (SNK-01 .. SNK-04, SNK-08, SNK-09)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: SNK-04: the sheets of a record, each a DataFrame of its name.
SHEETS = (
    "summary", "inputs", "oligo_qc", "structures", "sites", "off_target_variants", "products", "searches", "hits_per_query", "findings", "exclusivity", "taxonomy", "oligo_variants", "fragment_variants",
    "variant_coverage", "coverage", "escapes", "unassembled", "from_parts", "channels", "years", "inclusivity", "positions", "sections", "checks", "configuration",
)


# Fixed values (SNK-02): the columns of the table of assessed sites, and the decimals of those that are rounded.
HIT_COLUMNS = (
    "tier", "query", "role", "accession", "taxid", "organism", "orientation", "start", "end", "level", "source", "mismatches", "gaps", "ambiguous", "unaligned", "mismatches_last5", "clean_3prime_nt",
    "defect_positions", "duplex_tm_c", "delta_tm_c", "duplex_dg_kcal", "oligo_alignment", "subject_alignment", "title",
)
_DECIMALS = {"duplex_tm_c": 1, "delta_tm_c": 1, "duplex_dg_kcal": 2}


def hit_rows(sites: DataFrame) -> DataFrame:
    """SNK-02: the assessed sites with all ``HIT_COLUMNS``, as text: what a site lacks is empty, lists are joined by commas."""

    def of(name: str) -> Column:
        if name not in sites.columns:
            return F.lit("").alias(name)
        kind, c = dict(sites.dtypes)[name], F.col(name)
        text = F.array_join(F.transform(c, lambda x: x.cast("string")), ",") if kind.startswith("array") else F.round(c, _DECIMALS[name]).cast("string") if name in _DECIMALS else c.cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    return sites.select(*[of(c) for c in HIT_COLUMNS])


def write_hits(sites: DataFrame, path: str) -> None:
    """SNK-02: the table of assessed sites as tab-separated files."""
    write_tsv(hit_rows(sites), path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """SNK-02, SNK-03: tab-separated files with a header; arrays as text; never over an existing folder."""
    flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("errorifexists").option("sep", "\t").option("header", True).csv(path)


def write_sheets(sheets: Mapping[str, DataFrame], path: str) -> None:
    """SNK-04: each sheet as Parquet under its name."""
    for name, rows in sheets.items():
        if name not in SHEETS:
            raise ValueError(f"no sheet {name!r}")
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")


def write_record(spark: SparkSession, record: Mapping, path: str) -> None:
    """SNK-01: one record as JSON, never over an existing one."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def inputs_hash(inputs: Mapping, operational: tuple[str, ...] = ("ncbi", "report")) -> str:
    """SNK-08: SHA-256 of the canonical JSON of the inputs, without keys that change no result."""
    kept = {k: v for k, v in inputs.items() if k not in operational}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def code_fingerprint(package: Path | None = None) -> str:
    """SNK-08: SHA-256 over the names and contents of a package's source files, in the order of the names; by default of this one."""
    root = Path(__file__).resolve().parent.parent if package is None else Path(package)
    files = sorted(p for p in root.rglob("*") if p.is_file() and p.suffix != ".pyc" and "__pycache__" not in p.parts)
    lines = "".join(f"{hashlib.sha256(p.read_bytes()).hexdigest()}  {p.relative_to(root).as_posix()}\n" for p in files)
    return hashlib.sha256(lines.encode()).hexdigest()


def summary(record: Mapping) -> dict:
    """SNK-09: the scalars of a record, lists as their lengths."""
    return {k: len(v) if isinstance(v, list) else summary(v) if isinstance(v, Mapping) else v for k, v in record.items()}
