"""Assays and configuration (SRC-01, SRC-02, SRC-12, SRC-20, IC-*): small, read and checked on the driver."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from amplispark.functions.seq import CODES

ROLES = ("forward", "reverse", "probe")
SHORTEST, LONGEST = 10, 60
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
_VARIANT = re.compile(r"_v\d+$")


class AssayError(ValueError):
    """Everything that is wrong with an assay, a line each."""


@dataclass
class Assay:
    """E2: an assay's oligos, loci, channels and evidence, with the violations found."""

    name: str
    oligos: list[dict]
    taxid: int | None = None
    accession: str | None = None
    taxa: list[dict] = field(default_factory=list)
    loci: list[dict] = field(default_factory=list)
    channels: list[dict] = field(default_factory=list)
    evidence: list[dict] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The oligos as a DataFrame."""
        rows = [(self.name, k, o["name"], o["role"], o["sequence"], o.get("reporter"), o.get("quencher"), o.get("modifications") or []) for k, o in enumerate(self.oligos)]
        return spark.createDataFrame(rows, "assay string, pos int, oligo string, role string, sequence string, reporter string, quencher string, modifications array<string>")


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """SRC-02: ``over`` upon ``base``, mapping by mapping; null drops a section."""
    out = dict(base)
    for k, v in over.items():
        if v is None and isinstance(out.get(k), Mapping):
            continue
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def flattened(config: Mapping, prefix: str = "") -> dict[str, object]:
    """FN-24: nested settings by dotted name."""
    out: dict[str, object] = {}
    for k, v in config.items():
        out |= flattened(v, f"{prefix}{k}.") if isinstance(v, Mapping) else {f"{prefix}{k}": v}
    return out


def differing(config: Mapping, defaults: Mapping) -> dict[str, tuple[object, object]]:
    """FN-24: settings that differ from the defaults, as (default, value)."""
    a, b = flattened(defaults), flattened(config)
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)}


def oligo_entries(value: object, role: str) -> list[dict]:
    """SRC-20: one sequence, one mapping or a list of them; several need names."""
    rows = value if isinstance(value, list) else [value]
    out = [dict(x) if isinstance(x, Mapping) else {"sequence": x} for x in rows if x is not None]
    if len(out) > 1 and any("name" not in x for x in out):
        raise AssayError(f"{role}: several oligos need a name each")
    return [x | {"role": role, "name": x.get("name", role), "sequence": re.sub(r"\s+", "", str(x.get("sequence", ""))).upper()} for x in out]


def build_assay(spec: Mapping, overrides: Mapping | None = None) -> Assay:
    """SRC-01: a checked assay of its mapping; every violation is reported at once."""
    s = deep_merge(spec, overrides or {})
    oligos = [o for role in ROLES for o in oligo_entries(s.get(role), role)]
    for o in oligos:  # IC-06
        if o["role"] == "probe":
            for k in ("reporter", "quencher", "modifications"):
                o.setdefault(k, s.get(f"probe_{k}"))
    target = s.get("target") or {}
    taxa = list(target.get("taxa") or [])
    taxa += [{"taxid": t, "role": "must_not_detect"} for t in s.get("exclusion_taxids") or []]
    probes = [o["name"] for o in oligos if o["role"] == "probe"]
    loci = s.get("loci") or [{"name": "locus", "oligos": [o["name"] for o in oligos]}]  # IC-09
    by_dye: dict[str, list[str]] = {}
    for o in oligos:
        if o["role"] == "probe":
            by_dye.setdefault(o.get("reporter") or "probe", []).append(o["name"])
    channels = s.get("channels") or [{"name": d, "dye": d, "probes": p} for d, p in by_dye.items()]
    assay = Assay(str(s.get("assay_name", "")), oligos, target.get("taxid"), target.get("accession"), taxa, loci, channels, list(s.get("evidence") or []))
    if wrong := violations(assay, probes):
        raise AssayError("\n".join(wrong))
    return assay


def violations(a: Assay, probes: list[str]) -> list[str]:
    """IC-01 .. IC-08: what is wrong with an assay."""
    out, names = [], [o["name"] for o in a.oligos]
    for o in a.oligos:
        bad = sorted({c for c in o["sequence"] if c not in CODES})
        if bad:
            out.append(f"{o['name']}: no IUPAC codes: {' '.join(bad)}" + (" (write T for U)" if "U" in bad else ""))
        if not SHORTEST <= len(o["sequence"]) <= LONGEST:
            out.append(f"{o['name']}: {len(o['sequence'])} nt, not {SHORTEST} to {LONGEST}")
        if not _NAME.fullmatch(o["name"]) or _VARIANT.search(o["name"]):
            out.append(f"{o['name']}: not a valid name")
    out += [f"{n}: name used twice" for n in sorted({n for n in names if names.count(n) > 1})]
    out += [f"no {r} primer" for r in ("forward", "reverse") if not any(o["role"] == r for o in a.oligos)]
    if a.taxid is None and a.accession is None:
        out.append("target: a taxid or an accession is needed")
    ids = [t["taxid"] for t in a.taxa]
    out += [f"taxon {t}: listed twice" for t in sorted({t for t in ids if ids.count(t) > 1})]
    if a.taxid in ids:
        out.append("taxon: the target itself is listed")
    out += [f"evidence: unknown oligo {e['oligo']}" for e in a.evidence if e["oligo"] not in names]
    in_loci = [o for x in a.loci for o in x["oligos"]]
    out += [f"locus: unknown oligo {o}" for o in in_loci if o not in names] + [f"locus: {o} is in none" for o in names if o not in in_loci]
    out += [f"locus: probe {p} is in several" for p in probes if in_loci.count(p) > 1]
    in_channels = [p for c in a.channels for p in c["probes"]]
    out += [f"channel: unknown probe {p}" for p in in_channels if p not in probes] + [f"channel: {p} is in {in_channels.count(p)}" for p in probes if in_channels.count(p) != 1]
    dyes = [c.get("dye", c["name"]) for c in a.channels]
    return out + [f"channel: dye {d} is used twice" for d in sorted({d for d in dyes if dyes.count(d) > 1})]


def organism_names(lines: list[str]) -> list[str]:
    """SRC-12: names in order, each once, without comments and blanks."""
    return list(dict.fromkeys(x for line in lines if (x := line.split("#")[0].strip())))
