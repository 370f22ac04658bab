"""Checks of a configuration (IC-10 .. IC-12): small, on the driver."""

from __future__ import annotations

from collections.abc import Mapping

from amplispark.sources.assay import flattened

#: IC-10: sections that an assay may set for itself; servers and reports are the laboratory's own.
ASSAY_SECTIONS = ("reaction", "oligo", "thresholds", "search", "specificity", "organisms", "inclusivity", "variants")

# IC-11, fixed values: what the settings of a configuration must be, by the path that they stand at.
#: Bands (pass_range, fail_range), limits of runs (warn_at, fail_at), upper limits (warn_above, fail_above) and ranges of counts (min, max).
BANDS = (
    "thresholds.primer.length_nt", "thresholds.primer.gc_percent", "thresholds.primer.tm_c", "thresholds.probe.length_nt", "thresholds.probe.gc_percent",
    "thresholds.probe.tm_minus_mean_primer_c", "thresholds.amplicon.length_bp", "thresholds.amplicon.gc_percent",
)
RUN_LIMITS = ("thresholds.primer.max_run", "thresholds.primer.max_g_run", "thresholds.probe.max_run", "thresholds.probe.max_g_run")
UPPER_LIMITS = ("thresholds.pair.primer_tm_diff_c",)
COUNT_RANGES = ("thresholds.primer.gc_in_last5",)
#: Settings with a least value, with one that they must be above, or below, and with both ends.
AT_LEAST = {
    "reaction.na_mM": 0, "reaction.mg_mM": 0, "reaction.dntp_mM": 0, "ncbi.blast_min_interval_s": 10, "ncbi.poll_interval_s": 60, "ncbi.resubmit_after_minutes": 0, "ncbi.max_retries": 0,
    "search.hitlist_size": 1, "search.max_taxids_per_search": 1, "specificity.alignment.gap_open": 0, "specificity.max_sites_per_query": 1, "specificity.max_amplicon_size": 1,
    "specificity.max_amplicons": 1, "specificity.window_padding_nt": 0, "specificity.partner_scan_max_windows": 0, "specificity.probe_scan_max_products": 0, "inclusivity.lookback_years": 1,
    "inclusivity.verdict_window_years": 0, "inclusivity.min_genomes_for_verdict": 1, "variants.blast_max_records_per_run": 1, "variants.max_assemblies_per_run": 1, "variants.flank_nt": 0,
    "variants.seed_step": 1, "variants.min_anchored_bases": 1, "variants.min_context_bases": 1, "variants.min_identity_anchored_bases": 1, "variants.max_indel": 1,
}
ABOVE = {
    "reaction.primer_nM": 0, "reaction.probe_nM": 0, "ncbi.backoff_base_s": 0, "search.reward": 0, "specificity.alignment.match": 0, "specificity.alignment.gap_extend": 0,
}
BELOW = {"search.penalty": 0, "specificity.alignment.mismatch": 0}
WITHIN = {
    "ncbi.datasets_batch_size": (1, 100), "inclusivity.max_undetermined_percent": (0, 100), "inclusivity.warn_below_percent": (0, 100), "inclusivity.fail_below_percent": (0, 100),
    "variants.blast_records_per_search": (1, 100), "variants.seed_length": (8, 32), "variants.min_copy_identity": (0, 1),
}
#: Settings that are one of a few words or numbers.
CHOICES = {
    "schema_version": (1,), "reaction.tm_method": ("santalucia", "breslauer"), "reaction.salt_correction": ("santalucia", "owczarzy", "schildkraut"), "search.program": ("blastn",),
    "search.word_size": (7, 11, 15), "search.result_format": ("JSON2_S",), "specificity.probe_binds_if": ("critical", "warning"), "organisms.source": ("assay", "global"),
    "inclusivity.status_axis": ("release", "collection"), "variants.source": ("datasets", "blast_partitioned"), "variants.probe_channels": ("any", "all"),
    "variants.multicopy_unassembled": ("auto", "off"), "variants.judge_from_parts": ("undetermined", "detectable", "off"),
    **{f"specificity.severity.{k}": ("FAIL", "WARN", "INFO") for k in (
        "primer_site_critical", "primer_site_critical_no_product", "primer_site_warning", "probe_site_critical", "amplicon_likely_detected", "amplicon_not_detected",
    )},
}
#: Pairs of which the first may not exceed the second: the warning level of a kind of site is at least as permissive as the critical one.
ORDERED = (
    ("inclusivity.fail_below_percent", "inclusivity.warn_below_percent"),
    *((f"specificity.{k}.critical.{x}", f"specificity.{k}.warning.{x}") for k in ("primer_site", "probe_site") for x in ("max_mismatches", "max_gaps")),
    *((f"specificity.{k}.warning.min_clean_3prime_nt", f"specificity.{k}.critical.min_clean_3prime_nt") for k in ("primer_site", "probe_site")),
)
#: The tiers that are judged, and the settings that list some of them.
TIERS = ("near_neighbours", "background", "exclusivity")
TIER_LISTS = ("specificity.off_target_tiers", "specificity.tier_waivers", "specificity.cautious_tiers")


def foreign_sections(settings: Mapping) -> list[str]:
    """IC-10: what is wrong with an assay's own settings."""
    return [f"settings.{k}: not a section that an assay may set" for k in settings if k not in ASSAY_SECTIONS]


def setting(config: Mapping, path: str):
    """What stands at a dotted path, None where nothing does."""
    for part in path.split("."):
        if not isinstance(config, Mapping) or part not in config:
            return None
        config = config[part]
    return config


def _number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _pair(x) -> bool:
    return isinstance(x, list | tuple) and len(x) == 2 and all(map(_number, x))


def band_errors(name: str, band: Mapping) -> list[str]:
    """IC-11: the two ranges of a band are in order, and the fail range encloses the pass range."""
    inner, outer = band.get("pass_range"), band.get("fail_range")
    if not (_pair(inner) and _pair(outer)):
        return [f"{name}: pass_range and fail_range are two numbers each"]
    if not outer[0] <= inner[0] <= inner[1] <= outer[1]:
        return [f"{name}: fail_range {list(outer)} must enclose pass_range {list(inner)}, each in order"]
    return []


def ordered_errors(name: str, limits: Mapping, low: str, high: str) -> list[str]:
    """IC-11: two numbers of one setting in order."""
    a, b = limits.get(low), limits.get(high)
    if not (_number(a) and _number(b)):
        return [f"{name}: {low} and {high} are numbers"]
    return [f"{name}: {high} {b} must be at least {low} {a}"] if b < a else []


def _tier_errors(config: Mapping) -> list[str]:
    out = []
    for path in TIER_LISTS:
        tiers = setting(config, path) or ()
        unknown = [t for t in tiers if t not in TIERS]
        out += [f"{path}: unknown tiers {', '.join(map(repr, unknown))}; judged are {', '.join(TIERS)}"] if unknown else []
    listed = setting(config, "specificity.off_target_tiers") or ()
    out += ["specificity.off_target_tiers: a tier is listed twice"] if len(set(listed)) < len(listed) else []
    waivers = setting(config, "specificity.tier_waivers") or {}
    return out + [f"specificity.tier_waivers.{t}: a waiver needs a reason" for t, why in waivers.items() if not str(why or "").strip()]


def cross_field_errors(config: Mapping) -> list[str]:
    """IC-11: what is wrong with the settings that a configuration has; one that it lacks is no error, as the defaults have it."""
    out: list[str] = []
    for paths, check in (
        (BANDS, band_errors), (RUN_LIMITS, lambda n, x: ordered_errors(n, x, "warn_at", "fail_at")), (UPPER_LIMITS, lambda n, x: ordered_errors(n, x, "warn_above", "fail_above")),
        (COUNT_RANGES, lambda n, x: ordered_errors(n, x, "min", "max")),
    ):
        for path in paths:
            if (found := setting(config, path)) is not None:
                out += check(path, found) if isinstance(found, Mapping) else [f"{path}: must be a section"]
    tests = [(AT_LEAST, lambda x, y: x >= y, "must be at least {}"), (ABOVE, lambda x, y: x > y, "must be above {}"), (BELOW, lambda x, y: x < y, "must be below {}"), (WITHIN, lambda x, y: y[0] <= x <= y[1], "must be within {}")]
    for limits, holds, says in tests:
        for path, bound in limits.items():
            if (found := setting(config, path)) is not None and not (_number(found) and holds(found, bound)):
                out.append(f"{path}: {found!r} {says.format(bound if _number(bound) else f'{bound[0]} to {bound[1]}')}")
    for path, allowed in CHOICES.items():
        found = setting(config, path)
        if found is not None and found not in allowed:
            out.append(f"{path}: {found!r} is none of {', '.join(map(str, allowed))}")
    for low, high in ORDERED:
        a, b = setting(config, low), setting(config, high)
        if _number(a) and _number(b) and a > b:
            out.append(f"{low} {a} must not exceed {high} {b}")
    if any(not _number(t) or t <= 0 for t in setting(config, "search.background_taxids") or ()):
        out.append("search.background_taxids: must be positive numbers")
    return out + _tier_errors(config)


def unknown_keys(config: Mapping, defaults: Mapping) -> list[str]:
    """IC-12: settings that the defaults lack; one that exactly one other section has is told where it belongs."""
    homes: dict[str, list[str]] = {}
    for section, settings in defaults.items():
        for k in settings if isinstance(settings, Mapping) else ():
            homes.setdefault(k, []).append(section)
    known, out = flattened(defaults), []
    for name in flattened(config):
        if name in known or any(x.startswith(f"{name}.") or (isinstance(v, Mapping | list) and name.startswith(f"{x}.")) for x, v in known.items()):
            continue
        section, _, key = name.partition(".")
        of = homes.get(key.split(".")[0], [])
        hint = f" ('{key}' belongs under '{of[0]}:', check the indentation)" if key and len(of) == 1 and of[0] != section else ""
        out.append(f"{name}: unknown setting{hint}")
    return out
