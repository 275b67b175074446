"""How far the rows behind a chart can be trusted: size, missing values, robustness, and what to warn of."""

from __future__ import annotations

import math

from plumbline.plans.model import Column, Profile, Spec

FULL, GROUP_FULL = 30, 20
TOP_FLOOR = 0.5
MOST_MISSING, MISSING_WEIGHT = 0.5, 0.5
WARN_MISSING, SEVERE_MISSING = 0.2, 0.4
SMALL_GROUP = 5
SENTINEL, SENTINEL_ROBUST = 0.6, 0.85
EXTREME_WEIGHT, EXTREME_REF, EXTREME_WARN = 0.2, 0.10, 0.01
TOP_N = 20
CAUTION = " Caution: "
#: Charts that use the data the way a simpler one does.
FAMILY = dict.fromkeys(("lollipop", "polar_line", "rose", "dumbbell", "slopegraph", "stacked_bar", "sankey"), "bar") | dict.fromkeys(("violin", "raincloud", "ridgeline", "dot_interval"), "box") | {"hexbin": "scatter"}


def size_factor(n: int, full: int) -> float:
    return min(1.0, math.sqrt(n / full)) if n > 0 else 0.0


def group_factor(groups: dict[str, int]) -> float:
    total = sum(groups.values())
    return sum(n * size_factor(n, GROUP_FULL) for n in groups.values()) / total if total else 1.0


def sentinels(c: Column | None) -> list[dict]:
    return c.quality.sentinels if c is not None and c.quality else []


def _valid(c: Column | None) -> float:
    """Share of rows with a usable value of a column."""
    if c is None:
        return 1.0
    if c.semantic == "numeric" and c.quality and c.quality.valid_ratio is not None:
        return min(c.quality.valid_ratio, 1 - c.missing_ratio)
    return 1.0 - c.missing_ratio


def usable(spec: Spec, profile: Profile) -> tuple[float, dict[str, int] | None, bool]:
    """(share of rows the chart can use, rows per group, whether exact)."""
    rows = max(1, profile.profiled_rows)
    x, y, group = profile.column(spec.x), profile.column(spec.y), profile.column(spec.group_by)
    e = profile.evidence
    kind = FAMILY.get(spec.type, spec.type)
    if spec.type == "heatmap" and spec.x is None:
        counts = [n for _, n in profile.pearson.values()]
        return (min(counts) / rows if counts else 1.0), None, bool(counts)
    share, groups, exact = _valid(x) * _valid(y), None, spec.y is None
    if kind in ("bar", "box", "heatmap") and x is not None:
        found = next((m for m in e.get("cat_num", []) if m["cat"] == spec.x and m["num"] == spec.y), None)
        if found:
            share, groups, exact = found["n_total"] / rows, dict(found["group_counts"]), True
        elif x.top_values and (x.n_categories or 0) <= len(x.top_values):
            groups = dict(x.top_values)
    elif kind == "scatter":
        pair = profile.pearson.get((spec.x, spec.y)) or profile.pearson.get((spec.y, spec.x))
        if pair:
            share, exact = pair[1] / rows, True
    elif kind == "line":
        found = next((m for m in e.get("time_effects", []) if m["datetime"] == spec.x and m["num"] == spec.y), None)
        if found:
            share, exact = found["n_total"] / rows, True
    if group is not None:
        share, exact = share * _valid(group), exact and not group.missing_ratio
        if kind in ("line", "scatter"):
            found = next((m for m in e.get("cat_num", []) if m["cat"] == spec.group_by and m["num"] == spec.y), None)
            groups = dict(found["group_counts"]) if found else dict(group.top_values) or None
    return min(1.0, max(0.0, share)), groups, exact


def _drawn(spec: Spec, groups: dict[str, int]) -> dict[str, int]:
    most = spec.top_n or TOP_N
    if FAMILY.get(spec.type, spec.type) != "bar" or len(groups) <= most:
        return groups
    return dict(sorted(groups.items(), key=lambda g: (-g[1], g[0]))[:most])


def _axes(spec: Spec) -> list[tuple[str, bool]]:
    """(number, whether the chart is sensitive to single values of it)."""
    kind = FAMILY.get(spec.type, spec.type)
    if kind in ("histogram",):
        return [(spec.x, True)]
    if kind == "scatter":
        return [(n, True) for n in (spec.x, spec.y) if n]
    if kind == "box":
        return [(spec.y, False)] if spec.y else []
    return [(spec.y, spec.aggregation not in ("median", "count"))] if spec.y else []


def warning(code: str, severity: str, message: str, **meta) -> dict:
    return {"code": code, "severity": severity, "message": message, "meta": meta}


def _robustness(spec: Spec, profile: Profile) -> tuple[float, list[dict], bool]:
    if spec.type == "heatmap" and spec.x is None:
        names = [c for c in profile.columns if c.semantic == "numeric"]
        hit = [c.name for c in names if sentinels(c)]
        share = len(hit) / len(names) if names else 0.0
        if not hit:
            return 1.0, [], False
        return 1 - (1 - SENTINEL) * share, [warning("suspected_sentinel", "severe" if share >= 0.5 else "warning", f"{len(hit)} of {len(names)} numeric columns ({', '.join(hit)}) hold suspected fill values that may distort correlations.", columns=hit)], share >= 0.5
    factor, out, cap = 1.0, [], False
    for name, sensitive in _axes(spec):
        c = profile.column(name)
        if c is None or c.quality is None:
            continue
        ratio = c.quality.extreme_count / c.quality.n if c.quality.n else 0.0
        if sentinels(c):
            factor, cap = min(factor, SENTINEL if sensitive else SENTINEL_ROBUST), cap or sensitive
            values = ", ".join(f"{s['value']:g} ×{s['count']}" for s in sentinels(c))
            effect = "they distort its mean and range" if sensitive else "this display is robust to them"
            out.append(warning("suspected_sentinel", "severe" if sensitive else "warning", f"{name} holds suspected fill values ({values}); {effect}.", column=name, sensitive=sensitive))
        elif ratio > 0 and sensitive:
            factor = min(factor, 1 - EXTREME_WEIGHT * min(1.0, ratio / EXTREME_REF))
            out.append(warning("extreme_value", "warning" if ratio >= EXTREME_WARN else "info", f"{name} has {c.quality.extreme_count} values ({ratio:.1%}) far outside its usual range; the axis may be compressed.", column=name))
    return factor, out, cap


def assess(spec: Spec, profile: Profile) -> tuple[dict, list[dict], str | None]:
    """(confidence, warnings, tier cap) of a chart on this profile."""
    share, groups, exact = usable(spec, profile)
    scale = profile.n_rows / profile.profiled_rows if profile.profiled_rows else 1.0
    n = round(share * profile.n_rows)
    drawn = {g: round(c * scale) for g, c in _drawn(spec, groups).items()} if groups else {}
    size = min(size_factor(n, FULL), group_factor(drawn) if drawn else 1.0)
    tiny = sum(c < SMALL_GROUP for c in drawn.values()) > 0.5 * len(drawn) if drawn else False
    single = sum(c < 2 for c in drawn.values()) > 0.5 * len(drawn) if drawn else False
    missing = 1 - share
    robust, notes, cap = _robustness(spec, profile)
    out = []
    if size_factor(n, FULL) < 1:
        out.append(warning("small_sample", "severe" if size < TOP_FLOOR else "warning", f"Only {n} usable rows.", n=n))
    elif drawn and (tiny or size < 1):
        out.append(warning("small_groups", "severe" if single or size < TOP_FLOOR else "warning" if tiny or size < 0.9 else "info", f"The smallest group has {min(drawn.values())} rows.", min_group=min(drawn.values())))
    if missing >= WARN_MISSING:
        out.append(warning("missing_data", "severe" if missing >= SEVERE_MISSING else "warning", f"{missing:.0%} of the rows cannot be used.", ratio=round(missing, 4)))
    for c in (profile.column(spec.x), profile.column(spec.y)):
        if c is not None and c.quality and c.quality.invalid:
            out.append(warning("invalid_values", "warning", f"{c.name} has {c.quality.invalid} values that are no numbers.", column=c.name))
    factors = {"sample_size": size, "missingness": 1 - MISSING_WEIGHT * missing, "robustness": robust}
    confidence = factors | {"overall": math.prod(factors.values()), "n_total": profile.n_rows, "n_effective": n, "missing_ratio": missing, "min_group_n": min(drawn.values()) if drawn else None, "n_source": "exact" if exact else "estimated"}
    return confidence, out + notes, "secondary" if size < TOP_FLOOR or tiny or cap else None


def with_caution(reason: str, warnings: list[dict]) -> str:
    """The reason with what to be careful about; an earlier caution is replaced."""
    base = reason.split(CAUTION)[0]
    notes = [w["message"] for w in warnings if w["severity"] != "info"]
    return (base.rstrip() + CAUTION + " ".join(notes)).strip() if notes else base


def excluded(profile: Profile) -> list[dict]:
    """One warning for each column left out for missing more than half its values."""
    return [warning("column_excluded", "warning", f"{c.name} was left out: {c.missing_ratio:.0%} of its values are missing.", column=c.name) for c in profile.columns if c.semantic not in ("id", "unknown", "text") and c.missing_ratio > MOST_MISSING]
