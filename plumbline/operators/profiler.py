"""The profile of a dataset: types, column statistics, quality, and the evidence tables.

Spark counts missing values over all rows, draws the sample and types its
columns; evidence is taken of the sample's columns in memory.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from plumbline.functions import tails
from plumbline.functions.exprs import finite
from plumbline.operators import curves, dependence, profile, robust, typing
from plumbline.operators.bounded import Rows, quantile, spread
from plumbline.operators.sampling import PROFILE_ROWS, exact_sample
from plumbline.operators.whole import Whole
from plumbline.plans.model import Column, Profile, Quality

CATS, CAT_LEVELS = 15, (2, 20)
MATRIX = 30
INTERACTION_CATS, INTERACTION_NUMS = 3, 5
SLOPE_PAIRS, SLOPE_CATS, SLOPE_LEVELS, SLOPE_R = 5, 3, (2, 8), 0.3
TIME_UNITS = ("day", "month", "year")
NEAR_RHO, NAMED_RHO, NEAR_ROWS = 0.995, 0.98, 30
FDR_Q = 0.05
#: Median gaps in days that have a name.
CADENCES = [(0.9, 1.1, "daily"), (6.5, 7.5, "weekly"), (27.0, 32.0, "monthly")]


def span_unit(days: float) -> str:
    return "day" if days <= 90 else "month" if days <= 3 * 365 else "year"


def coarser(unit: str) -> str | None:
    at = TIME_UNITS.index(unit) + 1
    return TIME_UNITS[at] if at < len(TIME_UNITS) else None


def profile_dataset(df: DataFrame, dataset_id: str = "", threshold: int = PROFILE_ROWS, sample: DataFrame | None = None) -> Profile:
    """Counts of missing values are of all rows; everything else is of the sample.

    ``sample`` is that of ``threshold`` rows where the caller has it already.
    """
    nulls = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns)).first()
    n_rows = nulls["_n"]
    raw = sample if sample is not None else (exact_sample(df, threshold, total=n_rows) if n_rows > threshold else df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = min(n_rows, threshold)
        types = typing.infer(raw)
        casted = typing.apply_casts(raw, {c: t.cast for c, t in types.items()})
        columns = _columns(raw, casted, types, nulls, n_rows)
        out = Profile(dataset_id, n_rows, n, columns)
        _evidence(casted, out)
        return out
    finally:
        if sample is None:
            raw.unpersist()


def _columns(raw: DataFrame, casted: DataFrame, types: dict, nulls, n_rows: int) -> list[Column]:
    kinds = dict(raw.dtypes)
    of = lambda *semantics: [c for c, t in types.items() if t.semantic in semantics]
    out = {c: Column(c, kinds[c], t.semantic, t.nominal, t.cast, nulls[c], nulls[c] / n_rows if n_rows else 0.0) for c, t in types.items()}
    unique = typing.distinct_counts(casted, [c for c in out if types[c].semantic != "unknown"])
    for c in out:
        out[c].unique_count = unique.get(c, 0)
    nums, cats = of("numeric"), of("categorical", "boolean")
    for at in range(0, len(nums), MATRIX):
        rows = Rows.of(casted, nums[at : at + MATRIX])
        for c in nums[at : at + MATRIX]:
            values = rows.values(c)
            out[c].stats, out[c].quality = number_stats(values), Quality(**(robust.quality_of(values) or {}))
    if nums:
        _count_quality(raw, casted, out, nums)
    if cats:
        for r in profile.top_categories(casted, cats).collect():
            out[r["column"]].top_values.append((r["value"], r["n"]))
        for c in cats:
            out[c].top_values.sort(key=lambda v: (-v[1], v[0]))
        for r in profile.category_lists(casted, cats).collect():
            out[r["column"]].n_categories, out[r["column"]].labels = r["n_categories"], r["labels"]
    times = of("datetime")
    for c, t in Rows.of(casted, times=times).times.items() if times else ():
        out[c].first, out[c].last, out[c].frequency = frequency(t)
    if of("text"):
        for r in profile.text_lengths(casted, of("text")).collect():
            out[r["column"]].stats = {"mean_length": r["mean_length"], "max_length": r["max_length"]}
    return list(out.values())


def number_stats(v: np.ndarray) -> dict:
    """n, min, max, mean, median, std, q25, q75 (nearest rank) and skew of sorted finite values."""
    if not len(v):
        return {}
    nearest = lambda q: float(v[math.floor((len(v) - 1) * q + 0.5)])
    off = v - v.mean()
    m2 = float((off**2).mean())
    skew = float((off**3).mean()) / m2**1.5 if m2 > 0 else None
    return {"n": len(v), "min": float(v[0]), "max": float(v[-1]), "mean": float(v.mean()), "median": quantile(v, 0.5), "std": spread(v), "q25": nearest(0.25), "q75": nearest(0.75), "skew": skew}


def frequency(t: np.ndarray) -> tuple[str | None, str | None, str]:
    """First and last time and the cadence that the median gap between distinct times shows."""
    t = np.unique(t[~np.isnat(t)])
    if not len(t):
        return None, None, "unknown"
    written = lambda v: str(v.astype("datetime64[us]").astype(object))
    gap = float(np.median(np.diff(t).astype(np.int64))) / 8.64e10 if len(t) > 2 else None
    named = next((name for lo, hi, name in CADENCES if gap is not None and lo <= gap <= hi), "irregular")
    return written(t[0]), written(t[-1]), "unknown" if gap is None else named


def _count_quality(raw: DataFrame, casted: DataFrame, out: dict[str, Column], nums: list[str]) -> None:
    """Missing, token and invalid rows of numeric columns in one pass over raw and cast values."""
    exprs = []
    for c in nums:
        text = out[c].dtype == "string"
        col = F.col(f"`{c}`")
        token = typing.missing_token(col) if text else F.lit(False)
        good = typing.numeric_cast(col, out[c].cast).isNotNull() if text else finite(raw, c).isNotNull()
        exprs.append(F.struct(F.count_if(col.isNull()).alias("missing"), F.count_if(col.isNotNull() & token).alias("tokens"), F.count_if(col.isNotNull() & ~token & ~good).alias("invalid"), F.avg(good.cast("double")).alias("valid")).alias(c))
    row = raw.agg(*exprs).first()
    for c in nums:
        q, x = out[c].quality, row[c]
        q.missing, q.tokens, q.invalid, q.valid_ratio = x["missing"], x["tokens"], x["invalid"], x["valid"]


def of_all_rows(df: DataFrame, sampled: Profile) -> Profile:
    """The sample's profile with what confidence and probes ask of it counted over all rows of ``df``.

    Quality, categories, correlations and group effects are of all rows; types, casts, distinct
    values and definitions stay those of the sample, and other evidence is left out.
    """
    casted = typing.apply_casts(df, {c.name: c.cast for c in sampled.columns})
    columns = {c.name: replace(c) for c in sampled.columns}
    nums = [c for c in columns if columns[c].semantic == "numeric"]
    cats = [c for c in columns if columns[c].semantic in ("categorical", "boolean")]
    for c in nums:
        columns[c].quality = Quality(**(robust.quality_of_table(casted, c) or {}))
    if nums:
        _count_quality(df, casted, columns, nums)
    if cats:
        top = sorted(profile.top_categories(casted, cats).collect(), key=lambda r: (-r["n"], r["value"]))
        lists = {r["column"]: r for r in profile.category_lists(casted, cats).collect()}
        for c in cats:
            columns[c].top_values = [(r["value"], r["n"]) for r in top if r["column"] == c]
            if c in lists:
                columns[c].n_categories, columns[c].labels = lists[c]["n_categories"], lists[c]["labels"]
    out = Profile(sampled.dataset_id, sampled.n_rows, sampled.n_rows, list(columns.values()))
    held = Whole.of(casted, nums, [c.name for c in eligible(out.columns)])
    if len(nums) >= 2:
        out.pearson = held.pearson(nums[:MATRIX])
    out.evidence = {k: sampled.evidence[k] for k in ("derived", "near_duplicates")}
    out.evidence["cat_num"] = group_effects(held.moments(held.cats, nums[:MATRIX])) if held.cats and nums else []
    return out


# --- evidence ------------------------------------------------------------------------


def _evidence(df: DataFrame, out: Profile) -> None:
    nums = [c for c in out.columns if c.semantic == "numeric"]
    names = [c.name for c in nums][:MATRIX]
    cats = eligible(out.columns)
    times = [c for c in out.columns if c.semantic == "datetime"]
    rows = Rows.of(df, names, [c.name for c in cats], [c.name for c in times])
    if len(names) >= 2:
        out.pearson = rows.pearson(names)
        out.spearman = {pair: r for pair, (r, _) in rows.pearson(names, ranked=True).items()}
    e = out.evidence
    moments = rows.moments(rows.cats, names)
    e["cat_num"] = group_effects(moments)
    e["derived"] = dependence.identities(df, out, names)
    e["near_duplicates"] = dependence.near_duplicates(out, names, NEAR_RHO, NAMED_RHO, NEAR_ROWS)
    copies = {d for g in e["near_duplicates"] for d in g["duplicates"]}
    e["derived"] += dependence.near_copies(e["near_duplicates"])
    e["dispersion"], buckets = dependence.dispersion(rows, cats, names, e["derived"])
    e["derived"] += buckets
    e["time_effects"] = []
    for t in times:
        e["time_effects"] += _time_effects(rows, t, names)
    e["interactions"] = dependence.interactions(rows, cats, names, times, e["cat_num"], out.pearson, INTERACTION_CATS, INTERACTION_NUMS)
    e["slopes"] = _slopes(rows, cats, out)
    e["correlation_tests"] = _correlation_tests(rows, out, names, times)
    definitional = {frozenset((d["target"], c)) for d in e["derived"] for c in d["components"]}
    used = [c for c in nums if c.name in names and c.name not in copies]
    curves.layer2(rows, out, used, cats, times, definitional)
    apply_fdr(out)


def eligible(columns: list[Column]) -> list[Column]:
    """Categories with 2 to 20 levels; beyond fifteen the ones with fewest levels."""
    found = [c for c in columns if c.semantic in ("categorical", "boolean") and CAT_LEVELS[0] <= (c.n_categories or 0) <= CAT_LEVELS[1]]
    return found if len(found) <= CATS else sorted(found, key=lambda c: (c.n_categories, c.name))[:CATS]


def group_effects(moments: list[dict]) -> list[dict]:
    """Adjusted eta squared and ANOVA p of every (cat, num) from level moments."""
    pairs: dict[tuple[str, str], list[dict]] = {}
    for m in moments:
        pairs.setdefault((m["cat"], m["num"]), []).append(m)
    out = []
    for (cat, num), rows in sorted(pairs.items()):
        n, k = sum(m["n"] for m in rows), len(rows)
        grand = sum(m["n"] * m["mean"] for m in rows) / n
        between = sum(m["n"] * (m["mean"] - grand) ** 2 for m in rows)
        within = sum(m["m2"] or 0.0 for m in rows)
        eta = tails.adjusted_eta(between, within, k, n)
        if eta is not None:
            out.append({"cat": cat, "num": num, "eta_squared": eta, "n_groups": k, "n_total": n, "n_min": min(m["n"] for m in rows), "group_counts": {m["level"]: m["n"] for m in rows}, "p_value": tails.anova_p(between, within, k, n)})
    return out


def _time_effects(rows: Rows, t: Column, names: list[str]) -> list[dict]:
    if not names or not t.first:
        return []
    moments = rows.moments({u: rows.bucket(t.name, u) for u in TIME_UNITS}, names)
    found = {(x["cat"], x["num"]): x for x in group_effects(moments)}
    start, out = span_unit(curves.span_days(t)), []
    for num in names:
        unit: str | None = start
        while unit and (unit, num) not in found:
            unit = coarser(unit)
        if unit:
            x = found[unit, num]
            out.append({"datetime": t.name, "num": num, "eta_squared": x["eta_squared"], "bucket": unit, "n_total": x["n_total"], "n_min": x["n_min"], "p_value": x["p_value"]})
    return out


def _slopes(rows: Rows, cats: list[Column], out: Profile) -> list[dict]:
    """Pairs that correlate overall, within the groups of the strongest categories."""
    pairs = sorted(((a, b) for (a, b), (r, _) in out.pearson.items() if r is not None and abs(r) >= SLOPE_R), key=lambda p: (-abs(out.pearson[p][0]), p))[:SLOPE_PAIRS]
    best: dict[str, float] = {}
    for x in out.evidence["cat_num"]:
        best[x["cat"]] = max(best.get(x["cat"], 0.0), x["eta_squared"])
    groups = sorted((c.name for c in cats if SLOPE_LEVELS[0] <= (c.n_categories or 0) <= SLOPE_LEVELS[1]), key=lambda c: (-best.get(c, 0.0), c))[:SLOPE_CATS]
    result = []
    for g in groups if pairs else []:
        by: dict[tuple[str, str], list] = {}
        for r in rows.group_correlations(g, pairs):
            if r["corr"] is not None:
                by.setdefault((r["x"], r["y"]), []).append((r["level"], r["corr"], r["n"]))
        for (x, y), own in sorted(by.items()):
            if len(own) >= 2:
                rs, ns = [r for _, r, _ in own], [n for _, _, n in own]
                result.append({"x": x, "y": y, "group": g, "corrs": {v: r for v, r, _ in own}, "spread": max(rs) - min(rs), "n_min": min(ns), "p_value": tails.homogeneity_p(rs, ns)})
    return result


def _correlation_tests(rows: Rows, out: Profile, names: list[str], times: list[Column]) -> list[dict]:
    """Correlations with effective sizes in the order of the fullest time column."""
    rho: dict[str, float | None] = {}
    if times and names:
        t = max(times, key=lambda c: (-c.missing_count, c.name))
        timed = rows.where(~np.isnat(rows.times[t.name]))
        rho = {n: timed.lag1([t.name, *names], n) for n in names}
    result = []
    for (a, b), (r, n) in sorted(out.pearson.items()):
        if r is None or n < 4:
            continue
        n_eff = tails.effective_n(n, rho.get(a), rho.get(b))
        s = out.spearman.get((a, b))
        result.append({"a": a, "b": b, "r": r, "n": n, "n_eff": n_eff, "autocorr_a": rho.get(a), "autocorr_b": rho.get(b), "p_value": tails.correlation_p(r, n_eff), "rho": s, "p_value_spearman": None if s is None else tails.correlation_p(s, n_eff)})
    return result


def apply_fdr(out: Profile, q: float = FDR_Q) -> None:
    """One Benjamini-Hochberg family over every test of both layers."""
    tests = [(x, "p_value", "discovery") for kind in ("cat_num", "time_effects", "interactions", "slopes", "nonlinear", "conditional") for x in out.evidence.get(kind, [])]
    tests += [(x, "p_value", "discovery") for x in out.evidence["dispersion"]]
    tests += [(x, p, d) for x in out.evidence["correlation_tests"] for p, d in (("p_value", "discovery"), ("p_value_spearman", "discovery_spearman"))]
    tests += [(x, "p_every_group", "discovery_every_group") for x in out.evidence.get("conditional", [])]
    values = [x.get(p) for x, p, _ in tests]
    values = [v if v is not None and math.isfinite(v) else None for v in values]
    found = tails.benjamini_hochberg(values, q)
    for (x, p, d), v, hit in zip(tests, values, found):
        x[d] = hit if v is not None else None
    out.fdr = {"q": q, "m": sum(v is not None for v in values), "discoveries": sum(found)}
