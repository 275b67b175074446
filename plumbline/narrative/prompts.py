"""Bounded prompts: summaries of a profile, never more than a few entries of each kind."""

from __future__ import annotations

import json

from plumbline.operators.probes import ROLES
from plumbline.plans.model import Profile, Recommendation
from plumbline.plans.roles import role_of

#: Part of the key of kept reports: changed with every change of a prompt.
VERSION = 1

COLUMNS, PAIRS, PER_KIND, ROWS, CELL = 40, 8, 3, 5, 100

TASK = """You propose hypotheses about one table. Answer with a JSON object {"hypotheses": [...], "charts": [...]}.
A hypothesis has: statement (one English sentence), test (a test name or null), columns (role to column), importance (1 to 5),
and optionally chart (type, x, y, group_by, aggregation). You never compute statistics; the listed tests are run for you."""
WORDING = """You phrase verified findings. Answer with a JSON object {"insights": [{"id": ..., "headline": ..., "text": ...}]}.
Say only what the facts of a finding say, in one or two English sentences, without causes, advice or numbers of your own."""


def describe(profile: Profile, values: bool) -> dict:
    """Columns and the strongest evidence; labels and extremes of columns only where ``values`` may be seen."""
    columns = []
    for c in profile.columns[:COLUMNS]:
        x = {"name": c.name, "type": c.semantic, "role": role_of(c).role, "missing": round(c.missing_ratio, 3)}
        if c.n_categories:
            x["categories"] = c.n_categories
        if values and c.top_values:
            x["examples"] = [v[:CELL] for v, _ in c.top_values[:ROWS]]
        if c.semantic == "numeric":
            x |= {k: c.stats.get(k) for k in ("mean", "std")}
        columns.append(x)
    e = profile.evidence
    pairs = sorted(((abs(r), a, b, r) for (a, b), (r, _) in profile.pearson.items() if r is not None), reverse=True)[:PAIRS]
    effects = sorted(e.get("cat_num", []), key=lambda m: -m["eta_squared"])[:PAIRS]
    out = {"rows": profile.n_rows, "columns": columns, "correlations": [{"a": a, "b": b, "r": round(r, 3)} for _, a, b, r in pairs], "group_effects": [{"group": m["cat"], "target": m["num"], "eta_squared": round(m["eta_squared"], 3)} for m in effects]}
    for kind, keys in (("nonlinear", ("x", "y", "shape")), ("conditional", ("x", "y", "group", "corr_spread")), ("change_points", ("datetime", "num", "strength")), ("derived", ("target", "formula")), ("near_duplicates", ("representative", "duplicates"))):
        out[kind] = [{k: m[k] for k in keys} for m in e.get(kind, [])[:PER_KIND]]
    return out


def hypothesis_messages(profile: Profile, rules: list[Recommendation], values: bool, sample: list[dict] | None = None) -> list[dict[str, str]]:
    tests = {t: {"roles": list(n), "optional": list(o)} for t, (n, o) in ROLES.items()}
    body = {"table": describe(profile, values), "tests": tests, "charts_so_far": [r.spec.title for r in rules]}
    if values and sample:
        body["sample_rows"] = [{k: str(v)[:CELL] for k, v in r.items()} for r in sample[:ROWS]]
    return [{"role": "system", "content": TASK}, {"role": "user", "content": json.dumps(body, ensure_ascii=False, default=str)}]


def wording_messages(findings: list[dict]) -> list[dict[str, str]]:
    return [{"role": "system", "content": WORDING}, {"role": "user", "content": json.dumps({"findings": findings}, ensure_ascii=False, default=str)}]
