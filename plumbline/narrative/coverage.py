"""Answers that the profile's evidence already holds, so that no probe has to be run for them."""

from __future__ import annotations

from plumbline.operators.probes import ROWS, THRESHOLDS
from plumbline.plans.model import Profile
from plumbline.plans.recommend import Evidence, slope_threshold


def _verdict(effect: float, limits: tuple[float, float], found: bool | None) -> str:
    """By effect size; what was tested and is no discovery fails."""
    if found is False:
        return "fail"
    return "pass" if effect >= limits[0] else "weak" if effect >= limits[1] else "fail"


def covered(test: str, columns: dict[str, str], profile: Profile) -> dict | None:
    """{effect, n, verdict, evidence} where the evidence tables answer the test; None where it must be probed."""
    e, ev = Evidence(profile), profile.evidence
    limits = THRESHOLDS[test]
    if test == "group_difference":
        m = e.effect.get((columns["group"], columns["target"]))
        s = next((x for x in ev.get("group_summaries", []) if (x["cat"], x["num"]) == (columns["group"], columns["target"])), None)
        if m is None or s is None:
            return None
        return {"effect": m["eta_squared"], "n": m["n_total"], "n_min": m["n_min"], "verdict": _verdict(m["eta_squared"], limits, m.get("discovery")), "evidence": {"groups": s["groups"]}}
    if test in ("grouped_relationship", "slope_difference"):
        x, y = columns["x"], columns["y"]
        m = next((c for c in ev.get("conditional", []) if {c["x"], c["y"]} == {x, y} and c["group"] == columns["group"]), None)
        if m is None or test == "slope_difference" and m["x"] != x:
            return None
        rows = [{"level": g["group"], "n": g["n"], "corr": g["corr"]} for g in m["groups"]]
        rs = [r["corr"] for r in rows if r["corr"] is not None]
        if test == "slope_difference":
            bar = slope_threshold(m["n_min"])
            effect, limits, found = m["corr_spread"], (bar, bar / 2), m.get("discovery")
        else:
            effect, found = min(map(abs, rs)), m.get("discovery_every_group")
        return {"effect": effect, "n": sum(r["n"] for r in rows), "n_min": m["n_min"], "verdict": _verdict(effect, limits, found), "evidence": {"groups": rows}}
    if test == "nonlinear_relationship":
        m = next((c for c in ev.get("nonlinear", []) if (c["x"], c["y"]) == (columns["x"], columns["y"])), None)
        return m and {"effect": m["nonlinear_gap"], "n": m["n"], "n_min": None, "verdict": _verdict(m["nonlinear_gap"], limits, m.get("discovery")), "evidence": m}
    if test == "time_pattern" and "group" not in columns:
        m = e.time.get((columns["time"], columns["target"]))
        if m is None:
            return None
        change = next((c for c in ev.get("change_points", []) if (c["datetime"], c["num"]) == (columns["time"], columns["target"])), None)
        effect = max(m["eta_squared"], limits[0]) if change and change["flagged"] else m["eta_squared"]
        found = None if change and change["flagged"] else m.get("discovery")
        return {"effect": effect, "n": m["n_total"], "n_min": None, "verdict": _verdict(effect, limits, found), "evidence": {"bucket": m["bucket"], "change_point": change}}
    if test == "interaction":
        strength = e.mix.get((columns["factor1"], columns["factor2"], columns["target"]))
        if strength is None:
            return None
        return {"effect": strength, "n": profile.profiled_rows, "n_min": None, "verdict": _verdict(strength, limits, e.mix_found.get((columns["factor1"], columns["factor2"], columns["target"]))), "evidence": {}}
    return None


#: Fixed value: a correlation that counts as a relationship inside a group.
GROUP_CORRELATION = 0.30


def uncorroborated(test: str, columns: dict[str, str], verdict: str, evidence: dict, profile: Profile) -> str | None:
    """Why a finding from the largest of many comparisons needs more than itself; None where it has it, or needs nothing.

    A weak distance of distributions needs means that differ at least weakly; a
    spread of correlations needs one group with a correlation worth the name.
    """
    rows = evidence.get("groups") or []
    if test == "slope_difference":
        strongest = max((abs(r["corr"]) for r in rows if r.get("corr") is not None), default=0.0)
        return None if strongest >= GROUP_CORRELATION else f"correlations differ, but none is over {GROUP_CORRELATION:g} (strongest {strongest:.2f})"
    if test == "distribution_difference" and verdict == "weak":
        found = Evidence(profile).effect.get((columns["group"], columns["target"]))
        eta = found["eta_squared"] if found else 0.0
        return None if eta >= THRESHOLDS["group_difference"][1] else f"distributions differ weakly, and their means do not (eta squared {eta:.3f})"
    return None


def capped(hit: dict, overall: float) -> dict:
    """A pass becomes weak on little confidence or few rows."""
    low = overall < 0.5 or hit["n"] < ROWS or hit["n_min"] is not None and hit["n_min"] < ROWS
    return hit | {"verdict": "weak"} if hit["verdict"] == "pass" and low else hit
