"""What was verified, as facts, and the sentence those facts make without any model."""

from __future__ import annotations

from dataclasses import dataclass, field

NO_DIRECTION = 0.10
SHAPES = {"u_shape": "U-shaped", "inverted_u": "an inverted U", "multi_peak": "several peaks", "monotone_nonlinear": "monotone but not straight", "linear": "linear"}


def show(v: float) -> str:
    return f"{v:,.0f}" if abs(v) >= 1000 else f"{v:.3g}"


@dataclass
class Claim:
    """One finding: its columns, the facts about groups in order, and which words they can bear."""

    test: str
    columns: dict[str, str]
    groups: list[tuple[str, float]] = field(default_factory=list)  # (label, value), the largest value first
    measure: str = ""
    direction: str | None = None  # positive, negative, mixed, none
    universal: bool = False  # holds in every group
    reversed_overall: bool = False  # the pooled correlation points against every group
    shape: str | None = None
    change: tuple[float, float, str] | None = None  # before, after, when
    pair: tuple[str, str] | None = None
    numbers: set[float] = field(default_factory=set)  # what may be quoted

    @property
    def labels(self) -> list[str]:
        return [g for g, _ in self.groups]


def claim_of(test: str, columns: dict[str, str], evidence: dict, effect: float, pooled_r: float | None = None) -> Claim:
    """The claim that a probe's (or a profile's) evidence supports."""
    out = Claim(test, dict(columns), numbers={effect})
    rows = evidence.get("groups") or []
    if test in ("group_difference", "distribution_difference"):
        key = "mean" if test == "group_difference" else "median"
        out.measure = key
        out.groups = sorted(((r["level"], r[key]) for r in rows if r.get(key) is not None), key=lambda g: (-g[1], g[0]))
        if test == "distribution_difference" and evidence.get("most_different"):
            out.pair = tuple(evidence["most_different"])
    elif test in ("grouped_relationship", "slope_difference"):
        out.measure = "correlation"
        out.groups = sorted(((r["level"], r["corr"]) for r in rows if r.get("corr") is not None), key=lambda g: (-g[1], g[0]))
        signs = {r > 0 for _, r in out.groups if abs(r) >= NO_DIRECTION}
        out.direction = "none" if not signs else "mixed" if len(signs) == 2 else "positive" if True in signs else "negative"
        out.universal = out.direction in ("positive", "negative") and all(abs(r) >= NO_DIRECTION for _, r in out.groups) and len(out.groups) == len(rows)
        out.reversed_overall = out.universal and pooled_r is not None and abs(pooled_r) >= NO_DIRECTION and (pooled_r > 0) != (out.direction == "positive")
        if pooled_r is not None:
            out.numbers.add(pooled_r)
    elif test == "nonlinear_relationship":
        out.shape = evidence.get("shape")
        means = [b["mean"] for b in evidence.get("bins", [])]
        if means:
            out.numbers |= {max(means), min(means)}
            if out.shape in ("linear", "monotone_nonlinear"):
                out.direction = "positive" if means[-1] > means[0] else "negative"
    elif test == "time_pattern":
        c = evidence.get("change_point")
        if c and c.get("strength") != "none" and c["before_mean"] != c["after_mean"]:
            out.change = (c["before_mean"], c["after_mean"], c["change_at"][:10])
            out.direction = "positive" if c["after_mean"] > c["before_mean"] else "negative"
            out.numbers |= {c["before_mean"], c["after_mean"]}
    out.numbers |= {v for _, v in out.groups} | {float(len(out.groups))}
    return out


def sentence(c: Claim) -> str:
    """The claim in words, from its facts alone."""
    k, g = c.columns, c.columns.get("group")
    if c.test in ("group_difference", "distribution_difference") and len(c.groups) >= 2:
        (top, hi), (low, lo) = c.groups[0], c.groups[-1]
        what = c.measure.capitalize()
        if show(hi) == show(lo):
            text = f"{what} {k['target']} is equal across the {len(c.groups)} {g} groups ({show(hi)})"
        else:
            text = f"{what} {k['target']} is highest for {g} {top} ({show(hi)}) and lowest for {g} {low} ({show(lo)})"
        return text + (f"; the distributions of {g} {c.pair[0]} and {g} {c.pair[1]} differ most." if c.pair else ".")
    if c.measure == "correlation" and c.groups:
        x, y = k["x"], k["y"]
        listed = lambda rows: ", ".join(f"{g} {v} (r = {show(r)})" for v, r in rows)
        up, down = [r for r in c.groups if r[1] >= NO_DIRECTION], [r for r in c.groups if r[1] <= -NO_DIRECTION]
        if c.direction == "mixed":
            return f"{x} and {y} move together in {listed(up)} but in opposite directions in {listed(down)}."
        if c.direction == "none":
            return f"{x} and {y} show no clear relationship in any {g} group."
        verb = "rises" if c.direction == "positive" else "falls"
        text = f"{y} {verb} with {x} within each of the {len(c.groups)} {g} groups" if c.universal else f"{y} {verb} with {x} in {listed(up or down)}"
        if c.test == "slope_difference":
            text += f"; strongest in {listed([max(c.groups, key=lambda r: abs(r[1]))])} and weakest in {listed([min(c.groups, key=lambda r: abs(r[1]))])}"
        return text + ("; over all rows together the correlation points the other way." if c.reversed_overall else ".")
    if c.test == "nonlinear_relationship" and c.shape:
        return f"{k['y']} varies with {k['x']} in a curve ({SHAPES.get(c.shape, 'curved')})."
    if c.change:
        return f"Mean {k['target']} {'rises' if c.direction == 'positive' else 'falls'} from {show(c.change[0])} to {show(c.change[1])} around {c.change[2]}."
    names = " and ".join(v for r, v in sorted(k.items()) if r not in ("target", "y"))
    return f"{k.get('target') or k.get('y')} depends on {names}."
