"""From roles and evidence to the question a chart answers, and the charts that may answer it."""

from __future__ import annotations

from dataclasses import dataclass

from plumbline.plans.model import Spec
from plumbline.plans.roles import Role
from plumbline.plans.spec import CATEGORY_AXIS

RAINCLOUD, RIDGE, DENSE = 8, (3, 12), 30
LOLLIPOP, RANKING, DUMBBELL, SLOPEGRAPH = 12, 13, 3, 12
HEX_ROWS, HEX_OPTION = 2000, 300
POLAR_LEAST, POLAR_PERIOD, DOT_ROWS = 4, 60, 5
PARTS, WHOLES, NODES = (2, 8), (2, 20), (2, 20)
SPREAD_TYPES = ("box", "violin", "raincloud", "ridgeline", "dot_interval")


@dataclass(frozen=True)
class Context:
    rows: int = 0
    groups: int = 0
    least_group: int = 0
    parts: int = 0
    spread_differs: bool = False
    counting: bool = False
    magnitude: bool = False
    ranking: bool = False
    part_to_whole: bool = False
    flow: bool = False


def classify(x: Role | None, y: Role | None, group: Role | None, ctx: Context) -> str | None:
    """One of the eleven intents; None where the roles make no question."""
    measure = y is not None and (y.role == "numeric" or y.role == "ordinal" and y.order is None)
    if x and group and x.category and group.category and (ctx.counting or y is not None and y.role == "numeric"):
        if ctx.flow:
            return "flow"
        if ctx.part_to_whole:
            return "composition"
    if x is None:
        return "distribution" if y is not None and y.role == "numeric" and group is None else None
    if not measure:
        return None
    if x.role in ("datetime", "numeric"):
        return "trend" if x.role == "datetime" else "numeric_relationship"
    crossed = group is not None and group.category and group.ordered and not ctx.counting
    if x.cyclic:
        if crossed:
            return "matrix_pattern"
        return "distribution_by_group" if ctx.spread_differs and not ctx.counting else "cyclic_pattern"
    if group is not None and group.two_state and ctx.groups >= DUMBBELL and not ctx.counting:
        return "two_state_comparison"
    if crossed and x.ordered:
        return "matrix_pattern"
    if ctx.ranking:
        return "ranking"
    if ctx.spread_differs and not ctx.counting:
        return "distribution_by_group"
    return "ranking" if x.role == "nominal" and ctx.groups >= RANKING else "group_comparison"


def eligible(intent: str, x: Role | None, ctx: Context) -> list[str]:
    """Charts that may show the intent, the clearest first."""
    dense = ctx.rows >= DENSE and ctx.least_group >= DENSE
    turn = x is not None and x.cyclic and x.period is not None and ctx.groups >= POLAR_LEAST and x.period <= POLAR_PERIOD
    within = lambda n, span: span[0] <= n <= span[1]
    options = {
        "distribution": [("histogram", True), ("box", True), ("violin", ctx.rows >= DENSE)],
        "distribution_by_group": [("raincloud", dense and within(ctx.groups, (2, RAINCLOUD))), ("ridgeline", dense and x is not None and x.ordered and within(ctx.groups, RIDGE)), ("box", True), ("violin", dense and ctx.groups <= RIDGE[1])],
        "group_comparison": [("lollipop", ctx.groups >= LOLLIPOP), ("bar", True), ("dot_interval", not ctx.counting and ctx.least_group >= DOT_ROWS), ("box", not ctx.counting and ctx.groups <= RIDGE[1])],
        "ranking": [("lollipop", ctx.groups >= LOLLIPOP), ("bar", True), ("lollipop", ctx.groups < LOLLIPOP)],
        "numeric_relationship": [("hexbin", ctx.rows > HEX_ROWS), ("scatter", True), ("hexbin", HEX_OPTION <= ctx.rows <= HEX_ROWS)],
        "trend": [("line", True)],
        "cyclic_pattern": [("line", True), ("polar_line", turn), ("rose", turn and ctx.magnitude), ("bar", ctx.counting or ctx.magnitude)],
        "two_state_comparison": [("dumbbell", True), ("slopegraph", ctx.groups <= SLOPEGRAPH), ("bar", True)],
        "matrix_pattern": [("heatmap", True)],
        "composition": [(t, within(ctx.parts, PARTS) and within(ctx.groups, WHOLES)) for t in ("stacked_bar", "bar")],
        "flow": [("sankey", within(ctx.groups, NODES) and within(ctx.parts, NODES))],
    }
    return [t for t, allowed in options[intent] if allowed]


def choose(intent: str, x: Role | None, ctx: Context, hint: str | None = None) -> tuple[list[str], str | None] | None:
    """(charts, preferred first; category order), or None; a hint moves an eligible chart to the front and no other."""
    charts = eligible(intent, x, ctx)
    if not charts:
        return None
    if hint in charts:
        charts = [hint, *(t for t in charts if t != hint)]
    order = "value" if intent == "ranking" else "natural" if x is not None and x.category and charts[0] in CATEGORY_AXIS else None
    return charts, order


def variant(spec: Spec, kind: str, intent: str, order: str | None) -> Spec:
    """The same finding as another chart, with the fields that chart has."""
    order = order if kind in CATEGORY_AXIS else None
    if kind == spec.type:
        return spec if spec.sort is not None or order is None else spec.with_(sort=order)
    out = spec.with_(type=kind, sort=order, top_n=None, percent=spec.percent if kind == "stacked_bar" else None)
    if kind in ("stacked_bar", "sankey"):
        return out.with_(aggregation="count" if spec.y is None else "sum")
    if kind in SPREAD_TYPES:
        return out.with_(aggregation=None, group_by=None)
    if kind in ("scatter", "hexbin"):
        return out.with_(aggregation=None)
    default = "count" if spec.y is None and kind in ("bar", "lollipop", "polar_line", "rose") else "mean"
    out = out.with_(aggregation=spec.aggregation or default)
    alone = kind in ("polar_line", "rose") or kind == "line" and intent == "cyclic_pattern"
    return out.with_(group_by=None) if alone else out
