"""Validation of chart specifications: every violation, from a table of what each type asks for."""

from __future__ import annotations

from dataclasses import dataclass

from plumbline.plans.model import Column, Profile, Spec
from plumbline.plans.roles import is_number, role_of

AGGREGATIONS = ("mean", "sum", "count", "median", "min", "max")
GRANULARITIES = ("raw", "day", "week", "month")
BANNED = ("id", "unknown", "text")
BINS, TOP_N, GROUPS = (5, 200), (3, 50), 20
CATEGORY_AXIS = frozenset("bar lollipop box violin raincloud ridgeline dot_interval dumbbell slopegraph polar_line rose line stacked_bar".split())


@dataclass(frozen=True)
class Rule:
    """x: kind of the x axis and whether it must be given; y: whether a measure is needed; and so on."""

    x: str | None = "category"
    x_needed: bool = True
    x_range: tuple[int, int] | None = None
    y: str = "measure"  # measure (needed), numeric (needed, no codes), countable (or a count), none
    group: str = "any"  # any, none, two, parts
    group_range: tuple[int, int] | None = None
    aggregation: str = "any"  # any, none, needed, mean, additive


RULES = {
    "line": Rule("axis", y="measure"),
    "bar": Rule(y="countable"),
    "lollipop": Rule(y="countable"),
    "scatter": Rule("numeric", y="numeric", aggregation="none"),
    "hexbin": Rule("numeric", y="numeric", group="none", aggregation="none"),
    "histogram": Rule("numeric", y="none", aggregation="none"),
    "box": Rule(x_needed=False, x_range=(2, 50), group="none", aggregation="none"),
    "violin": Rule(x_needed=False, x_range=(2, 50), group="none", aggregation="none"),
    "raincloud": Rule(x_range=(2, 8), group="none", aggregation="none"),
    "ridgeline": Rule(x_range=(2, 12), group="none", aggregation="none"),
    "dot_interval": Rule(x_range=(2, 50), group="none", aggregation="mean"),
    "dumbbell": Rule(x_range=(2, 50), group="two", aggregation="needed"),
    "slopegraph": Rule(x_range=(2, 50), group="two", aggregation="needed"),
    "polar_line": Rule("cyclic", y="countable", group="none"),
    "rose": Rule("cyclic", y="countable", group="none", aggregation="additive"),
    "stacked_bar": Rule(x_range=(2, 20), y="countable", group="parts", group_range=(2, 8), aggregation="additive"),
    "sankey": Rule(x_range=(2, 20), y="countable", group="parts", group_range=(2, 20), aggregation="additive"),
    "heatmap": Rule(None),
}
TYPES = tuple(RULES)
POLAR_MOST = 60


def groupable(c: Column) -> bool:
    return c.semantic in ("categorical", "boolean")


def measurable(c: Column) -> bool:
    """Numbers, and coded categories whose numbers are not labels."""
    return c.semantic == "numeric" or c.semantic == "categorical" and not c.nominal and is_number(c)


def categories(c: Column) -> int:
    return c.n_categories if c.n_categories is not None else c.unique_count


def _between(n: int, span: tuple[int, int]) -> bool:
    return span[0] <= n <= span[1]


def _x_errors(spec: Spec, rule: Rule, c: Column) -> list[str]:
    name, out = f"x column '{c.name}'", []
    if rule.x == "numeric" and c.semantic != "numeric":
        out.append(f"{spec.type} {name} must be numeric")
    elif rule.x == "axis":
        ordered = groupable(c) and role_of(c).ordered
        if c.semantic not in ("datetime", "numeric") and not ordered:
            out.append(f"line {name} must be datetime, numeric or an ordered category")
    elif rule.x == "cyclic":
        if not role_of(c).cyclic:
            out.append(f"{spec.type} {name} must be cyclic")
        elif c.semantic == "categorical" and categories(c) > POLAR_MOST:
            out.append(f"{spec.type} {name} has too many categories")
    elif rule.x == "category":
        if not groupable(c):
            out.append(f"{spec.type} {name} must be categorical or boolean")
        elif rule.x_range and not _between(categories(c), rule.x_range):
            out.append(f"{spec.type} {name} must have {rule.x_range[0]}..{rule.x_range[1]} categories, has {categories(c)}")
    return out


def _line_errors(spec: Spec, profile: Profile, x: Column | None) -> list[str]:
    if x is None:
        return []
    if spec.time_granularity is not None and x.semantic != "datetime":
        return ["time_granularity requires a datetime x column"]
    if spec.aggregation is not None:
        return []
    if x.semantic in ("categorical", "boolean"):
        return ["aggregation is required when a line's x is a category"]
    if spec.time_granularity not in (None, "raw"):
        return ["aggregation is required when time_granularity is coarser than raw"]
    if x.unique_count < profile.n_rows - x.missing_count:
        return [f"aggregation is required: x column '{x.name}' has duplicate values"]
    return []


def _heatmap_errors(spec: Spec, profile: Profile, cols: dict[str, Column | None]) -> list[str]:
    given = [r for r in ("x", "y", "group_by", "aggregation") if getattr(spec, r) is not None]
    if not given:
        return [] if sum(c.semantic == "numeric" for c in profile.columns) >= 2 else ["heatmap requires at least 2 numeric columns in the dataset"]
    out = [] if len(given) == 4 else ["heatmap is a correlation matrix (no fields) or a matrix of x, group_by, y and aggregation"]
    for role in ("x", "group_by"):
        c = cols[role]
        if c is None:
            continue
        cyclic = role_of(c).cyclic
        if not groupable(c) and not cyclic:
            out.append(f"heatmap {role} column '{c.name}' must be categorical or cyclic")
        elif role == "x" and not cyclic and categories(c) > GROUPS:
            out.append(f"heatmap x column '{c.name}' has {categories(c)} categories (maximum {GROUPS})")
    if cols["y"] is not None and not measurable(cols["y"]):
        out.append(f"heatmap y column '{cols['y'].name}' must be numeric")
    return out


def validate(spec: Spec, profile: Profile) -> list[str]:
    """Every reason why ``spec`` cannot be drawn from this profile; empty where it can."""
    if spec.type not in RULES:
        return [f"unknown chart type '{spec.type}'"]
    rule, out, cols = RULES[spec.type], [], {}
    for role in ("x", "y", "group_by"):
        name = getattr(spec, role)
        c = profile.column(name)
        if name is not None and c is None:
            out.append(f"{role} column '{name}' does not exist")
        elif c is not None and c.semantic in BANNED:
            out.append(f"{role} column '{name}' has semantic type '{c.semantic}' and cannot be used as a chart axis")
            c = None
        cols[role] = c
    named = [(r, getattr(spec, r)) for r in ("x", "y", "group_by") if getattr(spec, r) is not None]
    out += [f"{a} and {b} must be different columns (both '{n}')" for i, (a, n) in enumerate(named) for b, m in named[i + 1 :] if n == m]
    if spec.aggregation is not None and spec.aggregation not in AGGREGATIONS:
        out.append(f"unknown aggregation '{spec.aggregation}'")
    x, y, group = cols["x"], cols["y"], cols["group_by"]
    if group is not None and spec.type != "heatmap":
        if not groupable(group):
            out.append(f"group_by column '{group.name}' must be categorical or boolean")
        elif categories(group) > GROUPS:
            out.append(f"group_by column '{group.name}' has {categories(group)} categories (maximum {GROUPS})")

    for option, allowed in (("bins", ("histogram",)), ("top_n", ("bar", "lollipop")), ("time_granularity", ("line",)), ("sort", CATEGORY_AXIS), ("percent", ("stacked_bar",))):
        value = getattr(spec, option)
        if value is not None and spec.type not in allowed:
            out.append(f"{option} is not valid for {spec.type}")
        elif value is not None and option in ("bins", "top_n"):
            span = BINS if option == "bins" else TOP_N
            if not _between(value, span):
                out.append(f"{option} must be within {span[0]}..{span[1]}")
    if spec.time_granularity is not None and spec.time_granularity not in GRANULARITIES:
        out.append(f"unknown time_granularity '{spec.time_granularity}'")
    if spec.type == "heatmap":
        return out + _heatmap_errors(spec, profile, cols)

    if spec.x is None and rule.x_needed:
        out.append(f"{spec.type} requires x")
    if x is not None:
        out += _x_errors(spec, rule, x)
    if rule.y == "none" and spec.y is not None:
        out.append(f"{spec.type} must not have y")
    elif rule.y in ("measure", "numeric") and spec.y is None:
        out.append(f"{spec.type} requires y")
    elif rule.y == "countable":
        if spec.y is None and spec.aggregation != "count":
            out.append(f"{spec.type} without y requires aggregation 'count'")
        elif spec.y is not None and spec.aggregation is None:
            out.append(f"{spec.type} requires aggregation when y is given")
    if y is not None and rule.y != "none" and not (y.semantic == "numeric" if rule.y == "numeric" else measurable(y)):
        out.append(f"{spec.type} y column '{y.name}' must be numeric")
    if rule.group == "none" and spec.group_by is not None:
        out.append(f"{spec.type} must not have group_by")
    elif rule.group in ("two", "parts") and spec.group_by is None:
        out.append(f"{spec.type} requires group_by")
    elif rule.group == "two" and group is not None and categories(group) != 2:
        out.append(f"{spec.type} group_by column '{group.name}' must have exactly 2 categories, has {categories(group)}")
    elif rule.group_range and group is not None and groupable(group) and not _between(categories(group), rule.group_range):
        out.append(f"{spec.type} group_by column '{group.name}' must have {rule.group_range[0]}..{rule.group_range[1]} categories, has {categories(group)}")
    if rule.aggregation == "none" and spec.aggregation is not None:
        out.append(f"{spec.type} must not have an aggregation")
    elif rule.aggregation == "needed" and spec.aggregation is None:
        out.append(f"{spec.type} requires aggregation")
    elif rule.aggregation == "mean" and spec.aggregation not in (None, "mean"):
        out.append(f"{spec.type} shows the mean: aggregation must be omitted or 'mean'")
    elif rule.aggregation == "additive" and spec.y is not None and spec.aggregation is not None and spec.aggregation not in ("sum", "count"):
        out.append(f"{spec.type} adds its parts up: aggregation must be 'sum' or 'count'")
    if spec.type == "line":
        out += _line_errors(spec, profile, x)
    return out
