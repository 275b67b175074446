"""Chart specifications to small payloads: one reduction of the full table, assembled on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.exprs import TIMES, kind_of, label
from plumbline.operators import charts, gaps, sampling
from plumbline.plans.confidence import sentinels
from plumbline.plans.model import Profile, Spec
from plumbline.plans.recommend import granularity
from plumbline.plans.roles import in_order, role_of
from plumbline.plans.spec import validate

MOST_POINTS, LINE_POINTS, SCATTER_POINTS = 50_000, 10_000, 10_000
OUTLIERS, RAIN = 100, 200
POLAR = 60


class RenderError(ValueError):
    """What a specification violates."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def plain(v):
    """JSON's idea of a value: no NaN or infinity, times as ISO text."""
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    return v.isoformat() if isinstance(v, (date, datetime)) else v


def text(v) -> str:
    return str(v)


def y_label(spec: Spec) -> str:
    if spec.type == "histogram" or spec.aggregation == "count":
        return "count"
    if spec.type == "heatmap" and spec.aggregation is None:
        return "correlation"
    return f"{spec.aggregation}({spec.y})" if spec.aggregation else spec.y or ""


class Rendering:
    """One chart on one table."""

    def __init__(self, df: DataFrame, spec: Spec, profile: Profile):
        self.df, self.spec, self.profile = df, spec, profile
        self.sampled, self.display_range = False, None

    def role(self, name: str | None):
        c = self.profile.column(name)
        return role_of(c) if c else None

    def natural(self, name: str) -> bool:
        role = self.role(name)
        return self.spec.sort == "natural" or self.spec.sort != "value" and role is not None and role.ordered

    def ordered(self, values, name: str) -> list:
        return in_order(values, self.role(name)) if self.natural(name) else sorted(values, key=text)

    # --- types ---------------------------------------------------------------------------

    def line(self) -> tuple[dict, int]:
        spec, df = self.spec, charts.clean(self.df, [self.spec.x, self.spec.y, self.spec.group_by], [self.spec.y])
        temporal = isinstance(kind_of(df, spec.x), TIMES)
        unit, how = spec.time_granularity, spec.aggregation
        if temporal and unit in (None, "raw"):
            row = df.agg(F.count("*").alias("rows"), F.count_distinct(*(F.struct(c) for c in (spec.x, spec.group_by) if c)).alias("keys"), F.count_distinct(spec.x).alias("x"), ((F.max(spec.x).cast("timestamp").cast("double") - F.min(spec.x).cast("timestamp").cast("double")) / 86400).alias("days")).first()
            if (row["rows"] if how is None else row["keys"]) > LINE_POINTS:
                unit, how = granularity(row["x"], row["days"] or 0.0), how or "mean"
                self.spec = spec = spec.with_(time_granularity=unit, aggregation=how)
        unit = unit if temporal and unit in ("day", "week", "month") else None
        if how:
            rows = charts.line(df, spec.x, spec.y, how, unit, spec.group_by)
        else:
            rows = df.select(F.col(spec.x).alias("x"), *([F.col(spec.group_by).alias("series")] if spec.group_by else []), F.col(spec.y).alias("y"))
        category = not temporal and self.profile.column(spec.x).semantic != "numeric"
        if not temporal and not category:
            n = rows.count()
            if n > LINE_POINTS:
                rows, self.sampled = charts.stride(rows, "x", LINE_POINTS), True
        found: dict[str, list] = {}
        for r in rows.limit(MOST_POINTS + 1).collect():
            found.setdefault(text(r["series"]) if spec.group_by else spec.y or "count", []).append((r["x"], r["y"]))
        at = {text(v): i for i, v in enumerate(self.ordered({text(x) for p in found.values() for x, _ in p}, spec.x))} if category else {}
        series, times = [], []
        for name in sorted(found):
            points = sorted(found[name], key=(lambda p: at[text(p[0])]) if category else lambda p: p[0])
            series.append({"name": name, "x": [plain(x) for x, _ in points], "y": [plain(y) for _, y in points]})
            times.append([x for x, _ in points])
        for s, own in zip(series, gaps.breaks(times, unit is not None, bool(spec.group_by)) if temporal else []):
            s["breaks"] = own
        return {"series": series}, sum(len(s["x"]) for s in series)

    def bar(self) -> tuple[dict, int]:
        spec = self.spec
        top = POLAR if spec.type in ("polar_line", "rose") else spec.top_n or charts.TOP
        ranked = charts.ranked_categories(self.df, spec.x, spec.y, spec.aggregation, top).collect()
        rows = charts.bar(self.df, spec.x, spec.y, spec.aggregation, spec.group_by, top).collect()
        cats = [r["category"] for r in sorted(ranked, key=lambda r: r["rank"])]
        if self.natural(spec.x):
            cats = in_order(cats, self.role(spec.x))
        name = spec.y or "count"
        values = {(r["category"], text(r["series"]) if spec.group_by else name): r["value"] for r in rows}
        names = sorted({k[1] for k in values}) if spec.group_by else [name]
        series = [{"name": s, "values": [plain(values.get((c, s))) for c in cats]} for s in names]
        return {"categories": [plain(c) for c in cats], "series": series, "truncated": any(r["truncated"] for r in ranked)}, sum(v is not None for s in series for v in s["values"])

    def stacked_bar(self) -> tuple[dict, int]:
        data, n = self.bar()
        names = [s["name"] for s in data["series"]]
        role = self.role(self.spec.group_by)
        if role is not None and role.ordered:
            names = in_order(names, role)
        by = {s["name"]: s["values"] for s in data["series"]}
        parts = [[v for v in col if v is not None] for col in zip(*by.values())] if by else []
        totals = [sum(p) if p else None for p in parts]
        share = lambda v, t: None if v is None or not t else 100.0 * v / t
        data["series"] = [{"name": s, "values": [share(v, t) for v, t in zip(by[s], totals)] if self.spec.percent else by[s]} for s in names]
        return data | {"totals": totals, "percent": bool(self.spec.percent)}, n

    def scatter(self) -> tuple[dict, int]:
        spec = self.spec
        df = charts.clean(self.df, [spec.x, spec.y, spec.group_by], [spec.x, spec.y])
        rows = sampling.exact_sample(df, SCATTER_POINTS + 1).collect()
        self.sampled = len(rows) > SCATTER_POINTS
        found: dict[str, tuple[list, list]] = {}
        for r in rows[:SCATTER_POINTS]:
            s = found.setdefault(text(r[spec.group_by]) if spec.group_by else spec.y, ([], []))
            s[0].append(plain(r[spec.x]))
            s[1].append(plain(r[spec.y]))
        return {"series": [{"name": n, "x": found[n][0], "y": found[n][1]} for n in sorted(found)]}, sum(len(s[0]) for s in found.values())

    def histogram(self) -> tuple[dict, int]:
        spec, c = self.spec, self.profile.column(self.spec.x)
        lo = hi = None
        if sentinels(c) and c.quality.robust_range and c.quality.robust_range[0] < c.quality.robust_range[1]:
            a, b = c.quality.robust_range
            row = charts.clean(self.df, [spec.x], [spec.x]).agg(F.count_if(F.col(spec.x) < a).alias("below"), F.count_if(F.col(spec.x) > b).alias("above"), F.count("*").alias("n")).first()
            if 0 < row["below"] + row["above"] < row["n"]:
                lo, hi = a, b
                self.display_range = {"lo": a, "hi": b, "excluded_below": row["below"], "excluded_above": row["above"], "reason": "suspected fill values lie outside the display range"}
        rows = charts.histogram(self.df, spec.x, spec.bins, None, lo, hi).orderBy("bin").collect()
        if not rows:
            return {"bins": {"edges": [], "counts": []}}, 0
        edges = [r["lo"] for r in rows] + [rows[-1]["hi"]]
        out = {"bins": {"edges": edges, "counts": [r["n"] for r in rows]}}
        if spec.group_by:
            by: dict[str, list[int]] = {}
            for r in charts.histogram(self.df, spec.x, len(rows), spec.group_by, lo, hi).orderBy("bin").collect():
                by.setdefault(text(r["series"]), []).append(r["n"])
            out["series"] = [{"name": s, "edges": edges, "counts": by[s]} for s in sorted(by)]
        return out, len(rows) * (1 + len(out.get("series", [])))

    def boxes(self) -> dict[str, dict]:
        spec = self.spec
        df = self.labelled()
        far: dict[str, list] = {}
        for r in charts.outliers(df, spec.y, spec.x, OUTLIERS).collect():
            far.setdefault(r["name"], []).append(r["v"])
        out = {}
        for r in charts.box(df, spec.y, spec.x).collect():
            self.sampled |= r["n_outliers"] > OUTLIERS
            out[r["name"]] = {"name": r["name"], "outliers": sorted(far.get(r["name"], [])), "count": r["n"]} | {k: plain(r[k]) for k in ("q1", "median", "q3", "lower_fence", "upper_fence", "mean")}
        return out

    def labelled(self) -> DataFrame:
        """The table with its x as labels."""
        return self.df.withColumn(self.spec.x, label(self.df, self.spec.x)) if self.spec.x else self.df

    def names(self, found) -> list[str]:
        return self.ordered(found, self.spec.x) if self.spec.x else list(found)

    def box(self) -> tuple[dict, int]:
        found = self.boxes()
        groups = [found[n] for n in self.names(found)]
        return {"groups": groups}, sum(5 + len(g["outliers"]) for g in groups)

    def density(self) -> tuple[dict, int]:
        spec, found = self.spec, self.boxes()
        df = self.labelled()
        row = charts.clean(df, [spec.x, spec.y], [spec.y]).agg(F.min(spec.y).alias("lo"), F.max(spec.y).alias("hi")).first()
        if row["lo"] is None:
            return {"groups": [], "grid": []}, 0
        lo, hi = (row["lo"], row["hi"]) if row["lo"] < row["hi"] else (row["lo"] - 0.5, row["hi"] + 0.5)
        width = (hi - lo) / charts.DENSITY_BINS
        counts: dict[str, list[int]] = {n: [0] * charts.DENSITY_BINS for n in found}
        for r in charts.density_counts(df, spec.y, spec.x).collect():
            counts[r["name"]][r["bin"]] = r["n"]
        sds = {r["name"]: r["sd"] for r in charts.clean(df, [spec.x, spec.y], [spec.y]).groupBy((F.col(spec.x) if spec.x else F.lit("all")).cast("string").alias("name")).agg(F.stddev_samp(spec.y).alias("sd")).collect()}
        rain: dict[str, list] = {}
        if spec.type == "raincloud":
            rows = charts.clean(df, [spec.x, spec.y], [spec.y])
            for r in sampling.exact_sample_by(rows, spec.x, RAIN).collect():
                rain.setdefault(r[spec.x], []).append(plain(r[spec.y]))
        groups, n = [], 0
        for name in self.names(found):
            g = found[name]
            curve, width_used = smooth(counts[name], width, g["count"], sds.get(name) or 0.0, g["q3"] - g["q1"])
            more = {"density": curve, "bandwidth": width_used}
            if spec.type == "raincloud":
                more["points"] = rain.get(name, [])
                self.sampled |= g["count"] > RAIN
            groups.append(g | more)
            n += len(curve) + 5 + len(more.get("points", []))
        return {"groups": groups, "grid": [lo + (i + 0.5) * width for i in range(charts.DENSITY_BINS)]}, n

    def dot_interval(self) -> tuple[dict, int]:
        found = {r["name"]: {k: plain(r[k]) for k in ("name", "mean", "lo", "hi", "n")} for r in charts.dot_interval(self.labelled(), self.spec.x, self.spec.y).collect()}
        return {"groups": [found[n] for n in self.names(found)]}, len(found)

    def crossed(self) -> dict[tuple[str, str], object]:
        spec = self.spec
        df = self.labelled().withColumn(spec.group_by, label(self.df, spec.group_by))
        return {(r["x"], r["group"]): plain(r["value"]) for r in charts.cells(df, spec.x, spec.group_by, spec.y, spec.aggregation).collect()}

    def two_state(self) -> tuple[dict, int]:
        cells = self.crossed()
        states = in_order({g for _, g in cells}, self.role(self.spec.group_by))
        if len(states) != 2:
            raise RenderError([f"{self.spec.type} needs exactly two states in '{self.spec.group_by}', found {len(states)}"])
        cats = in_order({x for x, _ in cells}, self.role(self.spec.x))
        return {"categories": cats, "states": states, "series": [{"name": s, "values": [cells.get((c, s)) for c in cats]} for s in states]}, len(cells)

    def heatmap(self) -> tuple[dict, int]:
        if self.spec.x is None:
            names = list(dict.fromkeys(n for pair in self.profile.pearson for n in pair))
            r = {p: v[0] for (a, b), v in self.profile.pearson.items() for p in ((a, b), (b, a))}
            return {"columns": names, "matrix": [[1.0 if a == b else plain(r.get((a, b))) for b in names] for a in names]}, len(names) ** 2
        cells = self.crossed()
        cols, rows = in_order({x for x, _ in cells}, self.role(self.spec.x)), in_order({g for _, g in cells}, self.role(self.spec.group_by))
        return {"columns": cols, "rows": rows, "matrix": [[cells.get((c, r)) for c in cols] for r in rows]}, len(cells)

    def hexbin(self) -> tuple[dict, int]:
        spec = self.spec
        cells = sorted((r["col"], r["row"], r["n"]) for r in charts.hexbin(self.df, spec.x, spec.y).collect())
        row = charts.clean(self.df, [spec.x, spec.y], [spec.x, spec.y]).agg(F.min(spec.x), F.max(spec.x), F.min(spec.y), F.max(spec.y)).first()
        if row[0] is None:
            return {"cells": [], "columns": 0, "rows": 0}, 0
        (x0, x1), (y0, y1) = ((a, b) if a < b else (a - 0.5, b + 0.5) for a, b in (row[:2], row[2:]))
        dx = (x1 - x0) / charts.HEX_COLUMNS
        dy = dx * (y1 - y0) / (x1 - x0) * (2 / 3**0.5)
        return {"cells": [list(c) for c in cells], "x_range": [x0, x1], "y_range": [y0, y1], "dx": dx, "dy": dy, "columns": charts.HEX_COLUMNS, "rows": int((y1 - y0) // (dy * 0.75)) + 1, "n": sum(c[2] for c in cells)}, len(cells)

    def sankey(self) -> tuple[dict, int]:
        spec = self.spec
        df = charts.clean(self.df, [spec.x, spec.group_by, spec.y], [spec.y])
        loops = df.filter(F.col(spec.x).cast("string") == F.col(spec.group_by).cast("string")).count()
        rows = charts.sankey(self.df, spec.x, spec.group_by, spec.y, spec.aggregation, charts.LINKS * 100).collect()
        kept = rows[: charts.LINKS]
        totals: tuple[dict, dict] = ({}, {})
        for r in kept:
            for side, key in enumerate(("source", "target")):
                totals[side][r[key]] = totals[side].get(r[key], 0) + r["value"]
        nodes = [{"name": f"{i}:{v}", "label": v, "column": c, "side": side, "value": plain(totals[i][v])} for i, (side, c) in enumerate((("source", spec.x), ("target", spec.group_by))) for v in in_order(totals[i], self.role(c))]
        links = [{"source": f"0:{r['source']}", "target": f"1:{r['target']}", "value": plain(r["value"])} for r in kept]
        return {"nodes": nodes, "links": links, "truncated": len(rows) > len(kept), "n_links_total": len(rows), "self_loops": loops}, len(links)


def smooth(counts: list[int], width: float, n: int, sd: float, iqr: float) -> tuple[list[float], float]:
    """Bin counts under a Gaussian kernel of Silverman's bandwidth, to a peak of 1, and that bandwidth."""
    if not n:
        return [], 0.0
    spread = min(sd, iqr / 1.34) if iqr > 0 else sd
    h = 0.9 * spread * n**-0.2 if spread > 0 else width
    bins = max(h / width, 0.75)
    reach = math.ceil(3 * bins)
    kernel = [math.exp(-0.5 * (k / bins) ** 2) for k in range(-reach, reach + 1)]
    out = [sum(counts[i + k - reach] * w for k, w in enumerate(kernel) if 0 <= i + k - reach < len(counts)) for i in range(len(counts))]
    peak = max(out) or 1.0
    return [v / peak for v in out], h


TYPES: dict[str, Callable[[Rendering], tuple[dict, int]]] = {
    "line": Rendering.line,
    "bar": Rendering.bar,
    "lollipop": Rendering.bar,
    "polar_line": Rendering.bar,
    "rose": Rendering.bar,
    "scatter": Rendering.scatter,
    "histogram": Rendering.histogram,
    "box": Rendering.box,
    "violin": Rendering.density,
    "raincloud": Rendering.density,
    "ridgeline": Rendering.density,
    "dot_interval": Rendering.dot_interval,
    "dumbbell": Rendering.two_state,
    "slopegraph": Rendering.two_state,
    "heatmap": Rendering.heatmap,
    "hexbin": Rendering.hexbin,
    "stacked_bar": Rendering.stacked_bar,
    "sankey": Rendering.sankey,
}


def render(df: DataFrame, spec: Spec, profile: Profile) -> dict:
    """{spec, chart_data, sampled, n_points, display_range}; ``df`` is the full table with casts applied.

    Raises :class:`RenderError` with every violation of an invalid specification.
    """
    errors = validate(spec, profile)
    if errors:
        raise RenderError(errors)
    r = Rendering(df, spec, profile)
    data, n = TYPES[spec.type](r)
    if n > MOST_POINTS:
        raise RenderError([f"the chart would have {n} points (maximum {MOST_POINTS})"])
    unit = y_label(r.spec)
    data["y_label"] = f"share of {unit} (%)" if r.spec.percent else unit
    return {"spec": r.spec, "chart_data": data, "sampled": r.sampled, "n_points": n, "display_range": r.display_range}
