"""The reductions that probes and curves take of rows, over all rows of a table: as :class:`bounded.Rows` gives them, by Spark.

What comes back is a row per group, cell, bin or pair of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from plumbline.functions.exprs import label
from plumbline.operators import evidence, profile, structure
from plumbline.operators.evidence import MIN_CELL, MIN_GROUP


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return sorted((r.asDict() for r in df.collect()), key=lambda r: [r[c] for c in order])


class Whole:
    """A table and the categories of it that are asked for."""

    def __init__(self, df: DataFrame, cats: dict[str, Column]):
        self.df, self.cats = df, cats

    @staticmethod
    def of(df: DataFrame, nums=(), cats=()) -> Whole:
        """Numbers are read by name."""
        return Whole(df, {c: label(df, c) for c in cats})

    def pearson(self, names: list[str]) -> dict[tuple[str, str], tuple[float | None, int]]:
        return {(r["a"], r["b"]): (r["r"], r["n"]) for r in profile.pearson_pairs(self.df, names).collect()}

    def moments(self, levels: dict[str, Column], nums: list[str]) -> list[dict]:
        return _rows(evidence.level_moments(self.df, levels, nums), "cat", "num", "level")

    def group_table(self, cat: str, num: str) -> list[dict]:
        return _rows(structure.group_summary(self.df, cat, num), "level")

    def group_correlations(self, group: str, pairs: list[tuple[str, str]], least: int = MIN_GROUP) -> list[dict]:
        return _rows(evidence.group_correlations(self.df, group, pairs, least), "x", "y", "level")

    def cells(self, a: Column, b: Column, num: str, least: int = MIN_CELL) -> list[dict]:
        return _rows(evidence.interaction_cells(self.df, a, b, num, least), "a", "b")

    def curve_bins(self, x: str, ys: list[str], bins: int) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for r in _rows(structure.nonlinear_bins(self.df, x, ys, bins), "y", "bin"):
            out.setdefault(r["y"], []).append(r)
        return out

    def distances(self, cat: str, num: str, least: int, groups: int) -> list[dict]:
        return _rows(structure.ks_distances(self.df, cat, num, least, groups), "a", "b")
