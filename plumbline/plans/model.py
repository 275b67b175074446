"""What a profile knows: columns, pairs and groups, as plain records that serialize to JSON."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field
from datetime import date, datetime

from plumbline.operators.typing import Cast

VERSION = 1


@dataclass
class Quality:
    """How far a numeric column can be trusted."""

    n: int = 0
    missing: int = 0
    tokens: int = 0
    invalid: int = 0
    valid_ratio: float | None = None
    median: float | None = None
    mad: float | None = None
    q1: float | None = None
    q3: float | None = None
    robust_z_max: float | None = None
    extreme_count: int = 0
    sentinels: list[dict] = field(default_factory=list)
    sentinel_rows: int = 0
    robust_range: tuple[float, float] | None = None
    mode_share: float | None = None
    concentration: str | None = None


@dataclass
class Column:
    name: str
    dtype: str
    semantic: str
    nominal: bool = False
    cast: Cast | None = None
    missing_count: int = 0
    missing_ratio: float = 0.0
    unique_count: int = 0
    stats: dict = field(default_factory=dict)
    top_values: list[tuple[str, int]] = field(default_factory=list)
    n_categories: int | None = None
    labels: list[str] | None = None
    frequency: str | None = None
    first: str | None = None
    last: str | None = None
    quality: Quality | None = None


@dataclass
class Profile:
    """A dataset's profile: columns, the evidence tables by kind, and the family of tests."""

    dataset_id: str
    n_rows: int
    profiled_rows: int
    columns: list[Column]
    pearson: dict = field(default_factory=dict)
    spearman: dict = field(default_factory=dict)
    evidence: dict[str, list[dict]] = field(default_factory=dict)
    fdr: dict = field(default_factory=dict)
    version: int = VERSION

    def column(self, name: str | None) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def to_json(self) -> str:
        def plain(x):
            if isinstance(x, float):
                return x if math.isfinite(x) else None
            if isinstance(x, dict):
                return {(k if isinstance(k, str) else "\t".join(k)): plain(v) for k, v in x.items()}
            if isinstance(x, (list, tuple)):
                return [plain(v) for v in x]
            return x.isoformat() if isinstance(x, (date, datetime)) else x

        return json.dumps(plain(dataclasses.asdict(self)), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Profile:
        """Raises ValueError where the text is no profile of this version."""
        try:
            raw = json.loads(text)
            if raw.get("version") != VERSION:
                raise ValueError(f"profile version {raw.get('version')}, not {VERSION}")
            columns = []
            for c in raw.pop("columns"):
                c["cast"] = Cast(**c["cast"]) if c["cast"] else None
                if c["quality"]:
                    c["quality"]["robust_range"] = tuple(c["quality"]["robust_range"]) if c["quality"]["robust_range"] else None
                    c["quality"] = Quality(**c["quality"])
                c["top_values"] = [tuple(v) for v in c["top_values"]]
                columns.append(Column(**c))
            for name in ("pearson", "spearman"):
                raw[name] = {tuple(k.split("\t")): tuple(v) if isinstance(v, list) else v for k, v in raw[name].items()}
            return Profile(columns=columns, **raw)
        except (AttributeError, KeyError, TypeError, json.JSONDecodeError) as e:
            raise ValueError(f"not a profile: {e}") from e


@dataclass(frozen=True)
class Spec:
    """A declarative chart query."""

    type: str
    x: str | None = None
    y: str | None = None
    group_by: str | None = None
    aggregation: str | None = None
    bins: int | None = None
    time_granularity: str | None = None
    top_n: int | None = None
    sort: str | None = None
    percent: bool | None = None
    title: str = ""
    reason: str = ""

    def with_(self, **changes) -> Spec:
        return dataclasses.replace(self, **changes)


@dataclass
class Recommendation:
    spec: Spec
    base: float
    intent: str | None
    alternatives: list[Spec] = field(default_factory=list)
    confidence: dict = field(default_factory=dict)
    warnings: list[dict] = field(default_factory=list)
    cap: str | None = None
    tier: str | None = None
    score: float = 0.0
    source: str = "rules"
