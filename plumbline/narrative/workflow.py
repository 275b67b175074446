"""Two calls to a provider around the statistics: proposals in, verified findings and wordings out."""

from __future__ import annotations

import re
import threading
import time
from dataclasses import dataclass, field

from plumbline.engine import Engine
from plumbline.functions import tails
from plumbline.narrative.claims import claim_of, sentence
from plumbline.narrative.coverage import capped, covered, uncorroborated
from plumbline.narrative.prompts import VERSION, hypothesis_messages, wording_messages
from plumbline.narrative.provider import Disabled, Provider, ProviderError
from plumbline.narrative.verify import problems
from plumbline.operators.probes import ROLES, ROWS, Request, RequestError, Result, check
from plumbline.plans.confidence import assess, with_caution
from plumbline.plans.model import Profile, Recommendation, Spec
from plumbline.plans.recommend import assign_tiers, canonical, discount, distinct, fill_slots, reselect, score_spec
from plumbline.plans.spec import validate

HYPOTHESES, INSIGHTS = 5, 5
FAILURE_SECONDS = 60
ALPHA = 0.05
_NAME = re.compile(r"[A-Za-z]+(?:_[A-Za-z0-9]+)+")


@dataclass
class Finding:
    id: int
    test: str
    columns: dict[str, str]
    verdict: str
    effect: float
    evidence: dict
    source: str
    chart: Spec | None
    text: str = ""
    headline: str | None = None
    p_adjusted_ok: bool = True


@dataclass
class Report:
    recommendations: list[Recommendation]
    insights: list[Finding] = field(default_factory=list)
    dropped: list[tuple[int, str]] = field(default_factory=list)
    message: str | None = None


def _spec(raw, profile: Profile) -> Spec | None:
    """A valid chart from a loose suggestion; None where it cannot be drawn."""
    if not isinstance(raw, dict):
        return None
    known = {k: v for k, v in raw.items() if k in ("type", "x", "y", "group_by", "aggregation", "title", "reason") and isinstance(v, str) and v}
    if "type" not in known:
        return None
    spec, _ = canonical(Spec(**known), profile)
    if spec is None:
        return None
    spec = reselect(spec, profile)[0] if not validate(spec, profile) else spec
    return None if validate(spec, profile) else spec


class Workflow:
    """One run on one dataset."""

    def __init__(self, engine: Engine, key: str, provider: Provider):
        self.engine, self.key, self.provider = engine, key, provider
        self.profile = engine.profile(key)
        self.report = Report(engine.recommend(key)["recommendations"])

    def run(self) -> Report:
        try:
            sample = self.engine.preview(self.key, 5) if self.provider.may_see_values else None
            answer = self.provider.complete(hypothesis_messages(self.profile, self.report.recommendations, self.provider.may_see_values, sample))
        except ProviderError as e:
            self.report.message = f"no proposals ({e.category}); charts come from the rules alone"
            return self.report
        findings = self._settle(self._gate(answer.get("hypotheses")))
        self._phrase(findings)
        self.report.insights = sorted(findings, key=lambda f: (f.verdict != "pass", f.id))[:INSIGHTS]
        self._merge(answer.get("charts"), findings)
        return self.report

    def _drop(self, i: int, why: str) -> None:
        self.report.dropped.append((i, why))

    def _gate(self, raw) -> list[tuple[int, Request, Spec | None]]:
        """Proposals that name real columns in real roles, the most important first, each test once."""
        items = [(i, h) for i, h in enumerate(raw if isinstance(raw, list) else [], 1) if isinstance(h, dict)]
        rank = lambda h: h.get("importance") if isinstance(h.get("importance"), int) else 3
        items.sort(key=lambda x: (-rank(x[1]), x[0]))
        out, seen = [], {}
        for n, (i, h) in enumerate(items):
            if n >= HYPOTHESES:
                self._drop(i, "beyond the cap on hypotheses")
                continue
            names = {c.name.lower() for c in self.profile.columns}
            foreign = [t for t in _NAME.findall(str(h.get("statement") or "")) if t.lower() not in names]
            if foreign:
                self._drop(i, f"the statement names unknown columns {foreign}")
                continue
            chart = _spec(h.get("chart"), self.profile)
            test, columns = h.get("test"), h.get("columns")
            if test is None and chart is not None:
                test, columns = implied(chart, self.profile)
            if test not in ROLES or not isinstance(columns, dict):
                self._drop(i, "no test that can be run")
                continue
            twin = {d: g["representative"] for g in self.profile.evidence.get("near_duplicates", []) for d in g["duplicates"]}
            try:
                req = Request.of({"type": test, "columns": {r: twin.get(c, c) for r, c in columns.items()}})
            except RequestError as e:
                self._drop(i, str(e))
                continue
            why = check(req, self.profile)
            if why or req in seen:
                self._drop(i, why or f"the same test as hypothesis {seen[req]}")
                continue
            seen[req] = i
            out.append((i, req, chart))
        return out

    def _settle(self, asked: list[tuple[int, Request, Spec | None]]) -> list[Finding]:
        """From the evidence where it has the answer, by probes otherwise; probes stand together under Holm."""
        if self.profile.profiled_rows < ROWS:
            for i, _, _ in asked:
                self._drop(i, f"fewer than {ROWS} rows")
            return []
        found, queue = [], []
        for i, req, chart in asked:
            columns = dict(req.columns)
            hit = covered(req.type, columns, self.profile)
            if hit is None:
                queue.append((i, req, chart))
                continue
            if chart is not None:
                hit = capped(hit, assess(chart, self.profile)[0]["overall"])
            alone = uncorroborated(req.type, columns, hit["verdict"], hit["evidence"], self.profile)
            if hit["verdict"] == "fail" or alone:
                self._drop(i, alone or f"the evidence fails: effect {hit['effect']:.3f}")
            else:
                found.append(Finding(i, req.type, columns, hit["verdict"], hit["effect"], hit["evidence"], "evidence", chart))
        results = self.engine.probe(self.key, [{"type": r.type, "columns": dict(r.columns)} for _, r, _ in queue]) if queue else []
        tested = [(q, r) for q, r in zip(queue, results) if isinstance(r, Result)]
        with_p = [r.p_value for _, r in tested if r.p_value is not None]
        held = iter(tails.holm(with_p, ALPHA))
        for (i, req, chart), r in tested:
            ok = r.p_value is not None and next(held)  # without a p-value a probe is no member of the family, and no finding
            alone = uncorroborated(req.type, dict(req.columns), r.verdict, r.evidence, self.profile)
            if r.verdict == "fail" or not ok or alone:
                self._drop(i, "the probe fails" if r.verdict == "fail" else "not significant among the probes of this run" if not ok else alone)
            else:
                found.append(Finding(i, req.type, dict(req.columns), r.verdict, r.effect_size, r.evidence, "probe", chart or r.chart))
        for (i, _, _), r in zip(queue, results):
            if not isinstance(r, Result):
                self._drop(i, r.reason)
        return found

    def _claim(self, f: Finding):
        pair = (f.columns.get("x"), f.columns.get("y"))
        pooled = (self.profile.pearson.get(pair) or self.profile.pearson.get(pair[::-1]) or (None, 0))[0]
        return claim_of(f.test, f.columns, f.evidence, f.effect, pooled)

    def _phrase(self, findings: list[Finding]) -> None:
        """Template sentences, replaced by the provider's where those say no more than the facts."""
        claims = {f.id: self._claim(f) for f in findings}
        for f in findings:
            f.text = sentence(claims[f.id])
        if not any(f.source == "probe" for f in findings) and len(findings) < 2:
            return
        try:
            answer = self.provider.complete(wording_messages([{"id": f.id, "test": f.test, "columns": f.columns, "fact": f.text, "verdict": f.verdict} for f in findings]))
        except ProviderError as e:
            self.report.message = f"no wordings ({e.category}); sentences are templates"
            return
        by = {f.id: f for f in findings}
        for x in answer.get("insights") if isinstance(answer.get("insights"), list) else []:
            f = by.get(x.get("id")) if isinstance(x, dict) and isinstance(x.get("id"), int) else None
            if f is None:
                continue
            for slot in ("text", "headline"):
                if isinstance(x.get(slot), str) and not problems(x[slot], claims[f.id]):
                    setattr(f, slot, x[slot])

    def _merge(self, charts, findings: list[Finding]) -> None:
        """Suggested charts among the rules' under the same scores, caps and slots."""
        extra = []
        for spec in [_spec(c, self.profile) for c in (charts if isinstance(charts, list) else [])] + [f.chart for f in findings]:
            if spec is None or validate(spec, self.profile):
                continue
            chosen, rest, intent = reselect(spec, self.profile)
            score, level = score_spec(chosen, self.profile)
            extra.append(Recommendation(chosen, score, intent, rest, cap={"weak": "secondary", "unverified": "exploratory"}.get(level), source="suggested"))
        if not extra:
            return
        known = {(r.spec.type, r.spec.x, r.spec.y, r.spec.group_by) for r in self.report.recommendations}
        extra = [r for r in extra if (r.spec.type, r.spec.x, r.spec.y, r.spec.group_by) not in known]
        discount(extra, self.profile)
        merged, _ = distinct([*self.report.recommendations, *extra], self.profile)
        merged = fill_slots(merged)
        for r in merged:
            r.spec = r.spec.with_(reason=with_caution(r.spec.reason, r.warnings))
        assign_tiers(merged)
        self.report.recommendations = merged


def implied(chart: Spec, profile: Profile) -> tuple[str | None, dict]:
    """The test a chart claims the outcome of; (None, {}) where it claims nothing."""
    kind = lambda n: c.semantic if (c := profile.column(n)) else None
    x, y, g = chart.x, chart.y, chart.group_by
    if not x or not y:
        return None, {}
    if kind(x) == "datetime":
        return "time_pattern", {"time": x, "target": y} | ({"group": g} if g else {})
    if kind(x) == "numeric":
        return ("grouped_relationship", {"x": x, "y": y, "group": g}) if g else ("nonlinear_relationship", {"x": x, "y": y})
    if g:
        return "interaction", {"factor1": x, "factor2": g, "target": y}
    spread = chart.type in ("box", "violin", "raincloud", "ridgeline")
    return "distribution_difference" if spread else "group_difference", {"group": x, "target": y}


class Narrator:
    """Reports by dataset and provider: kept, built once at a time; after a failure kept for a minute only."""

    def __init__(self, engine: Engine, provider: Provider | None = None):
        self.engine, self.provider = engine, provider or Disabled()
        self._known: dict[tuple, tuple[float, Report]] = {}
        self._locks: dict[tuple, threading.Lock] = {}
        self._guard = threading.Lock()

    def report(self, key: str, refresh: bool = False) -> Report:
        ident = (key, self.provider.identity, self.engine.profile(key).version, VERSION)
        asked = time.monotonic()
        with self._guard:
            lock = self._locks.setdefault(ident, threading.Lock())
        with lock:
            made, found = self._known.get(ident, (0.0, None))
            stale = found is not None and found.message is not None and time.monotonic() - made > FAILURE_SECONDS
            if found is None or stale or refresh and made < asked:
                found = Workflow(self.engine, key, self.provider).run()
                self._known[ident] = (time.monotonic(), found)
            return found

    def recommendations(self, key: str, llm: bool = True, debug: bool = False, refresh: bool = False) -> dict:
        """Charts and warnings, with insights where the provider may be asked (``llm``), and what became of its proposals (``debug``)."""
        out = self.engine.recommend(key)
        if not llm:
            return out | {"insights": []}
        report = self.report(key, refresh)
        out = out | {"recommendations": report.recommendations, "insights": report.insights}
        return out | {"debug": {"message": report.message, "dropped": [{"hypothesis": i, "reason": why} for i, why in report.dropped]}} if debug else out
