"""Tail probabilities and multiple-testing rules, in plain Python over small tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

_TINY, _STEPS, _CLOSE = 1e-300, 400, 1e-15


def _lentz(terms) -> float:
    """A continued fraction 1 / (1 + a1 / (1 + a2 / ...)) by the modified Lentz rule, from its partial numerators."""
    value, c, d = 1.0, 1.0, 0.0
    for a in terms:
        d = 1.0 / ((1.0 + a * d) or _TINY)
        c = (1.0 + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _CLOSE:
            break
    return 1.0 / value


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)

    def terms():
        for m in range(_STEPS):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _lentz(terms()) / a


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) with d1 and d2 degrees of freedom."""
    if d1 <= 0 or d2 <= 0 or math.isnan(f):
        return 1.0
    if f <= 0:
        return 1.0
    return 0.0 if math.isinf(f) else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_tail(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|)."""
    return f_tail(t * t, 1, df)


def chi2_tail(x: float, df: float) -> float:
    """P(chi-square > x): the regularized upper gamma function Q(df / 2, x / 2)."""
    if x <= 0 or df <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while term > total * _CLOSE:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1.0 - front * total)
    # Upper part by its continued fraction, from the far end.
    b = 0.0
    for i in range(_STEPS, 0, -1):
        b = i * (i - a) / (z + 2 * i + 1 - a - b)
    return front / (z + 1 - a - b)


def ks_tail(d: float, n: float, m: float) -> float:
    """P of a two-sample Kolmogorov-Smirnov distance at least ``d``, with Stephens' small-sample factor."""
    size = math.sqrt(n * m / (n + m))
    lam = (size + 0.12 + 0.11 / size) * d
    if lam < 0.2:
        return 1.0
    total = sum((-1) ** (j - 1) * math.exp(-2 * (j * lam) ** 2) for j in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def anova_p(eta_ss_between: float, ss_within: float, groups: int, n: int) -> float:
    """One-way ANOVA p; without spread inside the groups it is 0, or 1 where there is none between them either."""
    if groups < 2 or n - groups < 1:
        return 1.0
    if ss_within <= 0:
        return 0.0 if eta_ss_between > 0 else 1.0
    return f_tail((eta_ss_between / (groups - 1)) / (ss_within / (n - groups)), groups - 1, n - groups)


def adjusted_eta(ss_between: float, ss_within: float, groups: int, n: int) -> float | None:
    """max(0, 1 - (SSw / (n - k)) / (SSt / (n - 1))); None where it is not defined."""
    total = ss_between + ss_within
    if groups < 2 or n - groups < 2 or total <= 0:
        return None
    return max(0.0, 1.0 - (ss_within / (n - groups)) / (total / (n - 1)))


def correlation_p(r: float, n_eff: float) -> float:
    if abs(r) >= 1.0:
        return 0.0
    return f_tail(r * r * (n_eff - 2) / (1 - r * r), 1, n_eff - 2) if n_eff > 2 else 1.0


def effective_n(n: int, rho_a: float | None, rho_b: float | None) -> float:
    """Bartlett's effective sample size of two autocorrelated series, between 3 and n; only same-signed autocorrelation counts."""
    product = (rho_a or 0.0) * (rho_b or 0.0)
    if product <= 0:
        return float(n)
    return min(float(n), max(3.0, n * (1 - product) / (1 + product)))


def homogeneity_p(rs: Sequence[float], ns: Sequence[int]) -> float:
    """Fisher-z test that correlations of independent groups are equal."""
    z = [math.atanh(max(-0.999999, min(0.999999, r))) for r in rs]
    w = [n - 3 for n in ns]
    if len(z) < 2 or min(w) <= 0:
        return 1.0
    mean = sum(a * b for a, b in zip(z, w)) / sum(w)
    return chi2_tail(sum(b * (a - mean) ** 2 for a, b in zip(z, w)), len(z) - 1)


def every_group_p(rs: Sequence[float], ns: Sequence[int]) -> float:
    """Intersection-union p that all groups correlate: the largest of theirs."""
    return max((correlation_p(r, n) for r, n in zip(rs, ns)), default=1.0)


def benjamini_hochberg(p: Sequence[float | None], q: float = 0.05) -> list[bool]:
    """Discoveries of the step-up rule; a missing p is outside the family."""
    ranked = sorted((v, i) for i, v in enumerate(p) if v is not None)
    passed = max((k for k, (v, _) in enumerate(ranked, 1) if v <= q * k / len(ranked)), default=0)
    found = {i for _, i in ranked[:passed]}
    return [i in found for i in range(len(p))]


def holm(p: Sequence[float], alpha: float = 0.05) -> list[bool]:
    """Rejections of the step-down rule."""
    out, held = [False] * len(p), True
    for k, i in enumerate(sorted(range(len(p)), key=lambda j: p[j])):
        held = held and p[i] <= alpha / (len(p) - k)
        out[i] = held
    return out
