"""Whether a text says no more than its claim. Whatever is not known to be supported is refused."""

from __future__ import annotations

import re

from plumbline.narrative.claims import Claim

#: Function words a sentence may be made of; everything else must come from the claim.
PLAIN = frozenset(
    "a an the this these that those it its is are was were be been has have had of in on at to from for with within by between across among over under than as and or but while whereas "
    "not no about around roughly approximately near nearly each per both one two three four five more most less least only also very value values number numbers data dataset rows records group groups category categories "
    "level levels column columns average mean median typical typically usual overall difference differences differ differs different vary varies varying variation spread distribution distributions shape shaped "
    "relationship relationships related relation association associated correlation correlations linked pattern patterns trend time period curve curved line straight non-linear nonlinear linear peak peaks shows show showing seen "
    "here there when where which who how much many clear clearly strong strongly weak weakly slight slightly moderate moderately change changes changed shift shifts step compared comparison direction directions depends depend depending set".split()
)
UP = frozenset("rise rises rising rose increase increases increasing increased grow grows growing grew climb climbs climbing positive positively up upward together".split())
DOWN = frozenset("fall falls falling fell decrease decreases decreasing decreased drop drops dropping decline declines declining negative negatively down downward".split())
TOP = frozenset("highest largest greatest biggest top maximum higher larger greater bigger above exceeds exceed".split())
BOTTOM = frozenset("lowest smallest bottom minimum lower smaller below".split())
OPPOSITE = frozenset("opposite reverse reversed reverses flips flip flipped mixed".split())
EVERY = frozenset("every all always consistent consistently any everywhere universally".split())
CAUSE = frozenset("cause causes caused causing because due drives drive driven driving leads lead led impact impacts effect affects affect influence influences makes make results result thanks therefore thus hence explains explain".split())
EXTREMES = {"highest", "largest", "greatest", "biggest", "top", "maximum"}, {"lowest", "smallest", "bottom", "minimum"}
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d{4}-\d{2}-\d{2}|[-−]?\d[\d,]*\.?\d*%?")
_LATIN = re.compile(r"[\s\w.,;:()%'’\"\-−–—/+]*", re.ASCII)


def _quotes(written: str, fact: float) -> bool:
    """Whether a written number is this fact: whole ones exact, decimals right to their digits, percentages a hundred times."""
    digits = written.replace(",", "").replace("−", "-")
    scale = 100.0 if digits.endswith("%") else 1.0
    value, places = float(digits.rstrip("%")), len(digits.rstrip("%").partition(".")[2])
    exact = places or scale > 1 or float(fact).is_integer() or abs(fact) >= 1000
    share = scale == 1 or abs(fact) <= 1  # only shares and correlations have percentages
    return bool(exact and share) and any(abs(round(f * scale, places) - value) < 1e-9 for f in (fact, abs(fact)))


def _numbers_fit(quoted: str, spots: list[tuple[int, str]], claim: Claim) -> list[str]:
    """Numbers that quote nothing, and numbers of one group that stand beside another.

    A number that only a group has belongs to the label it is said to be for
    ("4 for blue"), else to the label before it, else to the one after.
    """
    values = dict(claim.groups)
    labels = [(at, name) for at, name in spots if name in values]
    free = [f for f in claim.numbers if f not in values.values()] + [float(len(claim.groups))]
    bad = []
    for m in re.finditer(r"(?<![\w.])[-−]?\d[\d,]*(?:\.\d+)?%?(?![\w])", quoted):
        if any(_quotes(m[0], f) for f in free):
            continue
        owners = {name for name, v in values.items() if _quotes(m[0], v)}
        if not owners:
            bad.append(f"number {m[0]} is not in the evidence")
        elif labels:
            before, after = [x for x in labels if x[0] < m.start()], [x for x in labels if x[0] > m.start()]
            said = after and re.fullmatch(r"\s*(?:for|in|of|at|within)\s+(?:the\s+)?(?:\x00+\s+)?", quoted[m.end() : min(after)[0]])
            beside = (min(after) if said or not before else max(before))[1]
            if beside not in owners:
                bad.append(f"number {m[0]} is that of {sorted(owners)[0]}, not of {beside}")
        elif len(values) > 1:
            bad.append(f"number {m[0]} names no group")
    return bad


_GROUPS = r"(?:groups?|levels?|categor(?:y|ies))"


def _universals(text: str, claim: Claim) -> list[str]:
    """Words of universality that are not about the groups of the claim."""
    group = claim.columns.get("group")
    about = rf"(?:{re.escape(group)}|{_GROUPS})" if group else _GROUPS
    out = []
    for m in re.finditer(r"[A-Za-z]+", text):
        word = m[0].lower()
        if word in ("every", "all", "any"):
            overall = claim.reversed_overall and text[m.start() :].startswith("all rows together")
            if not overall and not re.match(rf"(?:\W+\w+){{0,3}}?\W+{about}(?!\w)", text[m.end() :]):
                out.append(f"'{m[0]}' is not about the groups")
        elif word in EVERY and not re.search(rf"(?<!\w){about}(?!\w)", text):
            out.append(f"'{m[0]}' is not about the groups")
    return out


def problems(text: str, claim: Claim) -> list[str]:
    """Everything in ``text`` that the claim does not bear; empty where it may be shown."""
    own = [*claim.columns.values(), *claim.labels]
    quoted, spots = text, []
    for name in sorted(set(own), key=len, reverse=True):  # names and labels first: what they contain is no wording
        pattern = re.compile(rf"(?<![\w]){re.escape(name)}(?![\w])")
        spots += [(m.start(), name) for m in pattern.finditer(quoted)]
        quoted = pattern.sub(lambda m: "\x00" * len(m[0]), quoted)
    rest = quoted.replace("\x00", " ")
    out = []
    if not text.strip():
        return ["empty text"]
    if not _LATIN.fullmatch(rest):
        out.append("characters outside plain English text")
    if claim.change:
        rest = rest.replace(claim.change[2], " ")
    if re.search(r"\d{4}-\d{2}-\d{2}", rest):
        out.append("a date that is not the evidence's")
    out += _numbers_fit(quoted.replace(claim.change[2], " " * len(claim.change[2])) if claim.change else quoted, spots, claim)
    words = [w.lower() for w in _WORD.findall(rest) if not w[0].isdigit() and w[0] not in "-−"]
    known = PLAIN | UP | DOWN | TOP | BOTTOM | OPPOSITE | EVERY
    if claim.shape:
        known = known | {"u-shaped", "inverted", "u", "monotone", "several", "rises-then-falls", "bends"}
    out += [f"causal wording: {w}" for w in words if w in CAUSE]
    out += [f"word outside the allowed list: {w}" for w in words if w not in known and w not in CAUSE]
    seen = set(words)
    if seen & EVERY and not claim.universal:
        out.append("a claim about every group that is not supported")
    elif seen & EVERY:
        out += _universals(text, claim)
    directed = claim.direction in ("positive", "negative")
    for side, sign in ((UP, "positive"), (DOWN, "negative")):
        if seen & side and not (claim.direction == sign or claim.direction == "mixed" and seen & OPPOSITE):
            out.append(f"direction words {sorted(seen & side)} against a {claim.direction or 'missing'} direction")
    if seen & OPPOSITE and claim.direction != "mixed" and not claim.reversed_overall:
        out.append("opposite directions are not supported")
    if "not" in seen or "no" in seen:
        out.append("a negation cannot be checked")
    if seen & (TOP | BOTTOM):
        out += _order_problems(quoted, spots, claim) if len(claim.groups) >= 2 and not (directed and claim.measure == "correlation") else ["an order that is not in the evidence"]
    if "strongest" in seen or "weakest" in seen:
        out.append("superlatives of strength cannot be checked")
    return out


def _order_problems(quoted: str, spots: list[tuple[int, str]], claim: Claim) -> list[str]:
    """Each order word must stand next to a label it is true of."""
    value, out = dict(claim.groups), []
    labels = sorted((at, name) for at, name in spots if name in value)
    for m in re.finditer(r"[A-Za-z]+", quoted):
        word = m[0].lower()
        if word not in TOP | BOTTOM:
            continue
        after = [n for at, n in labels if at > m.start()]
        before = [n for at, n in labels if at < m.start()]
        if word in EXTREMES[0] | EXTREMES[1]:
            subject = after[0] if after else before[-1] if before else None
            want = max(value.values()) if word in EXTREMES[0] else min(value.values())
            if subject is None or value[subject] != want:
                out.append(f"'{word}' is not true of {subject}")
        elif not before or not after or not (value[before[-1]] > value[after[0]] if word in TOP else value[before[-1]] < value[after[0]]):
            out.append(f"'{word}' compares nothing that can be checked")
    return out
