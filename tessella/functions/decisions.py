"""Decisions over a pair's scores, as column expressions: gates, evidence, ordered rules, layers, arbitration.

Each takes columns by the name of their score; a rule list is an ordered ``when``, so that the first rule that holds wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.scores import clamp

Scores = dict[str, Column]

#: Bands of confidence of each verdict.
BANDS = {"CLEAN": (0.05, 0.35), "PROBABLE": (0.70, 0.85), "REVIEW": (0.40, 0.70), "TRUE": (0.85, 1.00)}
#: Multipliers of scores by type of file; a score that is not named has 1.
FILE_WEIGHTS = {
    "CODE": {},
    "CONFIG": {"embedding": 0.0, "fingerprint": 0.3, "ngram": 0.3, "winnowing": 0.3, "graph": 0.5},
    "SCRIPT": {"embedding": 0.1, "ast": 0.8, "fingerprint": 0.5, "ngram": 0.5, "winnowing": 0.5, "graph": 0.5},
    "DATA": {"embedding": 0.0, "ast": 0.1, "fingerprint": 0.2, "ngram": 0.2, "winnowing": 0.2, "graph": 0.1},
    "MIXED": {"embedding": 0.5, "fingerprint": 0.8, "ngram": 0.8, "winnowing": 0.8, "graph": 0.8},
}
#: A trained logistic model of seven scores.
LEARNED = {
    "ast": -2.71537550284654,
    "fingerprint": -2.126945142815265,
    "embedding": -0.449739169332091,
    "ngram": 1.8581117596233359,
    "winnowing": 4.2089619255013035,
    "logic_flow": 1.4610990783270907,
    "coverage": 2.4242742349681436,
}
INTERCEPT = -2.0473305598114564
#: Weights of a pair's rank, and of the fixed blend.
RANK_WEIGHTS = {"token": 0.18, "ast": 0.20, "cfg": 0.12, "dfg": 0.10, "call_graph": 0.08, "runtime_bug": 0.16, "edge_case": 0.08, "previous_term": 0.08}
BLEND = {"ast": 0.40, "token": 0.20, "stylometry": 0.15, "embedding": 0.15, "execution": 0.10}


def rules(*ordered: tuple[Column, object], otherwise: object) -> Column:
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for condition, value in reversed(ordered):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def at(s: Scores, name: str) -> Column:
    return s.get(name, F.lit(0.0))


def highest(s: Scores, *names: str) -> Column:
    """The greatest of those scores that there are; 0 if there is none."""
    held = [s[n] for n in names if n in s]
    return F.greatest(F.lit(0.0), *held) if held else F.lit(0.0)


def gated(s: Scores, coverage: Column) -> Column:
    """Whether a pair is cleared whatever its scores: no signal, no structure, little coverage, or far less than its signal."""
    top, built = highest(s, *s), highest(s, "ast", "logic_flow", "ngram", "winnowing", "token", "fingerprint")
    return (top < 0.50) | (built < 0.50) | (coverage < 0.15) | ((top >= 0.80) & (coverage < 0.40))


def weighted_by_file(s: Scores, kind: Column) -> Scores:
    """Scores times the multiplier of the file's type; an unknown type counts as MIXED."""
    of = lambda name: rules(*((kind == k, w.get(name, 1.0)) for k, w in FILE_WEIGHTS.items()), otherwise=FILE_WEIGHTS["MIXED"].get(name, 1.0))
    return {name: x * of(name) for name, x in s.items()}


def evidence(s: Scores) -> Scores:
    return {
        "structural": highest(s, "ast", "logic_flow", "ngram", "winnowing"),
        "lexical": highest(s, "fingerprint", "winnowing", "ngram"),
        "semantic": at(s, "embedding"),
        "style": highest(s, "graph", "stylometry"),
    }


def policy(e: Scores) -> Column:
    """The verdict on evidence. The first rule makes two of the later ones unreachable, as in the policy this follows."""
    structural, lexical, semantic, style = (e[k] for k in ("structural", "lexical", "semantic", "style"))
    return rules(
        (structural < 0.60, "CLEAN"),
        ((structural >= 0.90) & ((lexical >= 0.50) | (semantic >= 0.50)), "TRUE"),
        ((semantic >= 0.95) & (structural >= 0.50), "PROBABLE"),
        ((structural >= 0.75) & (lexical >= 0.50), "PROBABLE"),
        ((structural >= 0.50) & (style >= 0.70), "PROBABLE"),
        ((structural >= 0.70) & (lexical < 0.40) & (semantic < 0.40) & (style < 0.40), "REVIEW"),
        ((semantic >= 0.85) & (structural < 0.50), "REVIEW"),
        ((structural >= 0.30) | (lexical >= 0.30) | (semantic >= 0.30), "REVIEW"),
        otherwise="CLEAN",
    )


def confidence(verdict: Column, e: Scores, coverage: Column) -> Column:
    """Within the verdict's band, by the strongest evidence."""
    strength = F.least(F.lit(1.0), F.greatest(*e.values(), coverage))
    return rules(*((verdict == v, low + (high - low) * strength) for v, (low, high) in BANDS.items()), otherwise=0.0)


def semantic_corrected(x: Column) -> Column:
    """A strong embedding score stays (0.99 at most), any other loses its baseline of 0.70."""
    return F.when(x >= 0.95, F.least(F.lit(0.99), x)).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.0), x - 0.70) / 0.30))


def hierarchy(s: Scores, identical: Column) -> tuple[Column, Column]:
    """Verdict and confidence: identity, structure, then ordered rules over structural, statistical and semantic scores."""
    built, stats, sem = highest(s, "ast", "logic_flow", "ngram", "winnowing"), highest(s, "graph", "stylometry"), semantic_corrected(at(s, "embedding"))
    ordered = (
        (identical, "TRUE", 0.99),
        (built >= 0.90, "TRUE", 0.95),
        (sem >= 0.95, "PROBABLE", 0.85),
        (built >= 0.75, "TRUE", 0.90),
        ((built >= 0.50) & (stats >= 0.70), "PROBABLE", 0.75),
        ((sem >= 0.85) & (built < 0.50), "REVIEW", 0.60),
        (F.abs(built - sem) > 0.50, "REVIEW", 0.50),
        ((built >= 0.30) | (stats >= 0.30), "REVIEW", 0.40),
    )
    return rules(*((c, v) for c, v, _ in ordered), otherwise="CLEAN"), rules(*((c, x) for c, _, x in ordered), otherwise=0.10)


def layers(exact: Column, s: Scores, distance: Column, domain: str = "code") -> tuple[Column, Column, Column]:
    """The strongest deterministic, statistical and semantic signal. A trusted kind of signal is raised in its domain; the
    semantic one is 0.95 at most."""
    raised = {"cs_code": (("ast_subtree", "ast_node"), 1.2), "math": (("structure",), 1.3)}.get(domain, ((), 1.0))
    first = [F.least(F.lit(1.0), s[n] * raised[1]) if n in raised[0] else s[n] for n in ("ast_subtree", "ast_node", "structure", "token", "winnowing", "ngram") if n in s]
    one = F.when(exact >= 0.90, exact).otherwise(F.greatest(F.lit(0.0), *first))
    return one, F.greatest(1.0 - distance, highest(s, "graph", "logic_flow", "control_flow", "data_flow")), F.least(F.lit(0.95), highest(s, "embedding", "transformer", "concept"))


def conflicts(s: Scores) -> tuple[Column, Column, Column, Column]:
    """Level, its value, the resolved score and the action, by how far ast, gst and token scores stand apart."""
    ast, gst, token = (at(s, n) for n in ("ast", "gst", "token"))
    gap = F.abs(ast - gst) + F.abs(ast - token) + F.abs(gst - token)
    mean = total([at(s, n) for n in ("ast", "gst", "token", "semantic", "cfg")]) / 5
    ordered = (
        ((gap < 0.3) & (mean > 0.7), "high_confidence", 0.95),
        ((ast > 0.85) & (gst > 0.7) & (gap < 0.6), "high_confidence", 0.9),
        ((ast > 0.8) & (gst > 0.5), "medium_confidence", 0.7),
        ((ast > 0.7) & (gap < 1.0), "medium_confidence", 0.6),
        (gap > 1.2, "low_confidence", 0.3),
    )
    level, value = rules(*((c, v) for c, v, _ in ordered), otherwise="low_confidence"), rules(*((c, x) for c, _, x in ordered), otherwise=0.4)
    blend = lambda a, b, c: a * ast + b * gst + c * token
    score = clamp(rules((level == "high_confidence", blend(0.5, 0.3, 0.2)), (level == "medium_confidence", blend(0.6, 0.25, 0.15)), otherwise=blend(0.7, 0.2, 0.1) * (1 - gap / 3)))
    action = rules(
        ((level == "high_confidence") & (score > 0.8), "Auto-flag as suspicious"),
        ((level == "medium_confidence") & (score > 0.6), "Review recommended"),
        ((level == "low_confidence") & (score > 0.5), "Manual review required"),
        otherwise="No action needed",
    )
    return level, value, score, action


def rank(s: Scores) -> Column:
    """Priority for review: a weighted base, discounts of what many share, floors of what few share, and a cap on pairs that
    an embedding alone supports."""
    token = highest(s, "fingerprint", "winnowing")
    known = s | {"token": token}
    base = clamp(total([at(known, n) * w for n, w in RANK_WEIGHTS.items()]))
    for name, least, factor in (("starter_overlap", 0.70, 0.55), ("boilerplate_overlap", 0.70, 0.75), ("common_solution", 0.65, 0.70)):
        base = F.when(at(s, name) >= least, base * factor).otherwise(base)
    ast, cfg, dfg = at(s, "ast"), at(s, "cfg"), at(s, "dfg")
    for holds, floor in (
        ((at(s, "runtime_bug") >= 0.70) | (at(s, "edge_case") >= 0.75), 0.86),
        ((at(s, "previous_term") >= 0.75) & ((ast >= 0.60) | (token >= 0.55)), 0.84),
        ((token >= 0.70) & (ast >= 0.65) & (at(s, "identifier_rename") >= 0.55), 0.82),
        ((ast >= 0.72) & ((cfg >= 0.60) | (dfg >= 0.60)), 0.78),
    ):
        base = F.when(holds, F.greatest(base, F.lit(floor))).otherwise(base)
    base = F.when(at(s, "rare_pattern") >= 0.70, base + 0.10).otherwise(base)
    base = F.when(at(s, "style_shift") >= 0.75, F.greatest(base, F.least(F.lit(0.72), base + 0.08))).otherwise(base)
    concrete = highest(s, "fingerprint", "winnowing", "ngram", "ast", "cfg", "dfg", "call_graph", "runtime_bug", "edge_case", "previous_term", "rare_pattern", "identifier_rename")
    return clamp(F.when((at(s, "embedding") >= 0.75) & (concrete < 0.45), F.least(base, F.lit(0.48))).otherwise(base))


def learned(s: Scores) -> Column:
    return 1 / (1 + F.exp(-clamp(F.lit(INTERCEPT) + total([at(s, n) * w for n, w in LEARNED.items()]), -30.0, 30.0)))


def blended(s: Scores) -> Column:
    """Fixed weights, a tenth more where three scores or more agree on a high value."""
    base = total([at(s, n) * w for n, w in BLEND.items()])
    agree = total([F.when(x > 0.8, 1).otherwise(0) for x in s.values()])
    return clamp(F.when(agree >= 3, base * 1.1).otherwise(base))


def structure_floor(score: Column, s: Scores) -> Column:
    """Keeps a score high where structure, lexis and flow agree."""
    ast, lexis, flow, grams, prints = (at(s, n) for n in ("ast", "fingerprint", "logic_flow", "ngram", "winnowing"))
    strong, medium = (lexis >= 0.80) & ((grams >= 0.70) | (prints >= 0.56)), (lexis >= 0.65) & ((grams >= 0.58) | (prints >= 0.48))
    return F.when((ast >= 0.75) & strong & (flow >= 0.90), F.greatest(score, F.lit(0.88))).when((ast >= 0.65) & medium & (flow >= 0.78), F.greatest(score, F.lit(0.82))).otherwise(score)


def clone_kind(token: Column, ast: Column, cfg: Column, overall: Column) -> tuple[Column, Column]:
    """T1 identical, T2 renamed, T3 restructured, T4 alike in meaning, T5 independent; with a confidence."""
    half = lambda a, b: F.least(F.lit(1.0), (a + b) / 2)
    ordered = (
        ((token > 0.90) & (ast > 0.95), "T1", half(token, ast)),
        ((ast > 0.80) & (token < 0.90), "T2", F.least(F.lit(1.0), ast)),
        ((cfg > 0.6) & (ast > 0.35), "T3", half(cfg, ast)),
        ((ast > 0.3) & (overall > 0.25), "T4", overall),
    )
    return rules(*((c, k) for c, k, _ in ordered), otherwise="T5"), rules(*((c, x) for c, _, x in ordered), otherwise=1.0 - overall)


def label(score: Column) -> Column:
    return rules((score > 0.9, "HIGH RISK"), (score > 0.75, "MEDIUM RISK"), (score > 0.6, "SUSPICIOUS"), otherwise="LOW RISK")


def binary(score: Column, threshold: float = 0.5) -> tuple[Column, Column]:
    """The verdict and a confidence by the distance from the threshold."""
    return F.when(score >= threshold, 1).otherwise(0), F.least(F.lit(1.0), 0.5 + F.abs(score - threshold))


def normalized(x: Column, kind: str = "unit", low: float = 0.0, high: float = 1.0, inverse: bool = False) -> Column:
    """A raw value to [0, 1]: as it is, as a percentage (where it exceeds 1), or by its range."""
    y = F.when(x > 1, x / 100).otherwise(x) if kind == "percent" else (x - low) / (high - low) if kind == "min_max" else x
    return F.round(1 - clamp(y) if inverse else clamp(y), 4)


def condition(text: str, value: Column) -> Column:
    """A comparison such as ``>= 0.9`` or ``<= 0.5`` of a value, as rules of a policy file write it."""
    for sign, make in ((">=", lambda a, b: a >= b), ("<=", lambda a, b: a <= b), (">", lambda a, b: a > b), ("<", lambda a, b: a < b), ("==", lambda a, b: a == b)):
        if text.strip().startswith(sign):
            return make(value, float(text.strip()[len(sign) :]))
    raise ValueError(f"no comparison: {text!r}")


def holds(rule, values: Scores) -> Column:
    """A tree of {"and": [...]}, {"or": [...]} and {key: comparison}; every key of a node must hold."""
    if "and" in rule or "or" in rule:
        parts = [holds(r, values) for r in rule.get("and", rule.get("or"))]
        return reduce(lambda a, b: a & b, parts) if "and" in rule else reduce(lambda a, b: a | b, parts)
    return reduce(lambda a, b: a & b, [condition(c, at(values, k)) for k, c in rule.items()])


def policy_rules(ordered: list[dict], values: Scores, otherwise: str) -> Column:
    """The verdict of the first rule, {"when": tree, "verdict": name}, that holds."""
    return rules(*((holds(r["when"], values), r["verdict"]) for r in ordered), otherwise=otherwise)
