"""From a query to its plan: signals, the intent they point to, and the plan that answers it, with its fallback."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: From what strength a signal counts.
STRONG = 0.7
SIGNAL_PATTERNS = {
    "temporal": r"(?i)\b(when|yesterday|today|last|ago|before|after|since)\b|\d{4}-\d{2}-\d{2}",
    "abstract": r"(?i)\b(overview|summar\w+|in general|theme|pattern|usually)\b",
    "affective": r"(?i)\b(feel\w*|happy|sad|angry|afraid|worried|love|hate|upset)\b",
}
FALLBACK = {"factual": "associative", "episodic": "associative", "abstract": "associative", "affective": "associative", "hybrid": "factual"}


@dataclass
class Plan:
    intent: str
    parts: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    fallback: str | None = None


def signals(query: str, entities: set[str]) -> dict[str, float]:
    """Strength of each signal: an entity named exactly counts 1, in part 0.5; patterns count 1 or 0."""
    words = re.findall(r"[^\W_]+", query.lower())
    grams = {" ".join(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1)}
    names = {e.lower() for e in entities}
    entity = 1.0 if grams & names else 0.5 if any(w in n.split() for n in names for w in words if len(w) > 3) else 0.0
    out = {"factual": entity} | {k: float(bool(re.search(rx, query))) for k, rx in SIGNAL_PATTERNS.items()}
    return out | {"associative": 1 - max(out.values())}


def route(query: str, entities: set[str]) -> Plan:
    """No strong signal: associative after factual; one: its intent; more: the two strongest, fused."""
    s = signals(query, entities)
    strong = sorted((k for k in ("factual", "temporal", "abstract", "affective") if s[k] >= STRONG), key=lambda k: -s[k])
    name = {"temporal": "episodic"}
    if not strong:
        return Plan("factual", ["factual"], [], "associative")
    if len(strong) == 1:
        intent = name.get(strong[0], strong[0])
        return Plan(intent, [intent], [], FALLBACK[intent])
    return Plan("hybrid", [name.get(k, k) for k in strong[:2]], [name.get(k, k) for k in strong[2:]], FALLBACK["hybrid"])


def execute(plan: Plan, runners: dict) -> tuple:
    """(DataFrame, outcome): sub-plans are fused by reciprocal ranks; an empty result falls back and says so."""
    from palimpsest.operators.retrieval import rrf, top

    frames = [runners[p]() for p in plan.parts if p in runners]
    if len(frames) > 1:
        out = rrf([top(f, 100).select("id", "rank") for f in frames], 60.0, 1)
    elif frames:
        out = frames[0].select("id", "score")
    else:
        out = None
    if (out is None or out.isEmpty()) and plan.fallback in runners:
        return runners[plan.fallback]().select("id", "score"), f"downgraded_from_{plan.intent}"
    return out, "ok"
