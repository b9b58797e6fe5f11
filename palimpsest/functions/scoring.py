"""Scalar scores as column expressions. Time is always passed in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Memory type, default importance, decay rate, reliability.
MEMORY_TYPES = [
    ("factual", 0.3, 0.03, 0.85),
    ("episodic", 0.4, 0.10, 0.90),
    ("relational", 0.6, 0.02, 0.75),
    ("emotional", 0.9, 0.01, 0.95),
    ("procedural", 0.5, 0.01, 0.90),
    ("opinion", 0.3, 0.05, 0.60),
    ("causal", 0.7, 0.02, 0.80),
]
#: Parameters of the presets; a preset lists what differs from the default.
PRESETS = {
    "default": dict(mu1=0.15, mu2=0.005, alpha=0.08, interleave_ratio=0.3, replay_boost=0.01, promote=0.25, demote=0.05, archive=0.15, actr_decay=0.5, context_weight=1.5, importance_weight=2.0, contradiction_penalty=3.0, downscale=0.95, forget_threshold=0.01, reward_magnitude=0.15),
    "chatbot": dict(mu1=0.08, mu2=0.003, alpha=0.12, interleave_ratio=0.4, replay_boost=0.015, actr_decay=0.4, context_weight=2.0, downscale=0.96, forget_threshold=0.005, reward_magnitude=0.2),
    "task_agent": dict(mu1=0.25, mu2=0.01, alpha=0.05, interleave_ratio=0.1, replay_boost=0.005, promote=0.35, archive=0.2, actr_decay=0.6, downscale=0.90, forget_threshold=0.02),
    "personal_assistant": dict(mu1=0.12, mu2=0.001, alpha=0.10, interleave_ratio=0.3, replay_boost=0.02, promote=0.20, demote=0.03, actr_decay=0.45, importance_weight=0.7, downscale=0.97, forget_threshold=0.005),
    "researcher": dict(mu1=0.05, mu2=0.001, alpha=0.15, interleave_ratio=0.5, replay_boost=0.025, promote=0.15, demote=0.02, archive=0.10, actr_decay=0.35, context_weight=2.0, importance_weight=0.3, downscale=0.98, forget_threshold=0.001),
}
#: Words of feedback.
POSITIVE_WORDS = ["good", "great", "excellent", "correct", "right", "yes", "thanks", "helpful"]
NEGATIVE_WORDS = ["bad", "wrong", "incorrect", "no", "useless", "unhelpful", "terrible"]


def preset(name: str = "default") -> dict[str, float]:
    return PRESETS["default"] | PRESETS.get(name, {})


def by_type(column: str | Column, place: int, otherwise: float) -> Column:
    """A value of MEMORY_TYPES (1 importance, 2 decay rate, 3 reliability) for a type column; no join needed."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(otherwise)
    for row in MEMORY_TYPES:
        out = F.when(c == row[0], row[place]).otherwise(out)
    return out


def by_type_sql(column: str, place: int, otherwise: float) -> str:
    return f"case {column} " + " ".join(f"when '{r[0]}' then {r[place]}::double" for r in MEMORY_TYPES) + f" else {otherwise}::double end"


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def power_law_term(age_seconds: Column, decay: float) -> Column:
    """One access's share of the base-level sum."""
    return F.pow(F.greatest(age_seconds.cast("double"), F.lit(0.001)), F.lit(-decay))


def spreading(content: Column, keywords: Sequence[str], weight: float) -> Column:
    """The weighted share of the keywords that the content has."""
    if not keywords:
        return F.lit(0.0)
    low = F.lower(F.coalesce(content, F.lit("")))
    hits = sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    return weight * hits / len(keywords)


def normalize_activation(a: Column, center: float = -5.5, scale: float = 1.5) -> Column:
    """Logistic; no activation (null) is 0."""
    return F.coalesce(sigmoid((a - center) / scale), F.lit(0.0))


def stability(memory_type: str, n_accesses: Column, importance: Column, consolidations: Column) -> Column:
    base = 1 / by_type(memory_type, 2, 0.03)
    return base * (1 + 0.5 * F.log(n_accesses.cast("double") + 1)) * (0.5 + importance) * (1 + 0.2 * consolidations)


def retrievability(age_days: Column, s: Column) -> Column:
    return F.when(age_days <= 0, 1.0).otherwise(F.exp(-age_days / s))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, null entries or a zero norm."""
    c = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(F.isnan(c), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def label(x: Column, bands: Sequence[tuple[float, str]], last: str) -> Column:
    out = F.lit(last)
    for least, name in reversed(bands):
        out = F.when(x >= least, name).otherwise(out)
    return out


QUERY_LABELS = [(0.8, "high"), (0.5, "medium"), (0.2, "low")]
RECORD_LABELS = [(0.8, "certain"), (0.6, "likely"), (0.4, "uncertain")]


def label_sql(x: str, bands: Sequence[tuple[float, str]], last: str) -> str:
    return "case " + " ".join(f"when {x} >= {least} then '{name}'" for least, name in bands) + f" else '{last}' end"
