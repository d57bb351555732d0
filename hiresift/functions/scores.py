"""Score bands, scaling and combinations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower edges of the bands.
HISTOGRAM = (("excellent", 65.0), ("moyen", 35.0))
CANDIDATE_VERDICT = (("fort", 70.0), ("moyen", 45.0))
DIMENSION = (("fort", 65.0), ("moyen", 35.0))
REPORT = (("excellent", 75.0), ("bon", 55.0), ("moyen", 35.0))
COVERAGE = (("fort", 70.0), ("moyen", 40.0))
RECOMMENDATION = (("recommandé", 0.70), ("à considérer", 0.50), ("réserve", 0.30))
SUMMARY = (("excellent", 0.75), ("bon", 0.55), ("partiel", 0.35))


def band(value: Column, edges: tuple[tuple[str, float], ...], below: str) -> Column:
    """Name of the first band whose lower edge the value reaches."""
    out = F.lit(below)
    for name, edge in reversed(edges):
        out = F.when(value >= edge, F.lit(name)).otherwise(out)
    return out


def percent(score: Column) -> Column:
    """Score from 0 to 1 as a percentage with one decimal; null where it is null or 0."""
    return F.when(score != 0, F.floor(score * 1000 + 0.5) / 10)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def acceptance_rate(accepted: Column, refused: Column) -> Column:
    """Whole percentage of accepted among decided; null if none is decided."""
    return F.floor(F.try_divide(accepted * 100.0, accepted + refused) + 0.5)


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    """Mean of the parts, by weights that are brought to a sum of 1."""
    total = sum(w for _, w in parts.values())
    out = F.lit(0.0)
    for value, weight in parts.values():
        out = out + value * (weight / total)
    return clip(out, 0.0, 1.0)


def hybrid(semantic: Column, heuristic: Column, alpha: float = 0.6) -> Column:
    alpha = min(1.0, max(0.0, alpha))
    return semantic * alpha + heuristic * (1 - alpha)


def fusion(c1: Column, c2: Column, exp1: Column, exp2: Column, formation: Column, s1: Column, s2: Column) -> Column:
    """Fused score of two scorers' skills, experience, education and semantic parts."""
    fused = (c1 * 0.65 + c2 * 0.35) * 0.50 + (exp1 + exp2) / 2 * 0.25 + formation * 0.15 + (s1 * 0.35 + s2 * 0.65) * 0.10
    return clip(fused, 0.05, 0.95)


def agreement(scores: list[Column]) -> Column:
    """How far several scores agree, by their spread."""
    spread = F.greatest(*scores) - F.least(*scores)
    return F.when(spread < 0.15, "HAUTE").when(spread < 0.30, "MOYENNE").otherwise("BASSE")


def agreement_of_positive(scores: list[Column]) -> Column:
    """The same over the scores that are over 0; null if fewer than two are."""
    present = F.filter(F.array(*scores), lambda s: s > 0)
    spread = F.array_max(present) - F.array_min(present)
    named = F.when(spread < 0.15, "HAUTE").when(spread < 0.30, "MOYENNE").otherwise("BASSE")
    return F.when(F.size(present) >= 2, named)


def pair_label_a(skills: Column, experience: Column, education: Column, gap: Column) -> Column:
    """Closed-form label: weighted parts, cut for few skills and for a gap in education."""
    base = skills * 0.55 + experience * 0.25 + education * 0.20
    few = F.when(skills < 0.10, 0.12).when(skills < 0.20, 0.30).when(skills < 0.35, 0.60).otherwise(1.0)
    short = F.when(gap >= 3, 0.55).when(gap >= 2, 0.72).when(gap >= 1, 0.88).otherwise(1.0)
    return clip(base * few * short, 0.02, 0.95)


def pair_label_b(skills: Column, experience: Column, education: Column, compatibility: Column) -> Column:
    base = skills * 0.50 + experience * 0.28 + education * 0.22
    few = F.when(skills < 0.10, 0.10).when(skills < 0.20, 0.28).when(skills < 0.35, 0.58).otherwise(1.0)
    return clip(base * few * compatibility, 0.02, 0.95)


def pair_label_c(skills: Column, experience: Column, education: Column) -> Column:
    return clip(skills * 0.50 + experience * 0.25 + education * 0.15 + 0.10 * 0.5, 0.10, 0.95)


def pair_label_d(kind: Column, skills: Column, experience: Column, gap: Column) -> Column:
    """Label by the relation of the two domains, without its noise."""
    adjacent = F.when(gap >= 0.8, skills * 0.12 + 0.05).when(gap >= 0.5, skills * 0.18 + 0.12).otherwise(skills * 0.30 + 0.25)
    base = F.when(kind == "same", skills * 0.45 + 0.40).when(kind == "adjacent", adjacent).otherwise(skills * 0.15 + 0.05)
    return base * (experience * 0.3 + 0.7)


def experience_helper(ratio: Column) -> Column:
    return F.when(ratio >= 1, F.least(F.lit(1.0), F.least(ratio / 1.5, F.lit(1.0)) * 0.3 + 0.7)).otherwise(ratio * 0.8)


def education_helper(required: Column, level: Column) -> Column:
    gap = F.greatest(required - level, F.lit(0))
    return F.when(F.coalesce(required, F.lit(0)) <= 0, F.lit(0.8)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - gap * 0.2))


def domain_multiplier(kind: Column) -> Column:
    return (
        F.when(kind == "same", 1.0).when(kind == "adjacent", 0.70).when(kind == "same_major", 0.50).when(kind == "different", 0.15).otherwise(1.0)
    )


def seniority(years: Column) -> Column:
    return F.when(years <= 2, "Junior").when(years <= 5, "Confirmé").when(years <= 10, "Senior").otherwise("Expert")


def skill_level(years: Column) -> Column:
    return (
        F.when(years.isNull(), "Non spécifié").when(years <= 2, "Débutant").when(years <= 5, "Intermédiaire").when(years <= 10, "Avancé").otherwise("Expert")
    )
