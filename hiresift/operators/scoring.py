"""Scores of (offer, candidate) pairs and their explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions import scores, skills, text
from hiresift.functions.similarity import best_token_set

# Weights of the heuristic score, before they are brought to a sum of 1.
HEURISTIC_WEIGHTS = {"skills": 0.45, "experience": 0.25, "education": 0.20, "location": 0.10, "semantic": 0.12}


def ratio_to(own: Column, required: Column, neutral: float, none_is_zero: bool = False) -> Column:
    """min(1, own / required); neutral where nothing is required."""
    own = F.coalesce(own, F.lit(0))
    value = F.least(F.lit(1.0), own / required)
    if none_is_zero:
        value = F.when(own > 0, value).otherwise(F.lit(0.0))
    return F.when(F.coalesce(required, F.lit(0)) > 0, value).otherwise(F.lit(neutral))


def prepared_offers(offers: DataFrame) -> DataFrame:
    """Offers with their single skills in canonical form, the years and the level they ask for: once an offer, before any join."""
    asked = F.concat_ws("\n", F.coalesce("description", F.lit("")), F.coalesce("titre", F.lit("")))
    years = F.coalesce(F.col("experience_requise").cast("double"), text.required_years(asked))
    return offers.withColumn("_required", skills.offer_skills(F.col("competences_requises"))).withColumns(
        {"_wanted": F.transform("_required", skills.canonical), "_years": years, "_level": text.required_education(asked)}
    )


def prepared_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with their distinct skills in canonical form: once a candidate, before any join."""
    return candidates.withColumn("_have", F.array_distinct(F.transform(skills.candidate_skills(F.col("competences")), skills.canonical)))


def heuristic(pairs: DataFrame, semantic: Column | None = None) -> DataFrame:
    """Heuristic score of pairs with its components.

    Pairs hold titre, description, localisation, competences_requises,
    experience_requise of the offer, and competences, raw_text, years, level of
    the candidate, or what ``prepared_offers`` and ``prepared_candidates`` make of
    them. Without a semantic column its weight is 0.
    """
    pairs = pairs if "_wanted" in pairs.columns else prepared_offers(pairs)
    pairs = pairs if "_have" in pairs.columns else prepared_candidates(pairs)
    prepared = pairs.withColumn("_fuzzy", best_token_set(F.col("_wanted"), F.col("_have")))
    each = F.zip_with("_wanted", "_fuzzy", lambda w, f: F.when(F.array_contains("_have", w), F.lit(1.0)).otherwise(f / 100))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    parts = {
        "skills": F.when(F.size("_required") > 0, total / F.size("_required")).otherwise(F.lit(0.5)),
        "experience": ratio_to(F.col("years"), F.col("_years"), 0.5),
        "education": ratio_to(F.col("level"), F.col("_level"), 0.5, none_is_zero=True),
        "location": text.location_score(F.col("localisation"), F.col("raw_text")),
        "semantic": F.lit(0.5) if semantic is None else semantic,
    }
    weights = HEURISTIC_WEIGHTS | ({"semantic": 0.0} if semantic is None else {})
    out = prepared.withColumns({f"score_{k}": v for k, v in parts.items()})
    score = scores.weighted({k: (F.col(f"score_{k}"), weights[k]) for k in parts})
    return out.withColumn("score", score).drop("_required", "_wanted", "_have", "_fuzzy", "_years", "_level")


# Threshold for a good profile and weights by kind of offer.
OFFER_KINDS = {
    "junior": (65, 0.45, 0.25, 0.05, 0.25),
    "senior": (70, 0.40, 0.20, 0.30, 0.10),
    "management": (68, 0.35, 0.25, 0.25, 0.15),
    "tech": (68, 0.55, 0.20, 0.15, 0.10),
}


def multidimensional(pairs: DataFrame) -> DataFrame:
    """Score of pairs from measured components.

    Pairs hold skills, experience, formation, semantic (0 to 1), offer_kind,
    relation of the domains, offer_level, candidate_level, role_gap, appreciated
    (rate, null without such skills), central_missing, expert_doubt, penalty.
    """
    gap = F.col("offer_level") - F.col("candidate_level")
    too_junior = (F.col("offer_level") >= 4) & F.col("candidate_level").between(1, 2)
    too_senior = (F.col("offer_level") <= 1) & (F.col("candidate_level") >= 4)
    ability = (
        F.when(too_junior, F.greatest(F.lit(0.0), F.col("skills") - gap * 0.10))
        .when(too_senior, F.least(F.lit(0.85), F.col("skills")))
        .otherwise(F.col("skills"))
    )
    few = F.when(F.col("skills") <= 0.40, F.col("experience") * (F.col("skills") + 0.5)).otherwise(F.col("experience"))
    role = F.when(F.col("role_gap") >= 2, 0.15).when(F.col("role_gap") == 1, 0.07).otherwise(0.0)
    practice = F.greatest(F.lit(0.0), F.when(too_junior, few - gap * 0.15).otherwise(few) - role)

    def of_kind(place: int) -> Column:
        out = F.lit(OFFER_KINDS["tech"][place])
        for kind, values in OFFER_KINDS.items():
            out = F.when(F.col("offer_kind") == kind, F.lit(values[place])).otherwise(out)
        return out

    base = ability * of_kind(1) + F.col("semantic") * of_kind(2) + practice * of_kind(3) + F.col("formation") * of_kind(4)
    framed = scores.clip(base * scores.domain_multiplier(F.col("relation")), 0.04, 0.95)
    kind = F.coalesce(F.col("relation"), F.lit("unknown"))
    value = framed + F.coalesce(F.col("appreciated"), F.lit(0.0)) * 0.12
    value = F.when(F.col("central_missing") & kind.isin("same", "unknown"), value * 0.50).otherwise(value)
    value = F.when((ability <= 0.05) & (kind == "different"), F.least(value, F.lit(0.12))).otherwise(value)
    value = value - F.least(F.coalesce(F.col("penalty"), F.lit(0.0)), F.lit(0.15))
    value = F.when(F.col("expert_doubt"), F.least(value, F.lit(0.45))).otherwise(value)
    score = F.floor(scores.clip(value, 0.05, 0.95) * 10_000 + 0.5) / 10_000
    percent = score * 100
    decision = (
        F.when(percent >= 75, "Excellent profil").when(percent >= of_kind(0), "Bon profil").when(percent >= 42, "Profil partiel").otherwise("Profil non adapté")
    )
    return pairs.withColumns({"score": score, "decision": decision})


def skill_ladder(exact: Column, fuzzy: Column, neighbour: Column, in_text: Column, credibility: Column) -> Column:
    """Value of one required skill: alias or near spelling 1, related skill 0.9, text mention 0.7; times credibility."""
    step = F.when(exact, 1.0).when(fuzzy >= 80, 1.0).when(neighbour, 0.9).when(in_text, 0.7).otherwise(0.0)
    return step * credibility


def negated(raw: Column, skill: Column, words: tuple[str, ...], reach: int = 60) -> Column:
    """Whether a skill occurs in a text, each time with a negation among the characters before it."""
    pieces = F.split(F.lower(raw), F.concat(F.lit(r"\Q"), F.lower(skill), F.lit(r"\E")))
    before = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    pattern = r"(?U)\b(" + "|".join(words) + r")\b"
    return (F.size(pieces) > 1) & F.forall(before, lambda p: F.right(p, F.lit(reach)).rlike(pattern))


def report(pairs: DataFrame) -> DataFrame:
    """Recommendation, strengths, missing and weak skills, and a sentence.

    Pairs hold score (0 to 1) and details: array of (skill, value).
    """
    strong = F.slice(F.transform(F.filter("details", lambda x: x["value"] >= 0.8), lambda x: x["skill"]), 1, 8)
    missing = F.slice(F.transform(F.filter("details", lambda x: x["value"] <= 0), lambda x: x["skill"]), 1, 6)
    weak = F.slice(F.transform(F.filter("details", lambda x: (x["value"] > 0) & (x["value"] < 0.8)), lambda x: x["skill"]), 1, 5)
    name = scores.band(F.col("score"), scores.RECOMMENDATION, "non recommandé")
    share = F.floor(F.col("score") * 100 + 0.5).cast("int")
    sentence = F.concat(F.lit("Score "), share.cast("string"), F.lit(" % : "), name, F.lit(". Manque : "), F.array_join(missing, ", "))
    return pairs.select("*", name.alias("recommendation"), strong.alias("strengths"), missing.alias("missing"), weak.alias("weak"), sentence.alias("explanation"))


def offer_profile(offers: DataFrame) -> DataFrame:
    """Flags of an offer's text: junior, senior, management, technical."""
    low = F.lower(F.concat_ws(" ", "titre", "description"))

    def names(pattern: str) -> Column:
        return low.rlike(r"(?U)\b(" + pattern + r")\b")

    return offers.withColumns(
        {
            "is_junior": names("junior|stage|stagiaire|débutant|alternance"),
            "is_senior": names("senior|confirmé|expert|lead"),
            "is_management": names("manager|responsable|directeur|directrice|chef"),
        }
    )


def parse_confidence(fields: DataFrame) -> DataFrame:
    """Confidence of a parsed profile as the sum of weights of its parts; a part below 60 % of its weight is weak.

    Fields hold a value from 0 to 1 for each part.
    """
    weights = {"name": 0.12, "email": 0.08, "phone": 0.05, "skills": 0.20, "formations": 0.20, "experiences": 0.20, "languages": 0.08, "coherence": 0.07}
    total = F.lit(0.0)
    for part, weight in weights.items():
        total = total + F.coalesce(F.col(part), F.lit(0.0)) * weight
    missing = F.filter(F.array(*[F.when(F.coalesce(F.col(p), F.lit(0.0)) == 0, F.lit(p)) for p in weights]), lambda x: x.isNotNull())
    weak = F.filter(F.array(*[F.when((F.col(p) > 0) & (F.col(p) < 0.6), F.lit(p)) for p in weights]), lambda x: x.isNotNull())
    return fields.withColumns({"confidence": F.floor(total * 100 + 0.5) / 100, "missing": missing, "weak": weak})
