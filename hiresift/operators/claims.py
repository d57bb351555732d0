"""Claimed skills against what the CV itself says: contradictions by severity, from the raw texts.

A CV is judged where it is read. Its skills are walked as an array beside its texts, so
no text is copied for a skill and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions.skills import canonical

# What claims mastery near a skill, what betrays a beginner in the experiences, and skills that need another one.
EXPERT_CLAIMS = (
    "expert", "maîtrise avancée", "maitrise avancee", "maitrise avancée", "spécialiste", "specialiste", "fort niveau", "haut niveau",
    "maîtrise complète", "maitrise complete", "avancé", "avance", "confirmé", "confirme", "maitrise",
)
NOVICE_SIGNALS = (
    "notions", "notion", "tutoriel", "tutoriels", "udemy", "coursera", "cours en ligne", "formation en ligne", "jamais en production",
    "jamais utilisé en entreprise", "test personnel", "tests personnels", "quelques instances", "quelques expérimentations",
    "quelques experimentations", "débutant", "debutant", "initiation", "découverte", "decouverte", "pas encore en production",
    "n'ai jamais", "peu d'expérience", "peu d experience", "quelques cours", "autodidacte",
)
NEEDS = {"react": "javascript", "angular": "typescript", "spring": "java", "django": "python", "laravel": "php"}
#: Characters before and after a skill's place in which a claim counts, and the likeness that a context must have.
BEFORE, AFTER, LEAST_LIKENESS = 40, 80, 0.25
#: Skills that an expansion table may have at most: it becomes one value of the plan.
MOST_EXPANDED = 20_000


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _expanded(expansion: DataFrame | None) -> Column:
    """A map from a canonical skill to those that stand for it."""
    held: dict[str, set[str]] = {}
    for r in expansion.select("skill", "other").dropna().distinct().limit(MOST_EXPANDED + 1).collect() if expansion is not None else ():
        held.setdefault(r.skill, set()).add(r.other)
    if sum(map(len, held.values())) > MOST_EXPANDED:
        raise ValueError(f"more than {MOST_EXPANDED} rows of expansion")
    if not held:
        return F.lit(None).cast("map<string,array<string>>")
    return F.create_map(*[c for s, others in sorted(held.items()) for c in (F.lit(s), F.array(*map(F.lit, sorted(others))))])


def contradictions(
    profiles: DataFrame, expansion: DataFrame | None = None, likeness: Column | None = None, into: str = "contradictions",
    expert: tuple[str, ...] = EXPERT_CLAIMS, novice: tuple[str, ...] = NOVICE_SIGNALS,
) -> DataFrame:
    """The profiles with an array (skill, level, reason) of the most severe contradiction of each skill, severest first.

    Profiles hold skills (array), raw_text and experiences (array, a text for each job);
    ``expansion`` (skill, other) lists what stands for a canonical skill in the
    experiences, and ``likeness`` is a map from a skill to how near it is to the
    experiences. Levels: 1 the text does not name the skill; 2 the experiences name
    neither it nor what stands for it; 3 the skill that it needs is not in the text; 4
    named nowhere and not near the experiences; 5 mastery is claimed around its first
    place in the text while the experiences speak of a beginner. 2, 4 and 5 need
    experiences with text. A skill is looked for as written, without case, and in
    canonical form; nulls, blanks and repeated skills are left out, null texts are empty.
    """
    raw = F.lower(F.coalesce("raw_text", F.lit("")))
    done = F.filter("experiences", lambda e: F.trim(e) != "")
    parts = {"_raw": raw, "_done": F.lower(F.coalesce(F.array_join(done, "\n"), F.lit(""))), "_stands": _expanded(expansion)}
    own = F.array_distinct(F.filter(F.transform("skills", lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")))
    rows = profiles.withColumns(parts | {"_like": likeness if likeness is not None else F.lit(None).cast("map<string,double>")})
    rows = rows.withColumns({"_novice": _any(F.col("_done"), novice), "_names": F.transform(own, lambda s: F.struct(s.alias("skill"), F.lower(s).alias("low"), canonical(s).alias("name")))})
    text, work, worked = F.col("_raw"), F.col("_done"), F.col("_done") != ""
    needs = F.create_map(*[F.lit(x) for pair in NEEDS.items() for x in pair])

    def judged(s: Column) -> Column:
        named = F.contains(text, s["low"]) | F.contains(text, s["name"])
        stands = F.exists(F.try_element_at("_stands", s["name"]), lambda o: F.contains(work, o))
        unused = worked & ~(F.contains(work, s["low"]) | F.contains(work, s["name"]) | F.coalesce(stands, F.lit(False)))
        need = F.try_element_at(needs, s["low"])
        lone = need.isNotNull() & ~F.contains(text, need)
        far = F.coalesce(F.try_element_at("_like", s["skill"]) < LEAST_LIKENESS, F.lit(False)) & unused & ~named
        place = F.coalesce(F.nullif(F.instr(text, s["low"]), F.lit(0)), F.instr(text, s["name"]))
        start = F.greatest(F.lit(1), place - BEFORE)
        around = F.substring(text, start, place - start + F.length(s["low"]) + AFTER)
        claimed = (place > 0) & _any(around, expert)
        level = F.when(worked & claimed & F.col("_novice"), 5).when(far, 4).when(lone, 3).when(unused, 2).when(~named, 1)
        reason = (
            F.when(level == 5, "fake_expert_detected").when(level == 4, "low_context_similarity").when(level == 3, F.concat(F.lit("missing_ecosystem:"), need))
            .when(level == 2, "absent_from_experiences").when(level == 1, "absent_from_text")
        )
        return F.struct(s["skill"].alias("skill"), level.alias("level"), reason.alias("reason"))

    # Sorted by severity and then by place, each judged skill named once.
    every = F.filter(F.transform("_names", judged), lambda x: x["level"].isNotNull())
    ordered = F.array_sort(F.transform(every, lambda x, i: F.struct((-x["level"]).alias("rank"), i.alias("place"), x.alias("item"))))
    none = F.array().cast("array<struct<skill:string,level:int,reason:string>>")
    out = rows.withColumn(into, F.coalesce(F.transform(ordered, lambda x: x["item"]), none))
    return out.drop("_raw", "_done", "_stands", "_like", "_novice", "_names")


def listed(found: DataFrame, key: str, column: str = "contradictions") -> DataFrame:
    """(key, skill, level, reason): a row for each contradiction.

    The outer form keeps the optimiser from testing the arrays' size below the plan that
    makes them, which would work out each of them several times.
    """
    return found.select(key, F.inline_outer(column)).where("level is not null")


def deduction(found: Column) -> tuple[Column, Column]:
    """What a profile's contradictions take from its score, at most 0.15, and whether one doubts an expert."""
    each = lambda x: F.when(x["level"] == 4, F.lit(0.08)).when(x["level"] == 5, F.lit(0.15)).otherwise(F.lit(0.0))
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + each(x))
    return F.least(F.coalesce(total, F.lit(0.0)), F.lit(0.15)), F.coalesce(F.exists(found, lambda x: x["level"] == 5), F.lit(False))


def confidence(found: Column) -> Column:
    """How far a score can be trusted, by the severest contradiction."""
    has = lambda n: F.exists(found, lambda x: x["level"] == n)
    return F.when(has(5), "BASSE").when(has(4), "MOYENNE").otherwise("HAUTE")
