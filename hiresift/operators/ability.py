"""The first steps of the main score: what a candidate has of an offer's required skills, and of the formation it asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions.similarity import token_set_ratio_column
from hiresift.functions.skills import canonical

from .matching import fuzzy_candidates, small
from .scoring import skill_ladder

# What negates a skill that follows, and tools that say little about a candidate.
NEGATIONS = (
    "pas de", "pas d'", "sans ", "aucune", "aucun", "jamais", "no ", "not ", "without", "non ", "zero", "n'ai pas", "n'a pas", "ne pas", "peu utilis", "peu d'exp",
)
GENERIC_TOOLS = (
    "git", "github", "gitlab", "svn", "excel", "word", "powerpoint", "office", "libreoffice", "outlook", "teams", "slack", "zoom", "skype",
    "jira", "confluence", "trello", "notion", "asana", "windows", "linux", "macos",
)
REACH = 60
#: Token-set ratio from which a name is near in spelling.
NEAR = 80.0


def _plain(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[’‘]", "'")


def _negation_before(raw: Column, place: Column) -> Column:
    """Whether a negation stands among the characters before a place (from 1) of a text."""
    before = F.substring(raw, F.greatest(F.lit(1), place - REACH), F.least(F.lit(REACH), place - 1))
    # One pattern: in a lambda over the negations the cut would be made anew for each of them.
    return F.rlike(before, F.lit("|".join(rf"\Q{n}\E" for n in NEGATIONS)))


def affirmed(own: Column, raw: Column) -> Column:
    """Skills of a candidate without those that the text only denies; skills that it does not name stay."""
    text = _plain(raw)

    def denied(skill: Column) -> Column:
        pieces = F.split(text, F.concat(F.lit(r"\Q"), F.lower(skill), F.lit(r"\E")))
        ends = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.right(p, F.lit(REACH)))
        return (F.size(pieces) > 1) & F.forall(ends, lambda p: F.exists(F.array(*map(F.lit, NEGATIONS)), lambda n: F.contains(p, n)))

    return F.filter(own, lambda s: s.isNotNull() & (s != "") & ~denied(s))


#: Columns of what is asked and of what a candidate has, worked out before the two are paired.
ASKED, HAD = "_asked", ("_own", "_raw", "_done")


def _names(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(F.transform(column, canonical)).alias("term")).where("term <> ''").distinct()


def near_names(asked: DataFrame, own: DataFrame, least: float = NEAR) -> DataFrame:
    """(name, spelled): names (column ``term``) with those of the other side that are near in spelling, once for all pairs."""
    met = fuzzy_candidates(asked, own, least, sets=True).where("a <> b")
    near = met.where(token_set_ratio_column(F.col("a"), F.col("b")) >= least)
    return near.groupBy(F.col("a").alias("name")).agg(F.collect_set("b").alias("_spelled"))


def prepared_skills(offers: DataFrame, candidates: DataFrame, ecosystem: DataFrame, key: str, skills: str = "required", title: str | None = "title_skill", into: str = ASKED) -> DataFrame:
    """Offers with an array of the skills asked for: skill, canonical name, weight, and the names that may stand for it.

    ``candidates`` only tells which own names there are.
    """
    listed = ecosystem.groupBy(F.col("skill").alias("name")).agg(F.collect_set("other").alias("_listed"))
    both = ecosystem.select("skill", "other").unionByName(ecosystem.select(F.col("other").alias("skill"), F.col("skill").alias("other")))
    beside = both.groupBy(F.col("skill").alias("name")).agg(F.collect_set("other").alias("_beside"))
    others = beside.join(listed, "name", "left").join(near_names(_names(offers, skills), _names(candidates, "own")), "name", "full")
    one = offers.select(key, (canonical(F.col(title)) if title else F.lit(None).cast("string")).alias("_title"), F.posexplode(skills).alias("place", "skill"))
    one = one.withColumn("name", canonical(F.col("skill"))).join(small(others), "name", "left")
    generic = F.exists(F.array(*map(F.lit, GENERIC_TOOLS)), lambda g: F.startswith("name", g))
    weight = F.when(F.col("name") == F.col("_title"), 3.0).when(generic, 1.0).otherwise(2.0)
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none).alias(c) for c in ("_listed", "_beside", "_spelled")]
    whole = F.struct("place", "skill", "name", F.lower("skill").alias("low"), weight.alias("weight"), *lists)
    # A group is one offer's skills.
    found = one.groupBy(key).agg(F.array_sort(F.collect_list(whole)).alias(into))
    return offers.join(found, key, "left")


def prepared_texts(candidates: DataFrame) -> DataFrame:
    """Candidates with their affirmed skills in canonical form and their plain texts."""
    columns = F.transform(affirmed(F.col("own"), F.col("raw_text")), canonical), _plain(F.col("raw_text")), _plain(F.col("experience_text"))
    return candidates.withColumns(dict(zip(HAD, columns, strict=True)))


def _steps(x: Column) -> tuple[Column, Column, Column, Column]:
    """Whether a skill asked for is extracted, near in spelling, beside an own one, named without negation; for a row of ``prepared_texts``."""
    own, raw, _ = map(F.col, HAD)
    at = F.when(F.contains(raw, x["name"]), F.position(x["name"], raw)).otherwise(F.position(x["low"], raw))
    named = (F.contains(raw, x["name"]) | F.contains(raw, x["low"])) & ~_negation_before(raw, at)
    return F.array_contains(own, x["name"]), F.arrays_overlap(x["_spelled"], own), F.arrays_overlap(x["_beside"], own), named


def _credibility(x: Column) -> Column:
    done = F.col(HAD[2])
    told = F.contains(done, x["low"]) | F.contains(done, x["name"])
    return F.when(F.trim(done) == "", 0.8).when(told, 1.0).when(F.exists(x["_listed"], lambda o: F.contains(done, o)), 0.8).otherwise(0.6)


def _source(x: Column) -> Column:
    exact, fuzzy, near, named = _steps(x)
    return F.when(exact, "extracted").when(fuzzy, "fuzzy").when(near, "ecosystem").when(named, "text")


def _value(x: Column) -> Column:
    exact, fuzzy, near, named = _steps(x)
    return skill_ladder(exact, F.when(fuzzy, 100).otherwise(0), near, named, _credibility(x))


def found_share(asked: Column) -> Column:
    """Share of an array's skills that a candidate has in any way, null without skills."""
    any_of = lambda x: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in _steps(x)])
    return F.when(F.size(asked) > 0, F.size(F.filter(asked, any_of)) / F.size(asked))


def required_skills(pairs: DataFrame, ecosystem: DataFrame, key: str = "id") -> DataFrame:
    """(key, place, skill, weight, source, credibility, value): one row for each required skill of a pair.

    ``pairs`` has required and own (arrays), raw_text, experience_text and
    title_skill; ``ecosystem`` (skill, other) lists skills that stand for others. A
    skill counts as extracted, near in spelling, beside another in its ecosystem, or
    named in the text without negation, in that order; the one of the title weighs
    3, generic tools 1, others 2. It is credible by 1 if the experiences name it, 0.8
    if they name one that stands for it or are not there, 0.6 otherwise.
    """
    rows = prepared_texts(prepared_skills(pairs, pairs, ecosystem, key))
    seen = lambda x: F.struct(
        x["place"].alias("place"), x["skill"].alias("skill"), x["weight"].alias("weight"), _source(x).alias("source"), _credibility(x).alias("credibility"), _value(x).alias("value")
    )
    return rows.select(key, F.inline(F.transform(ASKED, seen)))


def ability(pairs: DataFrame, ecosystem: DataFrame, key: str = "id") -> DataFrame:
    """The pairs with their skills score from 0 to 1 (0.5 without required skills), and the matched and missing skills in order.

    Pairs may bring what ``prepared_skills`` and ``prepared_texts`` make of their offers and
    candidates; a pair's skills then stay an array in its row, and nothing is shuffled.
    """
    rows = pairs if ASKED in pairs.columns else prepared_skills(pairs, pairs, ecosystem, key)
    rows = rows if HAD[0] in rows.columns else prepared_texts(rows)
    none = F.array().cast("array<string>")
    total = lambda f: F.aggregate(ASKED, F.lit(0.0), lambda s, x: s + f(x))
    share = total(lambda x: x["weight"] * _value(x)) / F.greatest(F.lit(1.0), total(lambda x: x["weight"]))
    score = F.when(F.coalesce(F.size(ASKED), F.lit(0)) <= 0, 0.5).otherwise(F.floor(F.least(F.lit(1.0), share) * 10_000 + 0.5) / 10_000)
    picked = lambda keep: F.coalesce(F.transform(F.filter(ASKED, keep), lambda x: x["skill"]), none)
    found = rows.withColumns({"skills": score, "matched": picked(lambda x: _source(x).isNotNull()), "missing": picked(lambda x: _source(x).isNull())})
    return found.drop(ASKED, *HAD)


def formation(required: Column, level: Column, prestige: Column, compatibility: Column, cosine: Column) -> Column:
    """Formation score: the level's share of the required one, moved by prestige, then by the fit of the study domain."""
    four = lambda value: F.floor(value * 10_000 + 0.5) / 10_000
    asked = F.coalesce(required, F.lit(0)) > 0
    share = F.when(~asked | (level >= required), 1.0).otherwise(four(F.greatest(F.lit(0.0), F.coalesce(level, F.lit(0)) / required)))
    moved = four(share * (0.70 + 0.30 * prestige))
    fit = compatibility * 0.65 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.5)))) * 0.35
    return F.when(asked, four(moved * 0.65 + fit * 0.35)).otherwise(moved)
