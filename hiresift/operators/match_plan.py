"""The whole score of offers and profiles: skills, domain years, formation, domain and decision, one plan.

What concerns one offer or one profile is worked out before they are paired: skills in
canonical form, the sets that stand for them, the sets of every job, study domains. A
pair then meets them with array functions only; no job or skill is exploded for it but
the required skills, which are a few. What offers ask for travels by the number of its set
and meets a pair last.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions.skills import canonical

from . import ability, domains, scoring
from .matching import domain_relation, small, symmetric

def _none() -> Column:
    return F.array().cast("array<string>")


def four(value: Column) -> Column:
    return F.floor(value * 10_000 + 0.5) / 10_000


def _expansion(ecosystem: DataFrame) -> DataFrame:
    """(name, others): what stands for a skill."""
    return ecosystem.groupBy(F.col("skill").alias("name")).agg(F.collect_set("other").alias("others"))


def _expanded(rows: DataFrame, names: str, ecosystem: DataFrame, key: list[str]) -> DataFrame:
    """(key, expanded): the names of each row's array with what stands for them, distinct; rows without names are left out."""
    one = rows.select(*key, F.explode(names).alias("name")).join(small(_expansion(ecosystem)), "name", "left")
    every = F.array_union(F.array("name"), F.coalesce("others", _none()))
    return one.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_set(every))).alias("expanded"))


def prepared_offers(offers: DataFrame, ecosystem: DataFrame, key: str = "offer_id") -> DataFrame:
    """Offers with ``wanted``, the distinct canonical skills that they require and all that stand for these."""
    own = offers.withColumn("_names", F.array_distinct(F.transform(F.coalesce("required", _none()), canonical)))
    found = _expanded(own, "_names", ecosystem, [key]).withColumnRenamed("expanded", "wanted")
    return own.drop("_names").join(found, key, "left").withColumn("wanted", F.coalesce("wanted", _none()))


def prepared_jobs(profiles: DataFrame, ecosystem: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Profiles with ``practice``, an array (years, names) over their jobs, and ``experience_text``.

    ``jobs`` is an array of structs with title, company, description and months. A job
    without months counts a year; names are the words of three letters and more in
    canonical form with all that stand for them, null for a job without text.
    """
    text = lambda j: F.lower(F.array_join(F.filter(F.array(*[F.btrim(j[f]) for f in ("title", "company", "description")]), lambda t: t.isNotNull() & (t != "")), " "))
    jobs = profiles.select(key, F.posexplode("jobs").alias("place", "job")).select(
        key, "place", text(F.col("job")).alias("text"), F.when(F.col("job.months") > 0, F.col("job.months") / F.lit(12.0)).otherwise(F.lit(1.0)).alias("years")
    )
    words = F.filter(F.array_distinct(F.transform(F.split("text", r"[\s,;/]+"), canonical)), lambda w: F.length(w) >= 3)
    names = _expanded(jobs.withColumn("_names", words), "_names", ecosystem, [key, "place"])
    told = F.when(F.trim("text") != "", F.coalesce("expanded", _none()))
    whole = jobs.join(names, [key, "place"], "left").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("place", "years", told.alias("names")))).alias("practice"),
        F.array_sort(F.collect_list(F.struct("place", "text"))).alias("_texts"),
    )
    joined = F.array_join(F.filter(F.transform("_texts", lambda t: t["text"]), lambda t: t != ""), " ")
    return profiles.join(whole.withColumn("experience_text", joined).drop("_texts"), key, "left").withColumn("experience_text", F.coalesce("experience_text", F.lit("")))


def domain_years(wanted: Column, practice: Column, similarity: Column | None = None) -> Column:
    """Years of all jobs, each weighed by how much of the offer's expanded skills it names.

    In the domain 1, beside it 0.55, far 0.2, outside 0.05; 0.5 for a job without text.
    ``similarity`` is an array of cosines of the jobs with the offer, in their order.
    """

    def shared(job: Column) -> Column:
        # The share is worked out once a job; a lambda would repeat it wherever it is named.
        share = F.size(F.array_intersect(wanted, job["names"])) / F.greatest(F.size(wanted), F.lit(1))
        return F.struct(job["years"].alias("years"), job["names"].isNull().alias("silent"), share.alias("share"))

    def weighed(job: Column, place: Column) -> Column:
        share = job["share"]
        near = F.lit(0.0) if similarity is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.get(similarity, place), F.lit(0.0))))
        fit = share * 0.80 + near * 0.20
        weight = (
            F.when(job["silent"], 0.5).when((share >= 0.25) | (fit >= 0.40), 1.0).when((share >= 0.10) | (fit >= 0.20), 0.55)
            .when((share >= 0.03) | (fit >= 0.10), 0.20).otherwise(0.05)
        )
        return job["years"] * weight

    total = F.aggregate(F.transform(F.transform(practice, shared), weighed), F.lit(0.0), lambda a, x: a + x)
    return F.floor(total * 100 + 0.5) / 100


def experience(required: Column, years: Column, relevant: Column, semantic: Column | None = None) -> Column:
    """Experience score: 40 % years in the domain, 30 % all years, 30 % likeness of the texts; 1 where no years are required."""
    ratio = lambda own: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(own, F.lit(0.0)) / required))
    mean = (ratio(relevant) + ratio(years)) / 2.0
    like = mean if semantic is None else F.coalesce(semantic, mean)
    value = ratio(relevant) * 0.40 + ratio(years) * 0.30 + like * 0.30
    return F.when(F.coalesce(required, F.lit(0)) <= 0, 1.0).otherwise(four(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))))


#: What an offer asks of a candidate's skills, and the distinct values of it up to which they are met apart from the offers.
SKILLS_ASKED = ("required", "appreciated_skills", "title_skill")
MOST_SETS = 20_000


def _sets(offers: DataFrame, key: str = "offer_id") -> tuple[DataFrame, DataFrame, bool]:
    """Offers with the number of their set of skills asked for instead of these, the sets (``_set``), and whether these are few.

    Offers that ask for the same share a set, known by the least of their keys; where sets are many, each offer has its own.
    """
    sets = offers.groupBy(*SKILLS_ASKED).agg(F.min(key).alias("_set"))
    if sets.limit(MOST_SETS + 1).count() > MOST_SETS:
        return offers.withColumn("_set", F.col(key)).drop(*SKILLS_ASKED), offers.select(F.col(key).alias("_set"), *SKILLS_ASKED), False
    own = F.broadcast(sets.withColumnsRenamed({c: f"_own_{c}" for c in SKILLS_ASKED}))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_own_{c}")) for c in SKILLS_ASKED])
    return offers.join(own, same).select(*[c for c in offers.columns if c not in SKILLS_ASKED], "_set"), sets, True


def offer_kind() -> Column:
    """The kind that sets the weights of an offer with flags, the first that holds: management, senior, junior, else technical."""
    return F.when(F.col("is_management"), "management").when(F.col("is_senior"), "senior").when(F.col("is_junior"), "junior").otherwise("tech")


def scored(
    pairs: DataFrame, offers: DataFrame, profiles: DataFrame, ecosystem: DataFrame, adjacency: DataFrame, study: DataFrame, study_adjacency: DataFrame,
) -> DataFrame:
    """The pairs (id, offer_id, candidate_id) with every step of the score as a column, up to the decision.

    Offers hold titre, description, required and appreciated_skills (arrays), title_skill,
    required_years, required_level, offer_level (seniority), offer_domain, offer_role.
    Profiles hold own (array), raw_text, jobs, years, level, specialty, prestige,
    candidate_level, candidate_domain, candidate_role. Pairs may hold semantic, penalty
    and expert_doubt; without them 0.5, 0 and false. ``ecosystem`` (skill, other),
    ``adjacency`` and ``study_adjacency`` (two codes), ``study`` (place, domain, keyword)
    are dictionaries.
    """
    text = F.concat_ws(" ", F.coalesce("titre", F.lit("")), F.coalesce("description", F.lit("")), F.array_join(F.coalesce("required", _none()), " "))
    asked, sets, few = _sets(scoring.offer_profile(offers).withColumns({"offer_kind": offer_kind(), "_text": text}))
    asked = domains.study_domain(asked, study, "_text", into="offer_study").drop("_text")
    prepared = prepared_offers(sets, ecosystem, "_set").withColumn("_title", canonical(F.col("title_skill")))
    for names, title, into in (("required", "title_skill", ability.ASKED), ("appreciated_skills", None, "_liked")):
        prepared = ability.prepared_skills(prepared, profiles, ecosystem, "_set", names, title, into)
    own = ability.prepared_texts(prepared_jobs(profiles, ecosystem)).withColumn("_have", F.transform(F.coalesce("own", _none()), canonical))
    own = domains.study_domain(own, study, "specialty", into="candidate_study")
    if few:
        # Pairs are shuffled with numbers and codes only.
        rows = pairs.join(asked, "offer_id").join(own, "candidate_id").join(F.broadcast(prepared), "_set")
    else:
        rows = pairs.join(asked.join(prepared, "_set"), "offer_id").join(own, "candidate_id")
    near = symmetric(study_adjacency.toDF("a", "b"), "a", "b").groupBy(F.col("a").alias("offer_study")).agg(F.collect_set("b").alias("_adjacent_study"))
    rows = rows.join(small(near), "offer_study", "left")
    for name, default in (("semantic", F.lit(0.5)), ("penalty", F.lit(0.0)), ("expert_doubt", F.lit(False))):
        rows = rows if name in rows.columns else rows.withColumn(name, default)
    rows = ability.ability(rows.withColumn("appreciated", ability.found_share(F.col("_liked"))), ecosystem)
    relevant = F.when((F.size(F.coalesce("practice", F.array())) > 0) & (F.size("wanted") > 0), domain_years(F.col("wanted"), F.col("practice"))).otherwise(F.col("years"))
    rows = rows.withColumn("domain_years", relevant).withColumn("experience", experience(F.col("required_years"), F.col("years"), F.col("domain_years")))
    adjacent = F.array_contains(F.coalesce("_adjacent_study", _none()), F.col("candidate_study"))
    rows = rows.withColumn("compatibility", domains.study_compatibility("candidate_study", "offer_study", adjacent))
    rows = rows.withColumn("formation", ability.formation(F.col("required_level"), F.col("level"), F.col("prestige"), F.col("compatibility"), F.lit(None).cast("double")))
    rows = domain_relation(rows, adjacency)
    close = F.col("relation").isin("same", "adjacent") & (F.col("candidate_role") > 0) & (F.col("offer_role") > 0)
    rows = rows.withColumns(
        {
            "role_gap": F.when(close, F.col("offer_role") - F.col("candidate_role")).otherwise(0),
            "central_missing": F.col("title_skill").isNotNull() & ~F.array_contains("_have", F.col("_title")),
        }
    )
    return scoring.multidimensional(rows).drop("_adjacent_study", "wanted", "practice", "_liked", "_have", "_title", "_set")
