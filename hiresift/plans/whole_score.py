"""The whole score from offers and profiles to the decision, over all matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.operators import match_plan

from .recruiting import matches, scan
from .registry import Registry

registry = Registry()
query = registry.query

#: Skills that offers and profiles draw from by id; no two of them are near in spelling.
SKILLS = ("python", "react", "sql", "java", "docker", "kubernetes", "rust", "terraform")
#: (skill, other) that stands for it.
ECOSYSTEM = (("docker", "kubernetes"), ("sql", "python"), ("terraform", "docker"), ("rust", "java"))
DOMAINS = ("2511", "2512", "2519", "3313", "4110")
ADJACENT = (("2511", "3313"), ("2512", "4110"))
#: (place, domain, keyword) of study domains, found in names of parts and customers' segments.
STUDY = ((0, "mecanique", "gear"), (0, "mecanique", "bolt"), (1, "habitat", "furniture"), (1, "habitat", "household"), (2, "industrie", "machinery"), (2, "industrie", "steel"), (3, "transport", "automobile"))
STUDY_ADJACENT = (("mecanique", "industrie"), ("mecanique", "transport"))


def _skill(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SKILLS)), (index % len(SKILLS)).cast("int") + 1)


def _code(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (index % len(DOMAINS)).cast("int") + 1)


def offers(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("p_partkey")
    title = F.element_at(F.array(*map(F.lit, ("chef", "senior", "stage", "poste"))), (o % 4).cast("int") + 1)
    return scan(spark, d, "part").select(
        o.alias("offer_id"), F.concat_ws(" ", title, "p_name").alias("titre"), F.col("p_type").alias("description"),
        F.array(_skill(o), _skill(F.floor(o / 8)), _skill(F.floor(o / 64))).alias("required"),
        F.when(o % 3 == 0, F.array(_skill(o + 2), _skill(o + 5))).alias("appreciated_skills"), F.when(o % 5 != 0, _skill(o)).alias("title_skill"),
        (o % 6).alias("required_years"), (o % 5).alias("required_level"), (o % 6).alias("offer_level"), _code(F.col("p_size")).alias("offer_domain"), (o % 4 + 1).alias("offer_role"),
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    job = lambda title, months: F.struct(title.alias("title"), F.lit(None).cast("string").alias("company"), F.lit("").alias("description"), months.alias("months"))
    first = job(F.concat_ws(" ", F.lit("dev"), _skill(c), _skill(c + 1)), c % 40)
    second = job(F.when(c % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("lead "), _skill(c + 6))), F.lit(24).cast("long"))
    return scan(spark, d, "customer").select(
        c.alias("candidate_id"), F.array(_skill(c), _skill(F.floor(c / 8))).alias("own"),
        F.concat(F.lit("je connais "), _skill(c + 3), F.lit("; pas de "), _skill(c + 5)).alias("raw_text"), F.array(first, second).alias("jobs"),
        (c % 9).alias("years"), (c % 7).alias("level"), F.col("c_mktsegment").alias("specialty"), ((c % 5) / F.lit(4.0)).alias("prestige"), (c % 7).alias("candidate_level"),
        F.when(c % 11 != 0, _code(F.col("c_nationkey"))).alias("candidate_domain"), (c % 4 + 1).alias("candidate_role"),
    )


def _case(name: str, values: tuple) -> str:
    return f"CASE {name} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _sk(index: str) -> str:
    return f"[{', '.join(repr(s) for s in SKILLS)}][CAST({index} AS BIGINT) % 8 + 1]"


def _study(text: str) -> str:
    hits = [(place, domain, " + ".join(f"CASE WHEN contains({text}, '{k}') THEN 1 ELSE 0 END" for p, _, k in STUDY if p == place)) for place, domain in dict.fromkeys((p, x) for p, x, _ in STUDY)]
    most = f"greatest({', '.join(h for _, _, h in hits)})"
    return f"CASE WHEN {most} = 0 THEN NULL " + " ".join(f"WHEN {h} = {most} THEN '{x}'" for _, x, h in hits) + " END"


_STANDS = "[" + ", ".join(f"{{'s': '{a}', 'o': '{b}'}}" for a, b in ECOSYSTEM) + "]"


def _expand(names: str) -> str:
    return f"list_distinct(list_concat({names}, list_transform(list_filter({_STANDS}, lambda e: list_contains({names}, e.s)), lambda e: e.o)))"


_WEIGHT = """CASE WHEN share >= 0.25 OR share * 0.80 + 0.0 * 0.20 >= 0.40 THEN 1.0 WHEN share >= 0.10 OR share * 0.80 + 0.0 * 0.20 >= 0.20 THEN 0.55
    WHEN share >= 0.03 OR share * 0.80 + 0.0 * 0.20 >= 0.10 THEN 0.20 ELSE 0.05 END::DOUBLE"""
_ADJ = " OR ".join(f"(od, cd) IN (('{a}', '{b}'), ('{b}', '{a}'))" for a, b in ADJACENT)
_STUDY_ADJ = " OR ".join(f"(os, cs) IN (('{a}', '{b}'), ('{b}', '{a}'))" for a, b in STUDY_ADJACENT)


def _found(skill: str) -> str:
    """Step of the ladder for a skill: own and affirmed 1, beside an own one 0.9, named without negation 0.7."""
    beside = " OR ".join(f"({skill} = '{a}' AND list_contains(own, '{b}')) OR ({skill} = '{b}' AND list_contains(own, '{a}'))" for a, b in ECOSYSTEM)
    return f"CASE WHEN list_contains(own, {skill}) THEN 1.0 WHEN {beside} THEN 0.9 WHEN {skill} = said THEN 0.7 ELSE 0.0 END::DOUBLE"


def _credible(skill: str) -> str:
    listed = " OR ".join(f"({skill} = '{a}' AND contains(done, '{b}'))" for a, b in ECOSYSTEM)
    return f"CASE WHEN contains(done, {skill}) THEN 1.0 WHEN {listed} THEN 0.8 ELSE 0.6 END::DOUBLE"


@query(f"""WITH o AS (SELECT p_partkey AS offer_id, [{_sk('p_partkey')}, {_sk('floor(p_partkey / 8)')}, {_sk('floor(p_partkey / 64)')}] AS required,
      CASE WHEN p_partkey % 3 = 0 THEN [{_sk('p_partkey + 2')}, {_sk('p_partkey + 5')}] END AS liked, CASE WHEN p_partkey % 5 <> 0 THEN {_sk('p_partkey')} END AS central,
      p_partkey % 6 AS ry, p_partkey % 5 AS rl, p_partkey % 6 AS ol, {_case('p_size % 5', DOMAINS)} AS od, p_partkey % 4 + 1 AS orole,
      {_case('p_partkey % 4', ('management', 'senior', 'junior', 'tech'))} AS kind, {_study("lower(p_name || ' ' || p_type)")} AS os FROM part),
  p AS (SELECT c_custkey AS candidate_id, list_filter([{_sk('c_custkey')}, {_sk('floor(c_custkey / 8)')}], lambda s: s <> {_sk('c_custkey + 5')}) AS own,
      [{_sk('c_custkey')}, {_sk('floor(c_custkey / 8)')}] AS claimed, {_sk('c_custkey + 3')} AS said,
      ['dev', {_sk('c_custkey')}, {_sk('c_custkey + 1')}] AS w1, CASE WHEN c_custkey % 40 > 0 THEN (c_custkey % 40) / 12.0::DOUBLE ELSE 1.0 END AS y1,
      CASE WHEN c_custkey % 3 <> 0 THEN ['lead', {_sk('c_custkey + 6')}] END AS w2, c_custkey % 9 AS cy, c_custkey % 7 AS cl, (c_custkey % 5) / 4.0::DOUBLE AS prestige,
      CASE WHEN c_custkey % 11 <> 0 THEN {_case('c_nationkey % 5', DOMAINS)} END AS cd, c_custkey % 4 + 1 AS crole, {_study('lower(c_mktsegment)')} AS cs FROM customer),
  q AS (SELECT *, array_to_string(w1, ' ') || COALESCE(' ' || array_to_string(w2, ' '), '') AS done, {_expand('w1')} AS e1, {_expand('w2')} AS e2 FROM p),
  r AS (SELECT m.id, o.*, q.* EXCLUDE (candidate_id), {_expand('list_distinct(required)')} AS wanted FROM (SELECT DISTINCT offer_id * 10000000 + candidate_id AS id, offer_id, candidate_id FROM matches) m JOIN o USING (offer_id) JOIN q USING (candidate_id)),
  a AS (SELECT *, list_transform(required, lambda s: CASE WHEN s = central THEN 3.0 ELSE 2.0 END::DOUBLE) AS ws, list_transform(required, lambda s: ({_found('s')}) * ({_credible('s')})) AS vs,
      len(list_intersect(wanted, e1)) / greatest(len(wanted), 1)::DOUBLE AS s1, len(list_intersect(wanted, e2)) / greatest(len(wanted), 1)::DOUBLE AS s2 FROM r),
  b AS (SELECT *, floor(least(1.0, (ws[1] * vs[1] + ws[2] * vs[2] + ws[3] * vs[3]) / greatest(1.0, ws[1] + ws[2] + ws[3])) * 10000 + 0.5) / 10000 AS skills,
      floor((y1 * ({_WEIGHT.replace('share', 's1')}) + 2.0 * CASE WHEN w2 IS NULL THEN 0.5 ELSE {_WEIGHT.replace('share', 's2')} END) * 100 + 0.5) / 100 AS domain_years,
      CASE WHEN cs IS NULL OR os IS NULL THEN 0.80 WHEN cs = os THEN 1.0 WHEN {_STUDY_ADJ} THEN 0.75 ELSE 0.45 END::DOUBLE AS compatibility,
      CASE WHEN od IS NULL OR cd IS NULL THEN 'unknown' WHEN od = cd THEN 'same' WHEN {_ADJ} THEN 'adjacent' WHEN substring(od, 1, 2) = substring(cd, 1, 2) THEN 'same_major' ELSE 'different' END AS relation FROM a),
  c AS (SELECT *, least(1.0, greatest(0.0, domain_years / ry)) AS dr, least(1.0, greatest(0.0, cy / ry::DOUBLE)) AS tr, floor((CASE WHEN rl <= 0 OR cl >= rl THEN 1.0 ELSE floor(greatest(0.0, cl / rl::DOUBLE) * 10000 + 0.5) / 10000 END::DOUBLE
      * (0.70::DOUBLE + 0.30::DOUBLE * prestige)) * 10000 + 0.5) / 10000 AS moved FROM b),
  d AS (SELECT *, CASE WHEN ry <= 0 THEN 1.0 ELSE floor(greatest(0.0, least(1.0, dr * 0.40 + tr * 0.30 + (dr + tr) / 2.0 * 0.30)) * 10000 + 0.5) / 10000 END::DOUBLE AS experience,
      CASE WHEN rl > 0 THEN floor((moved * 0.65 + (compatibility * 0.65::DOUBLE + 0.5::DOUBLE * 0.35::DOUBLE) * 0.35) * 10000 + 0.5) / 10000 ELSE moved END::DOUBLE AS formation,
      CASE WHEN relation IN ('same', 'adjacent') THEN orole - crole ELSE 0 END AS rg,
      CASE WHEN liked IS NULL THEN 0.0 ELSE (CASE WHEN ({_found('liked[1]')}) > 0 THEN 1 ELSE 0 END + CASE WHEN ({_found('liked[2]')}) > 0 THEN 1 ELSE 0 END) / 2.0 END::DOUBLE AS appreciated,
      central IS NOT NULL AND NOT list_contains(claimed, central) AS central_missing, ol >= 4 AND cl BETWEEN 1 AND 2 AS tj, ol <= 1 AND cl >= 4 AS ts FROM c),
  e AS (SELECT *, CASE WHEN skills <= 0.40 THEN experience * (skills + 0.5) ELSE experience END AS few FROM d),
  f AS (SELECT *, CASE WHEN tj THEN greatest(0.0, skills - (ol - cl) * 0.10::DOUBLE) WHEN ts THEN least(0.85, skills) ELSE skills END AS ability,
      greatest(0.0, CASE WHEN tj THEN few - (ol - cl) * 0.15::DOUBLE ELSE few END - CASE WHEN rg >= 2 THEN 0.15 WHEN rg = 1 THEN 0.07 ELSE 0.0 END) AS practice FROM e),
  g AS (SELECT *, CASE kind WHEN 'junior' THEN ability * 0.45 + 0.5::DOUBLE * 0.25::DOUBLE + practice * 0.05 + formation * 0.25 WHEN 'senior' THEN ability * 0.40 + 0.5::DOUBLE * 0.20::DOUBLE + practice * 0.30 + formation * 0.10
      WHEN 'management' THEN ability * 0.35 + 0.5::DOUBLE * 0.25::DOUBLE + practice * 0.25 + formation * 0.15 ELSE ability * 0.55 + 0.5::DOUBLE * 0.20::DOUBLE + practice * 0.15 + formation * 0.10 END AS base,
      CASE kind WHEN 'junior' THEN 65 WHEN 'senior' THEN 70 WHEN 'management' THEN 68 ELSE 68 END AS good FROM f),
  h AS (SELECT *, greatest(0.04, least(0.95, base * CASE relation WHEN 'same' THEN 1.0 WHEN 'adjacent' THEN 0.70 WHEN 'same_major' THEN 0.50 WHEN 'different' THEN 0.15 ELSE 1.0 END)) + appreciated * 0.12 AS v0 FROM g),
  i AS (SELECT *, CASE WHEN central_missing AND relation IN ('same', 'unknown') THEN v0 * 0.50 ELSE v0 END AS v1 FROM h),
  j AS (SELECT *, CASE WHEN ability <= 0.05 AND relation = 'different' THEN least(v1, 0.12) ELSE v1 END AS v2 FROM i),
  k AS (SELECT *, floor(greatest(0.05, least(0.95, v2)) * 10000 + 0.5) / 10000 AS score FROM j)
  SELECT id, skills, domain_years, experience, formation, relation, score, CASE WHEN score * 100 >= 75 THEN 'Excellent profil' WHEN score * 100 >= good THEN 'Bon profil' WHEN score * 100 >= 42 THEN 'Profil partiel' ELSE 'Profil non adapté' END AS decision FROM k""")
def whole_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of an offer and a candidate that match, scored from the offer and the profile."""
    pairs = matches(spark, d).select("offer_id", "candidate_id").distinct()
    two = lambda rows: spark.createDataFrame(list(rows), "a string, b string")
    found = match_plan.scored(
        pairs.withColumn("id", F.col("offer_id") * 10_000_000 + F.col("candidate_id")), offers(spark, d), profiles(spark, d), two(ECOSYSTEM).toDF("skill", "other"), two(ADJACENT),
        spark.createDataFrame(list(STUDY), "place int, domain string, keyword string"), two(STUDY_ADJACENT),
    )
    return found.select("id", "skills", "domain_years", "experience", "formation", "relation", "score", "decision")
