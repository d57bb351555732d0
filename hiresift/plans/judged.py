"""Queries that judge pairs and profiles: contradictions of claimed skills, features, learned scores, networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.operators import claims, learned

from .recruiting import matches, scan
from .registry import Registry

registry = Registry()
query = registry.query

#: (skill, other) that stands for it in experiences; the others are letters of documents, so that both cases occur.
STANDS = (("docker", "kubernetes"), ("django", "tion"))


def claimants(spark: SparkSession, d: str) -> DataFrame:
    """Documents as CVs: the second half of a text is the experience, some claim mastery and some speak of a beginner."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    half = F.substring(text, (F.floor(F.length(text) / 2) + 1).cast("int"), F.length(text))
    skills = F.array(F.regexp_extract(text, "[a-z]{6,}", 0), F.lit("React"), F.when(i % 2 == 0, "django").otherwise(" Docker"), F.lit("React"))
    return scan(spark, d, "documents").select(
        i.alias("candidate_id"), skills.alias("skills"), F.concat(text, F.when(i % 3 == 0, " expert docker, avance en django").otherwise("")).alias("raw_text"),
        F.when(i % 7 != 0, F.array(half, F.when(i % 5 == 0, "notions"))).alias("experiences"),
        F.create_map(F.lit("React"), (i % 10) / F.lit(10.0), F.lit("Docker"), (i % 4) / F.lit(4.0)).alias("likeness"),
    )


def found(spark: SparkSession, d: str) -> DataFrame:
    return claims.contradictions(claimants(spark, d), spark.createDataFrame(list(STANDS), "skill string, other string"), F.col("likeness"))


def _any(text: str, words: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"len(list_filter([{quoted}], lambda w: contains({text}, w))) > 0"


_LEVELS_SQL = f"""t AS (SELECT doc_id AS candidate_id, COALESCE(text, '') AS x FROM documents),
    p AS (SELECT candidate_id, x, lower(x || CASE WHEN candidate_id % 3 = 0 THEN ' expert docker, avance en django' ELSE '' END) AS raw, lower(array_to_string(list_filter(
      CASE WHEN candidate_id % 7 <> 0 THEN [substring(x, length(x) // 2 + 1), CASE WHEN candidate_id % 5 = 0 THEN 'notions' END] ELSE [] END, lambda e: e IS NOT NULL AND trim(e, ' ') <> ''), chr(10))) AS done FROM t),
    q AS (SELECT DISTINCT candidate_id, raw, done, unnest([regexp_extract(x, '[a-z]{{6,}}'), 'React', CASE WHEN candidate_id % 2 = 0 THEN 'django' ELSE 'Docker' END]) AS skill FROM p),
    r AS (SELECT *, lower(skill) AS s, contains(raw, lower(skill)) AS named, done <> '' AND NOT (contains(done, lower(skill)) OR (lower(skill) = 'docker' AND contains(done, 'kubernetes')) OR (lower(skill) = 'django' AND contains(done, 'tion'))) AS unused,
      CASE lower(skill) WHEN 'react' THEN 'javascript' WHEN 'django' THEN 'python' END AS need,
      CASE skill WHEN 'React' THEN (candidate_id % 10) / 10.0::DOUBLE WHEN 'Docker' THEN (candidate_id % 4) / 4.0::DOUBLE END AS likeness, instr(raw, lower(skill)) AS place FROM q WHERE skill <> ''),
    u AS (SELECT *, substring(raw, greatest(1, place - 40), place - greatest(1, place - 40) + length(s) + 80) AS around FROM r),
    levels AS (SELECT candidate_id, skill, CASE WHEN done <> '' AND place > 0 AND {_any('around', claims.EXPERT_CLAIMS)} AND {_any('done', claims.NOVICE_SIGNALS)} THEN 5
      WHEN unused AND NOT named AND likeness < 0.25 THEN 4 WHEN need IS NOT NULL AND NOT contains(raw, need) THEN 3 WHEN unused THEN 2 WHEN NOT named THEN 1 END AS level, need FROM u)"""


@query(f"""WITH {_LEVELS_SQL} SELECT candidate_id, skill, level, CASE level WHEN 5 THEN 'fake_expert_detected' WHEN 4 THEN 'low_context_similarity' WHEN 3 THEN 'missing_ecosystem:' || need
    WHEN 2 THEN 'absent_from_experiences' ELSE 'absent_from_text' END AS reason FROM levels WHERE level IS NOT NULL""")
def skill_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return claims.listed(found(spark, d), "candidate_id")


@query(f"""WITH {_LEVELS_SQL} SELECT d.doc_id AS candidate_id, least(COALESCE(sum(CASE level WHEN 5 THEN 0.15 WHEN 4 THEN 0.08 ELSE 0.0 END::DOUBLE), 0.0), 0.15) AS penalty,
    COALESCE(bool_or(level = 5), false) AS expert_doubt, CASE WHEN bool_or(level = 5) THEN 'BASSE' WHEN bool_or(level = 4) THEN 'MOYENNE' ELSE 'HAUTE' END AS confidence
    FROM documents d LEFT JOIN levels l ON l.candidate_id = d.doc_id GROUP BY d.doc_id""")
def contradiction_costs(spark: SparkSession, d: str) -> DataFrame:
    cost, doubt = claims.deduction(F.col("contradictions"))
    return found(spark, d).select("candidate_id", cost.alias("penalty"), doubt.alias("expert_doubt"), claims.confidence(F.col("contradictions")).alias("confidence"))


# Features of pairs and what is learned from them.


def _offers(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "part").select(F.col("p_partkey").alias("offer_id"), "p_name", "p_type", "p_size")


def _people(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"), "c_name", "c_mktsegment")


def _offer_texts() -> list[Column]:
    return [
        F.col("p_name").alias("titre"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("description"),
        F.when(F.col("p_size") % 3 != 0, F.split("p_type", " ")).alias("required"),
    ]


def _profile_texts() -> list[Column]:
    person = F.col("candidate_id")
    profile = F.to_json(F.struct(
        F.struct((person % 9 + 0.5).alias("annees_experience_totales"), F.when(person % 4 != 0, person % 6).alias("niveau_formation_max")).alias("metadata"),
        F.when(person % 5 != 0, F.split("c_name", "#")).alias("competences"),
    ))
    return [profile.alias("parsed_data"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("raw_text")]


def _pair_texts() -> list[Column]:
    part = lambda value: F.struct(value.alias("score"))
    i, score = F.col("id"), F.col("score_pct") / F.lit(100.0)
    components = F.struct(
        part(score).alias("skills"), part(i % 11 / F.lit(10.0)).alias("experience"), part(F.when(i % 6 != 0, i % 5 / F.lit(4.0))).alias("education"), part(F.lit("?")).alias("location"),
    )
    encoder = F.struct((i % 8 / F.lit(8.0)).alias("bert_semantic"), score.alias("total"), F.when(i % 2 == 0, i % 13 / F.lit(13.0)).alias("total_raw"))
    return [F.to_json(F.struct(components.alias("components"))).alias("details"), F.when(i % 10 != 0, F.to_json(encoder)).alias("encoder_details")]


_KEYS = ("candidate_id", "offer_id", "id", "status", "score_pct")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Matches with the JSON that scoring left, offers and profiles from the tables; some values are missing or no numbers."""
    # Rows are joined narrow; JSON is written where it is read.
    m = matches(spark, d).select("id", "offer_id", "candidate_id", "status", "score_pct")
    met = m.join(_offers(spark, d), "offer_id").join(_people(spark, d), "candidate_id")
    return met.select(*_KEYS, *_pair_texts(), *_offer_texts(), *_profile_texts())


def numbered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with the features of offers and profiles, made once for each of these, instead of their texts."""
    m = matches(spark, d).select("id", "offer_id", "candidate_id", "status", "score_pct")
    offers = learned.offer_features(_offers(spark, d).select("offer_id", *_offer_texts())).select("offer_id", *learned.OFFER_FEATURES)
    people = learned.profile_features(_people(spark, d).select("candidate_id", *_profile_texts())).select("candidate_id", *learned.PROFILE_FEATURES)
    met = m.join(offers, "offer_id").join(people, "candidate_id")
    return met.select(*_KEYS, *_pair_texts(), *learned.OFFER_FEATURES, *learned.PROFILE_FEATURES)


@query("""SELECT m.id, score_pct / 100.0::DOUBLE AS score_skills, (m.id % 11) / 10.0::DOUBLE AS score_experience, CASE WHEN m.id % 6 <> 0 THEN (m.id % 5) / 4.0 ELSE 0 END::DOUBLE AS score_education,
    0.0::DOUBLE AS score_location, 0.0::DOUBLE AS score_semantic, (candidate_id % 9 + 0.5)::DOUBLE AS candidate_years, CASE WHEN candidate_id % 4 <> 0 THEN candidate_id % 6 ELSE 0 END::DOUBLE AS candidate_education_level,
    CASE WHEN candidate_id % 5 <> 0 THEN len(string_split(c_name, '#')) ELSE 0 END::DOUBLE AS candidate_total_skills, CASE WHEN p_size % 3 <> 0 THEN len(string_split(p_type, ' ')) ELSE 0 END::DOUBLE AS required_skills_count,
    length(p_name)::DOUBLE AS offer_title_len, CASE WHEN p_size % 5 <> 0 THEN length(p_type) ELSE 0 END::DOUBLE AS offer_desc_len, length(c_name || ' ' || c_mktsegment)::DOUBLE AS candidate_text_len,
    CASE WHEN m.id % 10 = 0 THEN 0 WHEN m.id % 2 = 0 THEN (m.id % 13) / 13.0::DOUBLE ELSE score_pct / 100.0::DOUBLE END::DOUBLE AS bert_raw, CASE WHEN m.id % 10 <> 0 THEN (m.id % 8) / 8.0 ELSE 0 END::DOUBLE AS bert_semantic, 0.0::DOUBLE AS bert_skills
    FROM matches m JOIN part ON p_partkey = offer_id JOIN customer ON c_custkey = candidate_id""")
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen features of all pairs."""
    rows = learned.PairFeatures(encoder=True).transform(pairs(spark, d))
    return rows.select("id", *learned.ENCODER_FEATURES)


@query()
def learned_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every match scored by a pipeline from its JSON to a probability, learned from the decided ones."""
    every = numbered_pairs(spark, d)
    label = F.when(F.col("status") == "accepted", 1).when(F.col("status") == "rejected", 0)
    model, _ = learned.train(every.withColumn("label", label).where("label is not null"), encoder=True)
    return learned.scored(every, model).select("id", "status", "learned_score", "ready")


def _weight(row: int, column: int) -> float:
    return ((row * 7 + column * 5) % 13 - 6) / 16


#: A network of the shape of seven features with weights by a rule, and the statistics of its normalisation.
NETWORK = {
    "net.0.weight": [[_weight(r, c) for c in range(7)] for r in range(64)], "net.0.bias": [_weight(r, 3) for r in range(64)],
    "net.1.weight": [1 + r % 3 / 4 for r in range(64)], "net.1.bias": [r % 5 / 8 for r in range(64)],
    "net.1.running_mean": [r % 7 / 16 for r in range(64)], "net.1.running_var": [0.5 + r % 4 / 4 for r in range(64)],
    "net.4.weight": [[_weight(c, r) / 8 for c in range(64)] for r in range(32)], "net.4.bias": [_weight(r, 1) for r in range(32)],
    "net.7.weight": [[_weight(1, c) / 4 for c in range(32)]], "net.7.bias": [0.125],
}


def _layer(of: str, name: str, rows: str = "") -> str:
    """Rows of a weight's table times a vector."""
    return f"list_transform({NETWORK[name + '.weight']}::DOUBLE[][], lambda w: list_inner_product(w, {of}))"


def _plus(of: str, bias: list[float]) -> str:
    return f"list_transform(list_zip({of}, {bias}::DOUBLE[]), lambda z: greatest(0, z[1] + z[2]))"


_NORMAL = list(zip(NETWORK["net.0.bias"], NETWORK["net.1.weight"], NETWORK["net.1.bias"], NETWORK["net.1.running_mean"], NETWORK["net.1.running_var"], strict=True))
_SCALES = [g / (v + 1e-5) ** 0.5 for _, g, _, _, v in _NORMAL]
_SHIFTS = [(b - m) * s + c for (b, _, c, m, _), s in zip(_NORMAL, _SCALES, strict=True)]


@query(f"""WITH f AS (SELECT id, [score_pct / 100.0, (id % 11) / 10.0, (id % 5) / 4.0, (id % 8) / 8.0, (id % 13) / 13.0, (offer_id % 7) / 7.0, (candidate_id % 9) / 9.0]::DOUBLE[] AS x FROM matches),
    a AS (SELECT id, list_transform(list_zip({_layer('x', 'net.0')}, {_SCALES}::DOUBLE[], {_SHIFTS}::DOUBLE[]), lambda z: greatest(0, z[1] * z[2] + z[3])) AS x FROM f),
    b AS (SELECT id, {_plus(_layer('x', 'net.4'), NETWORK['net.4.bias'])} AS x FROM a),
    c AS (SELECT id, 1 / (1 + exp(-(list_inner_product({NETWORK['net.7.weight'][0]}::DOUBLE[], x) + {NETWORK['net.7.bias'][0]}))) AS y FROM b)
    SELECT id, floor(y * 1000000 + 0.5) / 1000000 AS network_score, floor((y * 0.10 + 0.5 * 0.90) * 10000 + 0.5) / 10000 AS score FROM c""")
def network_scores(spark: SparkSession, d: str) -> DataFrame:
    """All matches through the network of seven features, and blended with a base of one half."""
    i = F.col("id")
    names = learned.NETWORK_FEATURES[7]
    values: list[Column] = [F.col("score_pct") / F.lit(100.0), i % 11 / F.lit(10.0), i % 5 / F.lit(4.0), i % 8 / F.lit(8.0), i % 13 / F.lit(13.0), F.col("offer_id") % 7 / F.lit(7.0), F.col("candidate_id") % 9 / F.lit(9.0)]
    rows = matches(spark, d).select("id", *[v.alias(n) for n, v in zip(names, values, strict=True)])
    scored = learned.Network.of_state(NETWORK).transform(rows)
    blended = learned.blended(F.lit(0.5), F.col("network_score"), 7)
    return scored.select("id", (F.floor(F.col("network_score") * 1_000_000 + 0.5) / 1_000_000).alias("network_score"), blended.alias("score"))
