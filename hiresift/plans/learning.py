"""Queries of scores, their combination, evaluation of rankings and labelled sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.functions import scores, skills, text
from hiresift.operators import evaluation, matching, scoring

from .recruiting import candidates, job_offers, matches, scan
from .registry import Registry

registry = Registry()
query = registry.query

#: Components of a pair, read from a line item.
PARTS = {
    "id": "l_orderkey * 10 + l_linenumber",
    "skills": "l_discount * 10",
    "experience": "l_tax * 12.5",
    "education": "(l_quantity % 5) / 4",
    "semantic": "(l_suppkey % 11) / 10.0",
    "gap": "l_linenumber % 4",
}
_PARTS_SQL = """(SELECT l_orderkey * 10 + l_linenumber AS id, l_discount * 10 AS skills, l_tax * 12.5 AS experience, (l_quantity % 5) / 4 AS education,
    (l_suppkey % 11)::DOUBLE / 10.0 AS semantic, l_linenumber % 4 AS gap, l_partkey AS grp FROM lineitem)"""


def parts(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, d, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in PARTS.items()], "l_partkey AS grp")
    return rows.withColumn("semantic", F.col("semantic").cast("double"))


def c(name: str) -> Column:
    return F.col(name)


def six(value: Column) -> Column:
    """Six decimals, so that the order of additions cannot show."""
    return F.floor(value * 1_000_000 + 0.5) / 1_000_000


@query(f"""SELECT id, floor(greatest(0.0, least(1.0, skills * (0.45 / 1.12) + experience * (0.25 / 1.12) + education * (0.20 / 1.12)
    + 1.0 * (0.10 / 1.12) + semantic * (0.12 / 1.12))) * 1000000 + 0.5) / 1000000 AS score FROM {_PARTS_SQL} p""")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    values = {"skills": c("skills"), "experience": c("experience"), "education": c("education"), "location": F.lit(1.0), "semantic": c("semantic")}
    score = scores.weighted({k: (v, scoring.HEURISTIC_WEIGHTS[k]) for k, v in values.items()})
    return parts(spark, d).select("id", six(score).alias("score"))


@query(f"""SELECT id, floor((semantic * 0.6 + skills * (1 - 0.6)) * 1000000 + 0.5) / 1000000 AS score FROM {_PARTS_SQL} p""")
def hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("id", six(scores.hybrid(c("semantic"), c("skills"))).alias("score"))


@query(f"""SELECT id, floor(greatest(0.05, least(0.95, (skills * 0.65 + education * 0.35) * 0.50 + (experience + skills) / 2 * 0.25 + education * 0.15
    + (semantic * 0.35 + skills * 0.65) * 0.10)) * 1000000 + 0.5) / 1000000 AS score FROM {_PARTS_SQL} p""")
def fused_score(spark: SparkSession, d: str) -> DataFrame:
    fused = scores.fusion(c("skills"), c("education"), c("experience"), c("skills"), c("education"), c("semantic"), c("skills"))
    return parts(spark, d).select("id", six(fused).alias("score"))


@query(f"""SELECT id, CASE WHEN s < 0.15 THEN 'HAUTE' WHEN s < 0.30 THEN 'MOYENNE' ELSE 'BASSE' END AS agreement FROM (
    SELECT id, greatest(skills, experience, semantic) - least(skills, experience, semantic) AS s FROM {_PARTS_SQL} p) q""")
def score_agreement(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("id", scores.agreement([c("skills"), c("experience"), c("semantic")]).alias("agreement"))


_FEW = "CASE WHEN skills < 0.10 THEN {0} WHEN skills < 0.20 THEN {1} WHEN skills < 0.35 THEN {2} ELSE 1.0 END"


@query(f"""SELECT id, floor(greatest(0.02, least(0.95, (skills * 0.55 + experience * 0.25 + education * 0.20) * {_FEW.format(0.12, 0.30, 0.60)}
      * CASE WHEN gap >= 3 THEN 0.55 WHEN gap >= 2 THEN 0.72 WHEN gap >= 1 THEN 0.88 ELSE 1.0 END)) * 1000000 + 0.5) / 1000000 AS a,
    floor(greatest(0.02, least(0.95, (skills * 0.50 + experience * 0.28 + education * 0.22) * {_FEW.format(0.10, 0.28, 0.58)} * (1 - gap / 10.0))) * 1000000 + 0.5) / 1000000 AS b,
    floor(greatest(0.10, least(0.95, skills * 0.50 + experience * 0.25 + education * 0.15 + 0.05)) * 1000000 + 0.5) / 1000000 AS c,
    floor(CASE gap WHEN 0 THEN skills * 0.45 + 0.40 WHEN 1 THEN CASE WHEN education >= 0.8 THEN skills * 0.12 + 0.05 WHEN education >= 0.5 THEN skills * 0.18 + 0.12
      ELSE skills * 0.30 + 0.25 END ELSE skills * 0.15 + 0.05 END * (experience * 0.3 + 0.7) * 1000000 + 0.5) / 1000000 AS d FROM {_PARTS_SQL} p""")
def pair_labels(spark: SparkSession, d: str) -> DataFrame:
    s, e, u = c("skills"), c("experience"), c("education")
    kind = F.when(c("gap") == 0, "same").when(c("gap") == 1, "adjacent").otherwise("different")
    return parts(spark, d).select(
        "id",
        six(scores.pair_label_a(s, e, u, c("gap"))).alias("a"),
        six(scores.pair_label_b(s, e, u, F.lit(1) - c("gap") / 10.0)).alias("b"),
        six(scores.pair_label_c(s, e, u)).alias("c"),
        six(scores.pair_label_d(kind, s, e, u)).alias("d"),
    )


@query(f"""SELECT id, CASE WHEN p >= 75 THEN 'excellent' WHEN p >= 55 THEN 'bon' WHEN p >= 35 THEN 'moyen' ELSE 'faible' END AS report,
    CASE WHEN p >= 70 THEN 'fort' WHEN p >= 45 THEN 'moyen' ELSE 'faible' END AS verdict, CASE WHEN p >= 65 THEN 'fort' WHEN p >= 35 THEN 'moyen' ELSE 'faible' END AS dimension,
    CASE WHEN gap <= 2 THEN 'Junior' ELSE 'Confirmé' END AS seniority FROM (SELECT id, gap, semantic * 100 AS p FROM {_PARTS_SQL} x) y""")
def display_bands(spark: SparkSession, d: str) -> DataFrame:
    percent = c("semantic") * 100
    return parts(spark, d).select(
        "id", scores.band(percent, scores.REPORT, "faible").alias("report"), scores.band(percent, scores.CANDIDATE_VERDICT, "faible").alias("verdict"),
        scores.band(percent, scores.DIMENSION, "faible").alias("dimension"), scores.seniority(c("gap")).alias("seniority"),
    )


_KINDS = ("junior", "senior", "management", "tech")
_RELATIONS = ("same", "adjacent", "same_major", "different", "unknown")


def _name(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


@query(f"""WITH p AS (SELECT * REPLACE (skills * 0.93712345::DOUBLE AS skills, semantic * 0.91731234::DOUBLE AS semantic, experience * 0.97654321::DOUBLE AS experience, education * 0.98765432::DOUBLE AS education), id % 4 AS k, id % 5 AS r, id % 6 AS ol, id % 7 AS cl, gap % 3 AS rg FROM {_PARTS_SQL} q),
  a AS (SELECT *, ol >= 4 AND cl BETWEEN 1 AND 2 AS tj, ol <= 1 AND cl >= 4 AS ts, CASE WHEN skills <= 0.40 THEN experience * (skills + 0.5) ELSE experience END AS few FROM p),
  b AS (SELECT *, CASE WHEN tj THEN greatest(0.0, skills - (ol - cl) * 0.10) WHEN ts THEN least(0.85, skills) ELSE skills END AS ability,
        greatest(0.0, CASE WHEN tj THEN few - (ol - cl) * 0.15 ELSE few END - CASE WHEN rg >= 2 THEN 0.15 WHEN rg = 1 THEN 0.07 ELSE 0.0 END) AS practice FROM a),
  w AS (SELECT *, CASE k WHEN 0 THEN ability * 0.45 + semantic * 0.25 + practice * 0.05 + education * 0.25 WHEN 1 THEN ability * 0.40 + semantic * 0.20 + practice * 0.30 + education * 0.10
        WHEN 2 THEN ability * 0.35 + semantic * 0.25 + practice * 0.25 + education * 0.15 ELSE ability * 0.55 + semantic * 0.20 + practice * 0.15 + education * 0.10 END AS base FROM b),
  f AS (SELECT *, greatest(0.04, least(0.95, base * CASE r WHEN 0 THEN 1.0 WHEN 1 THEN 0.70 WHEN 2 THEN 0.50 WHEN 3 THEN 0.15 ELSE 1.0 END)) + gap / 3.0 * 0.12 AS v0 FROM w),
  g AS (SELECT *, CASE WHEN id % 13 = 0 AND r IN (0, 4) THEN v0 * 0.50 ELSE v0 END AS v1 FROM f),
  h AS (SELECT *, CASE WHEN ability <= 0.05 AND r = 3 THEN least(v1, 0.12) ELSE v1 END - least(CASE WHEN id % 17 = 0 THEN 0.2 ELSE 0.0 END, 0.15) AS v2 FROM g)
  SELECT id, floor(greatest(0.05, least(0.95, CASE WHEN id % 19 = 0 THEN least(v2, 0.45) ELSE v2 END)) * 10000 + 0.5) / 10000 AS score FROM h""")
def multidimensional_score(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d).withColumns(
        {
            "skills": c("skills") * 0.93712345,
            "semantic": c("semantic") * 0.91731234,
            "experience": c("experience") * 0.97654321,
            "formation": c("education") * 0.98765432,
            "offer_kind": _name(_KINDS, c("id")),
            "relation": _name(_RELATIONS, c("id")),
            "offer_level": c("id") % 6,
            "candidate_level": c("id") % 7,
            "role_gap": c("gap") % 3,
            "appreciated": c("gap") / 3.0,
            "central_missing": c("id") % 13 == 0,
            "penalty": F.when(c("id") % 17 == 0, 0.2).otherwise(0.0),
            "expert_doubt": c("id") % 19 == 0,
        }
    )
    return scoring.multidimensional(rows).select("id", "score")


@query("""SELECT a, b, CASE WHEN a = b THEN 'same' WHEN abs(a_i - b_i) = 1 THEN 'adjacent' WHEN substring(a, 1, 2) = substring(b, 1, 2) THEN 'same_major' ELSE 'different' END AS relation
    FROM (SELECT x.n_name AS a, y.n_name AS b, x.n_nationkey AS a_i, y.n_nationkey AS b_i FROM nation x CROSS JOIN nation y) p""")
def domain_relation(spark: SparkSession, d: str) -> DataFrame:
    nation = scan(spark, d, "nation")
    a = nation.select(F.col("n_name").alias("a"), F.lit(1).alias("one"))
    pairs = a.join(a.withColumnRenamed("a", "b"), "one")
    x, y = nation.select("n_nationkey", F.col("n_name").alias("a")), nation.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("b"))
    return matching.domain_relation(pairs, x.join(y, "n_nationkey").select("a", "b"), "a", "b").select("a", "b", "relation")


# Heuristic score over nested rows.

_TEXTS = ("Python, React.js et bases de données", "Java Spring Boot Docker Kubernetes", "C# .NET SQL Server", "gestion de projet | Scrum")


@query()
def heuristic_scores(spark: SparkSession, d: str) -> DataFrame:
    """The heuristic score of all matches, skills drawn from a short list by id."""
    offers = job_offers(spark, d).select(
        F.col("id").alias("offer_id"), "titre", F.concat(F.lit("Il faut "), (F.col("id") % 6).cast("string"), F.lit(" ans, bac + 3")).alias("description"),
        F.element_at(F.array(F.lit("Tunis, Paris"), F.lit("")), (F.col("id") % 2).cast("int") + 1).alias("localisation"),
        F.array(_name(_TEXTS, F.col("id"))).alias("competences_requises"), F.lit(None).cast("int").alias("experience_requise"),
    )
    own = F.split(_name(("python|react|sql", "java|spring boot|docker", "csharp|dotnet", "management|agile"), F.col("id")), r"\|")
    people = candidates(spark, d).select(
        F.col("id").alias("candidate_id"), F.transform(own, lambda s: F.struct(s.alias("name"))).alias("competences"),
        F.concat(F.lit("Habite à Paris "), "nom").alias("raw_text"), (F.col("id") % 8).cast("double").alias("years"), (F.col("id") % 6).cast("int").alias("level"),
    )
    about = scan(spark, d, "lineitem").count()
    pairs = matching.looked_up(matches(spark, d).select("id", "offer_id", "candidate_id"), scoring.prepared_offers(offers), "offer_id", about)
    pairs = matching.looked_up(pairs, scoring.prepared_candidates(people), "candidate_id", about)
    scored = scoring.heuristic(pairs)
    return scored.select("id", *[six(F.col(x)).alias(x) for x in ("score_skills", "score_experience", "score_education", "score_location", "score")])


_RAW = "['js', 'React JS', 'sql', 'Postgres', 'k8s', 'docker']"


@query(f"""SELECT id, CAST(len(list_intersect(w, h)) AS DOUBLE) / len(w) AS coverage FROM (SELECT id, list_distinct([CASE a WHEN 'js' THEN 'javascript' WHEN 'react js' THEN 'react'
      WHEN 'postgres' THEN 'postgresql' WHEN 'k8s' THEN 'kubernetes' ELSE a END, 'docker']) AS w,
    list_distinct([CASE b WHEN 'js' THEN 'javascript' WHEN 'react js' THEN 'react' WHEN 'postgres' THEN 'postgresql' WHEN 'k8s' THEN 'kubernetes' ELSE b END, 'javascript']) AS h
    FROM (SELECT c_custkey AS id, lower({_RAW}[c_custkey % 6 + 1]) AS a, lower({_RAW}[c_nationkey % 6 + 1]) AS b FROM customer) x) y""")
def skill_coverage(spark: SparkSession, d: str) -> DataFrame:
    raw = ("js", "React JS", "sql", "Postgres", "k8s", "docker")
    wanted = F.array(_name(raw, F.col("c_custkey")), F.lit("Docker"))
    have = F.array(_name(raw, F.col("c_nationkey")), F.lit("ES6"))
    return scan(spark, d, "customer").select(F.col("c_custkey").alias("id"), skills.coverage(wanted, have).alias("coverage"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, greatest(0, least(e, 24288) - s) AS months FROM (SELECT *,
    year(l_shipdate) * 12 + month(l_shipdate) AS e, year(o_orderdate) * 12 + month(o_orderdate) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey) x""")
def months_worked(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, d, "lineitem").join(scan(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    month = lambda x: F.date_format(x, "yyyy-MM")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        text.months_between(month("o_orderdate"), month("l_shipdate"), F.lit("2023-12")).cast("long").alias("months"),
    )


# Evaluation.

_RANKED = "(SELECT d.source AS grp, d.doc_id AS id, (d.n_chars * 37 % 1009) / 1009.0::DOUBLE AS score, l.quality + l.toxic AS relevance FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = scan(spark, d, "documents"), scan(spark, d, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("relevance"))
    return docs.join(labels, "doc_id").select(
        F.col("source").alias("grp"), F.col("doc_id").alias("id"), ((F.col("n_chars") * 37 % 1009) / F.lit(1009.0)).alias("score"), "relevance"
    )


@query(f"""SELECT grp, n, COALESCE(1.0::DOUBLE / f, 0.0) AS mrr, CASE WHEN n >= 2 THEN h2 / 2.0::DOUBLE END AS p_at_2, CASE WHEN n >= 5 THEN h5 / 5.0::DOUBLE END AS p_at_5,
    CASE WHEN n >= 5 THEN floor(CASE WHEN i5 > 0 THEN g5 / i5 ELSE 0 END * 1000000 + 0.5) / 1000000 END AS ndcg_at_5 FROM (
    SELECT grp, count(*) AS n, min(CASE WHEN relevance >= 1 THEN r END) AS f, count(*) FILTER (WHERE relevance >= 1 AND r <= 2) AS h2,
           count(*) FILTER (WHERE relevance >= 1 AND r <= 5) AS h5, sum(CASE WHEN r <= 5 THEN relevance / log2(r + 1) ELSE 0 END) AS g5,
           sum(CASE WHEN i <= 5 THEN relevance / log2(i + 1) ELSE 0 END) AS i5 FROM (
      SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS r, row_number() OVER (PARTITION BY grp ORDER BY relevance DESC, id) AS i FROM {_RANKED} x) y GROUP BY grp) z""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.ranking_metrics(_ranked(spark, d), "grp", (2, 5))
    return found.select("grp", "n", "mrr", "p_at_2", "p_at_5", six(c("ndcg_at_5")).alias("ndcg_at_5"))


@query(f"""SELECT grp, CAST(h AS DOUBLE) / n AS precision, floor(CASE WHEN i > 0 THEN g / i ELSE 0 END * 1000000 + 0.5) / 1000000 AS ndcg FROM (
    SELECT grp, count(*) FILTER (WHERE r <= 10 AND relevance >= 1) AS h, least(count(*), 10) AS n,
      sum(CASE WHEN r <= 10 THEN (pow(2, relevance) - 1) / CASE WHEN r = 1 THEN 1 ELSE log2(r) END ELSE 0 END) AS g,
      sum(CASE WHEN q <= 10 THEN (pow(2, relevance) - 1) / CASE WHEN q = 1 THEN 1 ELSE log2(q) END ELSE 0 END) AS i FROM (
      SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS r, row_number() OVER (PARTITION BY grp ORDER BY relevance DESC, id) AS q FROM {_RANKED} x) y GROUP BY grp) z""")
def offline_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.offline_metrics(_ranked(spark, d), "grp", 10).withColumn("ndcg", six(c("ndcg")))


@query(f"""SELECT grp, n, CASE WHEN n > 1 THEN 1 - 6.0::DOUBLE * dd / (n * (n * n - 1)) END AS rho, top1 FROM (SELECT grp, count(*) AS n, CAST(sum((a - b) * (a - b)) AS BIGINT) AS dd, bool_or(a = 1 AND b = 1) AS top1 FROM (
    SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY -relevance, id) AS a, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS b FROM {_RANKED} x) y GROUP BY grp) z""")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.spearman(_ranked(spark, d).withColumn("expected", -c("relevance")), "grp", "expected", "score")


@query("""SELECT id, candidate_id, offer_id, CASE status WHEN 'accepted' THEN 1 ELSE 0 END AS label FROM matches WHERE status IN ('accepted', 'rejected')""")
def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.labelled(matches(spark, d)).select("id", "candidate_id", "offer_id", "label")


@query(f"""SELECT id, CASE WHEN skills >= 0.7 AND semantic >= 0.7 THEN 1 WHEN skills <= 0.3 AND semantic <= 0.3 THEN 0 END AS label FROM {_PARTS_SQL} p""")
def pseudo_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.pseudo_labels(parts(spark, d), "skills", "semantic", 0.7, 0.3).select("id", "label")


@query("""SELECT id, CASE WHEN t <= 2 THEN 1 ELSE 0 END AS label FROM (SELECT id, row_number() OVER (PARTITION BY offer_id ORDER BY score_pct DESC, id) AS t,
    row_number() OVER (PARTITION BY offer_id ORDER BY score_pct, id DESC) AS b FROM matches) x WHERE t <= 2 OR b <= 2""")
def extreme_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.extreme_labels(matches(spark, d), "offer_id", "score_pct").select("id", "label")


@query("""SELECT a.n_name AS domain, b.n_name AS other, g.kind, g.rate, g.off AS "offset", g.factor FROM nation a
    JOIN (SELECT * FROM (SELECT 'same' AS kind, 0 AS step, unnest([0.2, 0.4, 0.6, 0.8, 1.0]) AS rate) x CROSS JOIN (SELECT unnest([-1, 0, 1]) AS off) y CROSS JOIN (SELECT unnest([0.5, 1.0, 1.5]) AS factor) z
      UNION ALL SELECT * FROM (SELECT 'adjacent', 1, unnest([0.2, 0.4, 0.6])) x CROSS JOIN (SELECT unnest([-1, 0])) y CROSS JOIN (SELECT 0.5) z
      UNION ALL SELECT * FROM (SELECT 'different', 7, unnest([0.2, 0.4])) x CROSS JOIN (SELECT unnest([-1, 0])) y CROSS JOIN (SELECT 0.5) z) g ON true
    JOIN nation b ON b.n_nationkey = (a.n_nationkey + g.step) % 25""")
def pair_grid(spark: SparkSession, d: str) -> DataFrame:
    domains = scan(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("domain"))
    return evaluation.pair_grid(domains, (0.2, 0.4, 0.6, 0.8, 1.0), (-1, 0, 1), (0.5, 1.0, 1.5))


@query()
def logistic_scores(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions of a logistic regression on labelled matches."""
    rows = evaluation.labelled(matches(spark, d)).join(parts(spark, d).drop("label", "grp"), "id")
    _, validation = evaluation.train_logistic(rows, ("skills", "experience", "education", "semantic"))
    return validation.select("id", "label", "prediction")


@query()
def banded_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.banded_sample(parts(spark, d), "semantic", (0.3, 0.6), 50).select("id", "band", "semantic")


@query()
def seeded_split(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.split(parts(spark, d)).select("id", "part")
