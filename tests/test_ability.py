"""The skills part of the main score, step by step."""

from hiresift.functions import similarity
from hiresift.operators import ability


def test_ladder_weights_and_credibility(spark):
    ecosystem = spark.createDataFrame([("ios", "swift"), ("kubernetes", "docker")], "skill string, other string")
    raw = "Développeuse. Aucune expérience en Java. Bonne pratique du développement et de la qualité dans de nombreux projets : Terraform, Kafka."
    rows = [
        (1, ["Python", "Postgres SQL", "iOS", "Terraform", "Java", "Git", "Cobol"], ["py", "sql postgres", "Swift", "Java", "git"], raw, "Python et swift chez Acme", "python"),
        (2, [], ["x"], raw, "", None),
        (3, None, None, None, None, None),
        (4, ["Docker"], ["Kubernetes"], None, None, "Docker"),
    ]
    pairs = spark.createDataFrame(rows, "id int, required array<string>, own array<string>, raw_text string, experience_text string, title_skill string")
    steps = {(r.id, r.skill): (r.weight, r.source, r.credibility, round(r.value, 4)) for r in ability.required_skills(pairs, ecosystem).collect()}
    assert steps == {
        (1, "Python"): (3.0, "extracted", 1.0, 1.0),
        (1, "Postgres SQL"): (2.0, "fuzzy", 0.6, 0.6),
        (1, "iOS"): (2.0, "ecosystem", 0.8, 0.72),
        (1, "Terraform"): (2.0, "text", 0.6, 0.42),
        (1, "Java"): (2.0, None, 0.6, 0.0),
        (1, "Git"): (1.0, "extracted", 0.6, 0.6),
        (1, "Cobol"): (2.0, None, 0.6, 0.0),
        (4, "Docker"): (3.0, "ecosystem", 0.8, 0.72),
    }
    got = {r.id: (r.skills, r.matched, r.missing) for r in ability.ability(pairs, ecosystem).collect()}
    share = (3 * 1.0 + 2 * 0.6 + 2 * 0.72 + 2 * 0.42 + 1 * 0.6) / 14
    assert got == {
        1: (int(share * 10_000 + 0.5) / 10_000, ["Python", "Postgres SQL", "iOS", "Terraform", "Git"], ["Java", "Cobol"]),
        2: (0.5, [], []),
        3: (0.5, [], []),
        4: (0.72, ["Docker"], []),
    }


def test_skills_of_prepared_pairs_stay_in_their_rows(spark):
    names = ["java", "javas", "java ee", "ee java", "kotlin", "kotlim", "c", "go lang", "golang", "rest api", "api"]
    terms = spark.createDataFrame([(n,) for n in names], "term string")
    want = {a: {b for b in names if a != b and similarity.token_set_ratio(a, b) >= 80} for a in names}
    assert {r.name: set(r._spelled) for r in ability.near_names(terms, terms).collect()} == {a: b for a, b in want.items() if b}
    ecosystem = spark.createDataFrame([("ios", "swift")], "skill string, other string")
    offers = spark.createDataFrame([(1, ["iOS", "Kotlin"], None), (2, [], None)], "offer_id int, required array<string>, title_skill string")
    people = spark.createDataFrame([(5, ["Swift", "Kotlim"], "", "")], "candidate_id int, own array<string>, raw_text string, experience_text string")
    asked, own = ability.prepared_skills(offers, people, ecosystem, "offer_id"), ability.prepared_texts(people)
    pairs = asked.localCheckpoint().crossJoin(own.localCheckpoint())
    found = ability.ability(pairs, ecosystem, "offer_id")
    assert {r.offer_id: (r.skills, r.matched) for r in found.collect()} == {1: (0.76, ["iOS", "Kotlin"]), 2: (0.5, [])}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning" not in plan
