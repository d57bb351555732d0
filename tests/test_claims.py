"""Contradictions of claimed skills against a plain version, and by hand."""

import random

from pyspark.sql import functions as F

from hiresift.operators import claims

SCHEMA = "id int, skills array<string>, raw_text string, experiences array<string>, likeness map<string,double>"
ALIAS = {"js": "javascript", "k8s": "kubernetes"}
EXPANSION = [("swift", "ios"), ("docker", "kubernetes")]


def plain(skills, raw, jobs, likeness):
    raw, jobs = (raw or "").lower(), [j for j in jobs or [] if j and j.strip(" ")]
    work, out = "\n".join(jobs).lower(), {}
    for s in skills or []:
        s = (s or "").strip(" ")
        if not s or s in out:
            continue
        low = s.lower()
        name = ALIAS.get(" ".join(low.split()), " ".join(low.split()))
        levels = []
        named = low in raw or name in raw
        unused = bool(jobs) and not (low in work or name in work or any(o in work for k, o in EXPANSION if k == name))
        if not named:
            levels.append((1, "absent_from_text"))
        if unused:
            levels.append((2, "absent_from_experiences"))
        if low in claims.NEEDS and claims.NEEDS[low] not in raw:
            levels.append((3, f"missing_ecosystem:{claims.NEEDS[low]}"))
        if unused and not named and (likeness or {}).get(s, 1.0) < 0.25:
            levels.append((4, "low_context_similarity"))
        at = raw.find(low) if low in raw else raw.find(name)
        if jobs and at >= 0:
            around = raw[max(0, at - 40) : at + len(low) + 80]
            if any(c in around for c in claims.EXPERT_CLAIMS) and any(n in work for n in claims.NOVICE_SIGNALS):
                levels.append((5, "fake_expert_detected"))
        out[s] = max(levels, default=None)
    kept = [(s, *x) for s, x in out.items() if x]
    return sorted(kept, key=lambda x: -x[1])


def test_contradictions_equal_the_plain_version(spark):
    draw = random.Random(7)
    skills = ["React", "JS", "docker", "Swift", "k8s", " django ", "Java", "", None, "Spring", "c++"]
    words = ["react", "javascript", "Kubernetes", "ios", "python", "java", "expert", "notions", "équipe", "confirmé", "tutoriel", "c++", "x" * 30, "débutant"]
    rows = []
    for i in range(300):
        text = lambda n: " ".join(draw.choice(words) for _ in range(draw.randrange(n)))
        own = [draw.choice(skills) for _ in range(draw.randrange(5))]
        rows.append((i, own, text(9), [text(4) for _ in range(draw.randrange(3))], {s: draw.random() for s in own if s}))
    rows += [(300, None, None, None, None), (301, [], "", [], {}), (302, ["Swift"], None, [None, " "], None), (303, ["java"], "java " * 50_000 + "expert", ["notions"], None)]
    profiles = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", level string")
    expansion = spark.createDataFrame(EXPANSION, "skill string, other string")
    found = claims.contradictions(profiles, expansion, F.col("likeness"))
    got = {r.id: [tuple(x) for x in r.contradictions] for r in found.collect()}
    assert found.columns == [*profiles.columns, "contradictions"]
    assert got == {i: plain(*rest) for i, *rest in rows}
    rows_of = [(r.id, r.skill, r.level, r.reason) for r in claims.listed(found, "id").collect()]
    assert sorted(rows_of) == sorted((i, *x) for i, r in got.items() for x in r)
    assert {x[1] for r in got.values() for x in r} == {1, 2, 3, 4, 5}


def test_no_text_moves_for_a_skill(spark):
    plan = claims.contradictions(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_what_contradictions_cost(spark):
    levels = [(1, [1, 2, 3]), (2, [4]), (3, [4, 4]), (4, [5, 4]), (5, []), (6, None)]
    kind = "array<struct<skill:string,level:int,reason:string>>"
    rows = spark.createDataFrame([(i, None if x is None else [("s", n, "") for n in x]) for i, x in levels], f"id int, found {kind}")
    cost, doubt = claims.deduction(F.col("found"))
    got = {r.id: (r.c, r.d, r.t) for r in rows.select("id", cost.alias("c"), doubt.alias("d"), claims.confidence(F.col("found")).alias("t")).collect()}
    assert got == {1: (0.0, False, "HAUTE"), 2: (0.08, False, "MOYENNE"), 3: (0.15, False, "MOYENNE"), 4: (0.15, True, "BASSE"), 5: (0.0, False, "HAUTE"), 6: (0.0, False, "HAUTE")}
