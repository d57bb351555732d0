"""The steps of the whole score by hand; the query itself is checked against SQL."""

import os
import re

import pytest
from pyspark.sql import functions as F

from hiresift.operators import match_plan
from hiresift.plans import all_queries

JOBS = "array<struct<title:string,company:string,description:string,months:int>>"


def test_domain_years_weigh_jobs_by_shared_skills(spark):
    ecosystem = spark.createDataFrame([("docker", "kubernetes"), ("python", "django")], "skill string, other string")
    offers = match_plan.prepared_offers(spark.createDataFrame([(1, ["py", "docker", "Python"]), (2, [])], "offer_id int, required array<string>"), ecosystem)
    assert sorted(offers.where("offer_id = 1").first().wanted) == ["django", "docker", "kubernetes", "python"]
    assert offers.where("offer_id = 2").first().wanted == []
    jobs = [
        ("dev python", "Acme", None, 24),  # python and django: half of the offer's skills, in the domain
        (None, " ", "", 12),  # no text: half
        ("comptable", None, "bilan, paie", 0),  # unknown length counts a year; outside
        ("a kubernetes b", None, None, 6),  # one of four: in the domain
    ]
    profiles = match_plan.prepared_jobs(spark.createDataFrame([(7, jobs), (8, None), (9, [])], f"candidate_id int, jobs {JOBS}"), ecosystem)
    found = {r.candidate_id: r for r in profiles.collect()}
    assert found[7].experience_text == "dev python acme comptable bilan, paie a kubernetes b" and found[8].practice is None and found[9].experience_text == ""
    rows = offers.where("offer_id = 1").crossJoin(profiles.where("candidate_id = 7"))
    assert rows.select(match_plan.domain_years(F.col("wanted"), F.col("practice"))).first()[0] == pytest.approx(2.0 + 0.5 + 0.05 + 0.5)
    near = F.array(F.lit(None).cast("double"), F.lit(0.9), F.lit(1.0), F.lit(0.0))
    # A job outside whose text is as near as can be counts as beside the domain.
    assert rows.select(match_plan.domain_years(F.col("wanted"), F.col("practice"), near)).first()[0] == pytest.approx(2.0 + 0.5 + 0.55 + 0.5)


@pytest.mark.parametrize(
    ("required", "years", "relevant", "semantic", "value"),
    [(0, 3.0, 0.0, None, 1.0), (None, 3.0, 0.0, None, 1.0), (4, 2.0, 1.0, None, 0.3625), (4, 2.0, 1.0, 0.9, 0.52), (2, 9.0, 9.0, 1.0, 1.0), (2, None, None, None, 0.0)],
)
def test_experience(spark, required, years, relevant, semantic, value):
    row = spark.createDataFrame([(required, years, relevant, semantic)], "q int, y double, r double, s double")
    got = row.select(match_plan.experience(F.col("q"), F.col("y"), F.col("r"), F.col("s"))).first()[0]
    assert got == pytest.approx(value)


def test_what_offers_ask_for_does_not_travel_with_pairs(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data here")
    few = all_queries()["whole_scores"](spark, data)
    monkeypatch.setattr(match_plan, "MOST_SETS", 3)
    many = all_queries()["whole_scores"](spark, data)
    joins = lambda rows: re.findall(r"Join Inner, \((\w+)#", rows._jdf.queryExecution().optimizedPlan().toString())
    assert joins(few)[0] == "_set" and joins(many)[0] == "candidate_id"
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_offers_that_ask_for_the_same_share_a_set(spark):
    rows = [(4, ["a"], None, "a"), (2, ["a"], None, "a"), (3, None, None, None), (5, None, None, None), (6, ["a"], [], "a"), (7, [None], None, "a")]
    offers = spark.createDataFrame(rows, "offer_id int, required array<string>, appreciated_skills array<string>, title_skill string")
    own, sets, few = match_plan._sets(offers)
    assert few and {r.offer_id: r._set for r in own.collect()} == {4: 2, 2: 2, 3: 3, 5: 3, 6: 6, 7: 7} and sets.count() == 4
