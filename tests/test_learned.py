"""Features by hand, pipelines through storage, networks against an unfolded pass."""

import json
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from hiresift.operators import learned
from hiresift.plans import judged
from hiresift.sources.tables import load_pipeline

PAIRS = "id int, details string, parsed_data string, encoder_details string, required array<string>, titre string, description string, raw_text string"


def details(**scores):
    return json.dumps({"components": {k: {"score": v} for k, v in scores.items()}})


def test_features_by_hand(spark):
    profile = {"metadata": {"annees_experience_totales": "4.5", "niveau_formation_max": 3}, "competences": [1, 2, 3]}
    rows = [
        (1, details(skills=0.5, experience="0.25", education="x", location=None), json.dumps(profile), json.dumps({"total": 0.3, "bert_semantic": 0.2}), ["a", "b"], "dév", "ab", "abc"),
        (2, None, None, None, None, None, None, None),
        (3, "[]", "{broken", '{"total_raw": 0.1, "total": 0.9, "bert_skills": "NaN"}', [], "", "", ""),
        (4, '{"components": {"skills": 1}}', '{"metadata": [], "competences": {"a": 1}}', "7", ["x"], "a", "b", "c" * 100_000),
    ]
    frame = spark.createDataFrame([(*r, -1.0) for r in rows], PAIRS + ", score_skills double")
    got = {r.id: [r[f] for f in learned.ENCODER_FEATURES] for r in learned.PairFeatures(encoder=True).transform(frame).collect()}
    assert got[1] == [0.5, 0.25, 0.0, 0.0, 0.0, 4.5, 3.0, 3.0, 2.0, 3.0, 2.0, 3.0, 0.3, 0.2, 0.0]
    assert got[2] == [0.0] * 15
    assert got[3] == [0.0] * 12 + [0.1, 0.0, 0.0]
    assert got[4] == [0.0] * 8 + [1.0, 1.0, 1.0, 100_000.0] + [0.0] * 3
    assert learned.PairFeatures().features() == learned.ENCODER_FEATURES[:12] and learned.PairFeatures().transform(frame.limit(0)).count() == 0


def test_documents_are_parsed_once_and_odd_ones_by_path(spark):
    odd = [
        (1, '{"components": {"skills": 1, "experience": {"score": "0.5"}, "location": {"score": 1e400}, "semantic": {"score": " 2 "}}}', [0.0, 0.5, 0.0, 0.0, 2.0]),
        (2, '{"components": {"skills": {"score": 0.5}, "experience": {"score": 5d}}}', [0.0] * 5),
        (3, "{'components': {'skills': {'score': '0x1p3'}, 'experience': 7}} and more", [8.0, 0.0, 0.0, 0.0, 0.0]),
        (4, '{"components": [{"skills": {"score": 1}}]}', [0.0] * 5),
    ]
    level = {1: '{"metadata": {"niveau_formation_max": 1e30}, "competences": "[1,2]"}', 2: '{"metadata": {"niveau_formation_max": "NaN"}}', 3: '{"metadata": {"niveau_formation_max": "2.9"}}', 4: None}
    rows = spark.createDataFrame([(i, text, level[i], '{"total_raw": "NaN", "total": 0.4}', None, "a", "b", "c") for i, text, _ in odd], PAIRS)
    found = learned.PairFeatures(encoder=True).transform(rows)
    got = {r.id: r for r in found.collect()}
    assert {i: [got[i][f] for f in learned.PAIR_FEATURES[:5]] for i, _, _ in odd} == {i: want for i, _, want in odd}
    assert [(got[i].candidate_education_level, got[i].candidate_total_skills, got[i].bert_raw) for i in (1, 2, 3)] == [(0.0, 2.0, 0.0), (0.0, 0.0, 0.0), (2.0, 0.0, 0.0)]
    # Documents that fit are read from their structs: three are parsed, whatever is read of them.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 3
    # What an offer or a profile has by itself may come from before the pairs.
    own = learned.offer_features(learned.profile_features(rows)).select("id", "details", "encoder_details", *learned.OFFER_FEATURES, *learned.PROFILE_FEATURES)
    assert {r.id: [r[f] for f in learned.ENCODER_FEATURES] for r in learned.PairFeatures(encoder=True).transform(own).collect()} == {i: [r[f] for f in learned.ENCODER_FEATURES] for i, r in got.items()}


def test_learned_scores_makes_features_of_profiles_before_the_join(spark):
    plan = judged.learned_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "annees_experience_totales" not in plan[: plan.index("Join")] and "annees_experience_totales" in plan


def labelled(spark, n=400):
    draw, rows = random.Random(3), []
    for i in range(n):
        label = i % 2
        level = lambda: min(1.0, max(0.0, draw.gauss(0.35 + 0.3 * label, 0.15)))
        rows.append((i, details(skills=level(), semantic=level()), '{"metadata": {"annees_experience_totales": %d}}' % draw.randrange(9), None, ["a"], "t", "d", "r", label))
    return spark.createDataFrame(rows, PAIRS + ", label int")


def test_a_stored_pipeline_gives_the_same_scores(spark, tmp_path):
    rows = labelled(spark)
    model, held = learned.train(rows)
    right = held.where(F.col("prediction") == F.col("label")).count() / held.count()
    assert 0 < held.count() < 200 and right > 0.85
    model.write().overwrite().save(str(tmp_path / "model"))
    again, reason = load_pipeline(str(tmp_path / "model"))
    assert reason is None and isinstance(again, PipelineModel) and isinstance(again.stages[0], learned.PairFeatures)
    clash = rows.withColumn("prediction", F.lit("mine")).withColumn("ready", F.lit(3))
    one = {r.id: r for r in learned.scored(clash, model).collect()}
    two = {r.id: r.learned_score for r in learned.scored(rows, again).collect()}
    assert {i: r.learned_score for i, r in one.items()} == two and one[0].prediction == "mine" and one[0].ready is True
    assert len(two) == 400 and all(0 <= s <= 1 for s in two.values())


def test_without_a_model_scores_are_neutral(spark, tmp_path):
    model, reason = load_pipeline(str(tmp_path / "nothing"))
    row = learned.scored(labelled(spark, 4), model, reason).first()
    assert (row.learned_score, row.ready) == (0.5, False) and row.reason


def state(width):
    draw = np.random.default_rng(width)
    return {
        "net.0.weight": draw.normal(size=(64, width)), "net.0.bias": draw.normal(size=64), "net.1.weight": draw.normal(size=64), "net.1.bias": draw.normal(size=64),
        "net.1.running_mean": draw.normal(size=64), "net.1.running_var": draw.random(64) + 0.1, "net.1.num_batches_tracked": np.array(7),
        "net.4.weight": draw.normal(size=(32, 64)) / 8, "net.4.bias": draw.normal(size=32), "net.7.weight": draw.normal(size=(1, 32)), "net.7.bias": draw.normal(size=1),
    }


@pytest.mark.parametrize("width", [7, 9, 10])
def test_network_equals_an_unfolded_pass(spark, tmp_path, width):
    s, draw = state(width), np.random.default_rng(1)
    x = draw.random((200, width))
    h = x @ s["net.0.weight"].T + s["net.0.bias"]
    h = (h - s["net.1.running_mean"]) / np.sqrt(s["net.1.running_var"] + 1e-5) * s["net.1.weight"] + s["net.1.bias"]
    h = np.maximum(h, 0) @ s["net.4.weight"].T + s["net.4.bias"]
    want = 1 / (1 + np.exp(-(np.maximum(h, 0) @ s["net.7.weight"].T + s["net.7.bias"])[:, 0]))
    path = tmp_path / "weights.json"
    path.write_text(json.dumps({k: v.tolist() for k, v in s.items()}))
    network, reason = learned.read_network(spark, [str(tmp_path / "none.json"), str(path)])
    assert reason is None and network.features() == learned.NETWORK_FEATURES[width]
    network.save(str(tmp_path / "stage"))
    names = network.features()
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(998, *[None] * width), (999, *[float("inf")] * width)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r.network_score for r in learned.Network.load(str(tmp_path / "stage")).transform(rows).collect()}
    assert [got[i] for i in range(200)] == pytest.approx(list(want), abs=1e-12)
    assert got[998] is None and got[999] is None


def test_networks_that_cannot_be_read(spark, tmp_path):
    assert learned.read_network(spark, [str(tmp_path / "a")]) == (None, "artifact_missing")
    for text in ("{}", "no", "[1]", json.dumps({k: np.asarray(v).tolist() for k, v in (state(7) | {"net.7.bias": [0.0, 1.0]}).items()}), json.dumps({k: np.asarray(v).tolist() for k, v in state(8).items()})):
        path = tmp_path / f"{len(text)}.json"
        path.write_text(text)
        network, reason = learned.read_network(spark, [str(path)])
        assert network is None and reason.startswith("load_error:"), text[:20]


def test_blend(spark):
    base, none = F.lit(0.5), F.lit(None).cast("double")
    row = spark.range(1).select(learned.blended(base, F.lit(1.0), 10).alias("a"), learned.blended(base, F.lit(1.0), 7).alias("b"), learned.blended(base, none, 7).alias("c")).first()
    assert tuple(row) == (0.7, 0.55, 0.5)


def test_learned_scores_of_all_matches(spark):
    rows = judged.learned_scores(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == judged.pairs(spark, "/root/testdata/sf0.001").count() and all(0 <= r.learned_score <= 1 and r.ready for r in rows)
