"""Dictionary building, training pairs, encoder texts and summaries."""

import numpy as np

from hiresift.operators import datasets


def test_alias_dictionary_and_triplets(spark):
    clusters = spark.createDataFrame([(1, "Js"), (1, "javascript"), (1, "a long other name"), (2, "SQL")], "cluster int, term string")
    assert {tuple(r) for r in datasets.alias_dictionary(clusters).collect()} == {("js", "javascript"), ("javascript", "js")}
    lines = spark.createDataFrame([("a | b | c",), ("broken | line",), (None,)], "line string")
    assert {tuple(r) for r in datasets.triplets(lines).collect()} == {("a", "b", 1), ("a", "c", 0)}


def test_discovered_skills(spark):
    docs = spark.createDataFrame([(1, "TypeScript, Vue.js, CI/CD et SQL; TypeScript"), (2, None)], "id int, raw_text string")
    known = spark.createDataFrame([("sql",)], "term string")
    got = {(r.term, r.shape) for r in datasets.discovered_skills(docs, known).collect()}
    assert ("TypeScript", "camel") in got and ("Vue.js", "dotted") in got and ("CI/CD", "slashed") in got and not any(t == "SQL" for t, _ in got)


def test_texts_networks_and_summaries(spark):
    pairs = spark.createDataFrame(
        [("Dev", "desc", "Paris", ["py"], ["py"], ["Dev"], [], "raw", "Ann", 0.8, ["py"], ["sql"], 1.0), (None, None, None, None, None, None, None, "raw", "Bob", 0.1, [], [], -1.0)],
        "titre string, description string, localisation string, competences_requises array<string>, skills array<string>, titles array<string>, diplomas array<string>, "
        "raw_text string, nom string, score double, matched array<string>, missing array<string>, f double",
    )
    a, b = datasets.encoder_texts(pairs).collect()
    assert a.offer_text.startswith("Poste: Dev Compétences requises: py") and a.candidate_text == "Compétences: py Expériences: Dev" and b.candidate_text == "raw"
    assert datasets.summaries(pairs).first().summary == "Ann : profil excellent (80 %). Points forts : py. À vérifier : sql."
    layers = [(np.array([[2.0, -1.0]]), np.zeros(2)), (np.array([[1.0], [1.0]]), np.zeros(1))]
    got = [r.s for r in datasets.mlp_scores(pairs, ["f"], layers, "s").collect()]
    assert np.allclose(got, [1 / (1 + np.exp(-2)), 1 / (1 + np.exp(-1))])


def test_domain_pairs(spark):
    offers = spark.createDataFrame([(1, "it"), (2, "law")], "id int, domain string")
    people = spark.createDataFrame([(i, ["it", "law", "data", "art"][i % 4]) for i in range(80)], "id int, domain string")
    near = spark.createDataFrame([("it", "data")], "a string, b string")
    got = datasets.domain_pairs(offers, people, near).collect()
    kinds = {(r.offer_id, r.kind) for r in got}
    assert {(1, "same"), (2, "same"), (1, "adjacent")} <= kinds and (2, "adjacent") not in kinds
    assert len({(r.offer_id, r.candidate_id) for r in got}) == len(got)
    assert all(r.candidate_id % 4 in (1, 3) or r.offer_id == 2 for r in got if r.kind == "different")


def test_pieces_keep_digits_that_equal_their_place(spark):
    """A trim that took the place of an element for what to trim once cut these."""
    lines = spark.createDataFrame([(" 0 ans | java 1 | sql 2 ",)], "line string")
    assert {tuple(r) for r in datasets.triplets(lines).collect()} == {("0 ans", "java 1", 1), ("0 ans", "sql 2", 0)}
