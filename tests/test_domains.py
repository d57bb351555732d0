"""Domains, labels and discoveries against plain versions, with nulls and ties."""

import random

from pyspark.sql import functions as F

from hiresift.operators import domains, matching


def plain_domain(text, keywords):
    own = " ".join(text.lower().split())
    best, code = 0.0, None
    for _, k, c in keywords:
        if not own:
            continue
        if k in own:
            score = 1 + len(k) / 10000
        elif own in k:
            score = 0.9
        else:
            a, b = set(k.split()), set(own.split())
            score = len(a & b) / max(len(a), len(b))
        if score > best:
            best, code = score, c
    return (code, int(best * 1000 + 0.5) / 1000) if best >= 0.35 else None


def test_domain_of_the_best_keyword(spark):
    rng = random.Random(3)
    words = ["data", "chef", "projet", "ingénieur", "vente", "de", "la", "web"]
    keywords = [(i, " ".join(rng.sample(words, rng.randrange(1, 4))), str(i % 7)) for i in range(25)]
    plain = [(p, k.replace("é", "e"), c) for p, k, c in keywords]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 6))) for _ in range(80)] + ["", "Chef de projet", "chef"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "id int, text string")
    table = spark.createDataFrame(keywords, "place int, keyword string, code string")
    got = {r.id: None if r.domain is None else tuple(r.domain) for r in domains.detect_domain(rows, table).collect()}
    assert got == {i: plain_domain(t.replace("é", "e"), plain) for i, t in enumerate(texts)} | {999: None}


def test_study_domain_takes_the_first_of_equals(spark):
    table = spark.createDataFrame([(0, "droit", "loi"), (1, "info", "ia"), (1, "info", "réseau")], "place int, domain string, keyword string")
    rows = spark.createDataFrame([(1, "IAE et loi", None), (2, "ia, reseaux", "x"), (3, None, None), (4, "loi", "IA")], "id int, text string, s string")
    assert {r.id: r.study for r in domains.study_domain(rows, table).collect()} == {1: "droit", 2: "info", 3: None, 4: "droit"}
    assert {r.id: r.study for r in domains.study_domain(rows, table, specialty="s").collect()} == {1: "droit", 2: "info", 3: None, 4: "info"}


def test_discoveries_that_add_nothing_go(spark):
    rows = [(1, ["PostgreSQL", "Java"], ["sql", "JavaScript", "java", "PostgreSQL 14", "Docker", "docker", "Dockerfile"]), (2, None, ["x", "X"]), (3, ["a"], None)]
    got = domains.deduplicated_discoveries(spark.createDataFrame(rows, "id int, known array<string>, found array<string>")).collect()
    assert {r.id: r.kept for r in got} == {1: ["sql", "JavaScript", "Docker"], 2: ["x"], 3: []}


def test_approximate_labels_equal_a_plain_version(spark):
    rng = random.Random(6)
    names = ["anna", "ann", "bo", "bob", "li"]
    titles = ["dev", "dev java", "java", "data", "chef data"]
    labels = [(i, rng.choice(titles), rng.choice(names)) for i in range(30)]
    rows = [(i, rng.choice(titles).upper(), rng.choice(names)) for i in range(20)]
    either = lambda a, b: a.lower() in b.lower() or b.lower() in a.lower()
    want = {i: next((p for p, x, y in rows if either(t, x) and either(n, y)), None) for i, t, n in labels}
    got = domains.approximate_labels(
        spark.createDataFrame(labels, "label_id int, label_title string, label_name string"), spark.createDataFrame(rows, "place int, title string, name string")
    ).collect()
    assert {r.label_id: r.place for r in got} == {i: p for i, p in want.items() if p is not None}


def test_real_pairs(spark):
    keywords = spark.createDataFrame([(0, "info", "python"), (1, "droit", "loi")], "place int, domain string, keyword string")
    near = spark.createDataFrame([("info", "droit")], "a string, b string")
    rows = [(1, "['Python', \"SQL\"]", "['python ', 'x']", "loi", "python", 0.5, 80.0), (2, "none", None, None, None, -3.0, None)]
    got = domains.real_pair_features(
        spark.createDataFrame(rows, "id int, required string, own string, job_text string, resume_text string, cosine double, percent double"), keywords, near
    ).orderBy("id").collect()
    assert [(r.skills_raw, r.study_compat, r.semantic, r.label, r.domain_ratio) for r in got] == [(0.5, 0.75, 0.75, 0.8, 0.75), (0.0, 0.8, 0.0, 0.5, 0.0)]


def test_phrases_pair_whole_texts(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(300))) for i in range(12)]
    items = [(j, " ".join(docs[j][1].split()[290:298])) for j in range(4)] + [(9, "too short"), (10, None)]
    near = matching.shared_phrases(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"), "item_id", "doc_id")
    runs = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} if t else set()
    assert {tuple(r) for r in near.collect()} == {(j, i) for j, a in items for i, b in docs if runs(a) & runs(b)}
    pairs = near.join(spark.createDataFrame(items, "item_id int, a string"), "item_id").join(spark.createDataFrame(docs, "doc_id int, b string"), "doc_id")
    found = matching.tfidf_pairs(pairs, "a", "b", ["item_id", "doc_id"]).collect()
    assert len(found) == near.count() and all(0 < r.cosine < 1 for r in found)


def test_vectors_without_a_block_meet_all(spark):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    got = {(r.query_id, r.vec_id) for r in matching.vector_matches(frame.where(F.col("id") % 10 == 0), frame, "id", "v", 0.9).collect()}
    assert got == {(i, j) for i, a in rows if i % 10 == 0 for j, b in rows if i != j and cos(a, b) >= 0.9}
