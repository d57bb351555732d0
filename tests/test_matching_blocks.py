"""Blocked joins against all pairs, negatives and noise."""

import random

from pyspark.sql import functions as F

from hiresift.functions import similarity, skills
from hiresift.operators import dictionary, evaluation, listings, matching


def typos(rng, word):
    own = list(word)
    for _ in range(rng.randrange(0, 3)):
        at = rng.randrange(len(own) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            own.insert(at, rng.choice("abcdefgh "))
        elif own:
            at = min(at, len(own) - 1)
            if kind == 1:
                own[at] = rng.choice("abcdefgh")
            elif len(own) > 1:
                del own[at]
    return "".join(own).strip()


def test_fuzzy_blocks_lose_no_pair(spark):
    rng = random.Random(4)
    base = ["python", "jython", "javascript", "java", "sql server", "server sql", "c", "c++", "r", "go", "spring boot", "react native", "deep learning", "ai", "base de données", "power bi"]
    rights = sorted(set(base) | {"".join(rng.choices("abcdefgh ", k=rng.randrange(1, 14))).strip() or "x" for _ in range(60)})
    lefts = sorted({typos(rng, w) for w in rights * 3} - {""})
    got = {
        r.a: (r.b, round(r.score, 6))
        for r in matching.blocked_fuzzy(
            spark.createDataFrame([(x,) for x in lefts], "term string"), spark.createDataFrame([(x,) for x in rights], "term string"), similarity.weighted_ratio_column, 82.0
        ).collect()
    }
    want = {}
    for a in lefts:
        scored = [(-similarity.weighted_ratio(a, b), b) for b in rights]
        best = min(scored)
        if -best[0] >= 82:
            want[a] = (best[1], round(-best[0], 6))
    assert got == want


def best_pairs(lefts, rights):
    want = {}
    for a in lefts:
        best = min((-similarity.weighted_ratio(a, b), b) for b in rights)
        if -best[0] >= 82:
            want[a] = (best[1], round(-best[0], 6))
    return want


def test_fuzzy_candidates_of_many_words_lose_no_pair(spark):
    """Words of one letter, repeated words, words in other orders, texts in parts of others."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdr", k=rng.choice([1, 1, 2, 3, 5, 8])))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 5))) for _ in range(260)] + ["ansi c", "c embedded", "r tidy", "language r", "a a a", "babzzzzz", "dd dd dd", "x"]
    for t in list(texts[:120]):
        parts = t.split()
        rng.shuffle(parts)
        texts.append(typos(rng, " ".join(parts * rng.choice([1, 1, 2]))))
    lefts, rights = sorted({t for t in texts[::2] if t}), sorted({t for t in texts[1::2] if t})
    a, b = (spark.createDataFrame([(x,) for x in side] + [(None,), ("",)], "term string") for side in (lefts, rights))
    got = {r.a: (r.b, round(r.score, 6)) for r in matching.blocked_fuzzy(a, b, similarity.weighted_ratio_column, 82.0).collect()}
    assert got == best_pairs(lefts, rights) and len(got) > 100
    pairs = {tuple(r) for r in matching.fuzzy_candidates(a.where("term <> ''").distinct(), b.where("term <> ''").distinct()).collect()}
    assert all((x, y) in pairs for x in lefts for y in rights if similarity.weighted_ratio(x, y) >= 82)
    assert ("ansi c", "c embedded") in pairs or ("c embedded", "ansi c") in pairs


def test_fuzzy_candidates_are_few_for_long_names(spark):
    rng = random.Random(12)
    names = sorted({" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(2)) for _ in range(400)})
    a, b = (spark.createDataFrame([(x,) for x in names[i::2]], "term string") for i in (0, 1))
    assert matching.fuzzy_candidates(a, b).count() < 0.2 * (len(names) / 2) ** 2


def test_dictionary_larger_than_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The cat of the house, the cat."), (2, "cat cat"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("cat", "x"), ("the cat", "y"), ("dog", "z")], "term string, category string")
    want = {(1, "cat", "x", 2), (1, "the cat", "y", 2), (2, "cat", "x", 2)}
    assert {tuple(r) for r in matching.dictionary_matches(docs, terms).collect()} == want
    monkeypatch.setattr(dictionary, "MOST_CHARS", 4)
    assert {tuple(r) for r in matching.dictionary_matches(docs, terms).collect()} == want


def test_nearest_and_vectors_meet_all_rows_in_blocks(spark):
    names = ["ring", "rang", "bolt", "boat", "goat", "ring"]
    got = {r.a: (r.b, r.distance) for r in matching.nearest(
        spark.createDataFrame([(x,) for x in names[:4]], "a string"), spark.createDataFrame([(x,) for x in names], "b string"), "a", "b").collect()}
    assert got == {"ring": ("rang", 1), "rang": ("ring", 1), "bolt": ("boat", 1), "boat": ("bolt", 1)} or got["boat"] in (("bolt", 1), ("goat", 1))
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id long, v array<double>")
    pairs = matching.against_all(rows.where("id < 7").select(F.col("id").alias("q")), rows.select("id"), block_rows=2)
    assert pairs.count() == 7 * 30 and pairs.distinct().count() == 7 * 30


def test_recommendations_equal_brute_force(spark):
    rng = random.Random(1)
    names = [f"s{i}" for i in range(8)]
    people = [(i, "refuse" if i % 4 else "accepte", rng.sample(names, rng.randrange(0, 5))) for i in range(40)]
    jobs = [(i, "active" if i % 5 else "closed", f"t{i % 9}", rng.sample(names, rng.randrange(0, 4))) for i in range(60)]
    met = [(rng.randrange(40), rng.randrange(60)) for _ in range(120)]
    title = {j[0]: j[2] for j in jobs}
    want = {}
    for c, status, own in people:
        if status != "refuse":
            continue
        applied = {title[o] for x, o in met if x == c}
        found = sorted((-len(set(own) & set(w)) / len(set(w)), o) for o, s, t, w in jobs if s == "active" and w and t not in applied and len(set(own) & set(w)) / len(set(w)) >= 0.45)
        want |= {(c, n + 1): (o, -x) for n, (x, o) in enumerate(found[:3])}
    got = listings.recommendations(
        spark.createDataFrame(people, "id long, candidature_status string, skills array<string>"),
        spark.createDataFrame(jobs, "id long, status string, titre string, skills array<string>"),
        spark.createDataFrame(met, "candidate_id long, offer_id long"), k=3,
    ).collect()
    assert {(r.candidate_id, r["rank"]): (r.offer_id, r.overlap) for r in got} == want


def test_negatives_reach_every_offer(spark):
    rows = [(c, o, "accepted") for c in range(40) for o in (c % 30, (c + 1) % 30)]
    matches = evaluation.labelled(spark.createDataFrame(rows, "candidate_id long, offer_id long, status string"))
    got = evaluation.synthetic_negatives(matches, 300).collect()
    assert len({(r.candidate_id, r.offer_id) for r in got}) == 300 and not {(r.candidate_id, r.offer_id) for r in got} & {r[:2] for r in rows}
    assert {r.offer_id for r in got} == set(range(30))
    places = [r.place for r in evaluation.numbered_by_hash(spark.range(500).toDF("id"), "id", 3).orderBy("place").collect()]
    assert places == list(range(500))


def test_noise_does_not_follow_partitions(spark):
    rows = spark.range(200).select("id", (F.col("id") / 200).alias("x"), F.lit(0.5).alias("label"))
    one, two = (evaluation.augmented(r, ["x"], 2, 0.05).orderBy("id", "copy").collect() for r in (rows, rows.repartition(7, "x")))
    assert one == two and len(one) == 400 and 0.02 < sum(abs(r.label - 0.5) for r in one) / 400 < 0.08
    mixed = evaluation.mixed_up(rows, ["x"]).collect()
    assert len(mixed) == 200 and all(0 <= r.x <= 1 for r in mixed)


def test_coverage_by_token_sets(spark):
    rows = [(["ReactJS", "REST API", "Kafka"], ["react", "API REST", "Kubernetes"]), ([], ["x"]), (["Kafka"], []), (None, None)]
    frame = spark.createDataFrame(rows, "r array<string>, o array<string>")
    got = [tuple(r) for r in frame.select(skills.fuzzy_coverage(F.col("r"), F.col("o")), skills.exact_coverage(F.col("r"), F.col("o"))).collect()]
    assert got == [(0.6667, 0.0), (0.5, 0.0), (0.0, 0.0), (0.5, 0.0)]


def test_recommendations_rank_no_further_than_titles_need(spark, monkeypatch):
    # One title of 400 offers that is applied for blocks k places, not 400.
    asked, own = [], listings.top_per_group
    monkeypatch.setattr(listings, "top_per_group", lambda rows, group, order, k: asked.append(k) or own(rows, group, order, k))
    people = spark.createDataFrame([(1, "refuse", ["a"]), (2, "refuse", ["a"])], "id long, candidature_status string, skills array<string>")
    jobs = spark.createDataFrame([(i, "active", "often" if i < 400 else f"t{i}", ["a"]) for i in range(405)], "id long, status string, titre string, skills array<string>")
    got = listings.recommendations(people, jobs, spark.createDataFrame([(1, 7), (1, 8)], "candidate_id long, offer_id long"), k=3).collect()
    assert {(r.candidate_id, r["rank"]): r.offer_id for r in got} == {(1, 1): 400, (1, 2): 401, (1, 3): 402, (2, 1): 0, (2, 2): 1, (2, 3): 2}
    assert max(asked) <= 6


def test_vector_matches_sum_as_sql_in_groups_of_bounded_size(spark, monkeypatch):
    nan = float("nan")
    rows = [(i, [float(i % 7) - 3, float(i % 5) - 2, 0.1 * (i % 3)]) for i in range(60)]
    rows += [(60, [1.0, None, 2.0]), (61, None), (62, [0.0, 0.0, 0.0]), (63, [1.0, 2.0]), (64, []), (65, [nan, 1.0, 1.0]), (70, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    queries = frame.where("id % 10 = 0")
    pairs = queries.select(F.col("id").alias("a"), F.col("v").alias("x")).crossJoin(frame.select(F.col("id").alias("b"), F.col("v").alias("y"))).where("a <> b")
    plain = pairs.withColumn("c", matching.cosine(F.col("x"), F.col("y")))
    sizes, own = [], matching.vector_matches
    monkeypatch.setattr(matching, "QUERY_BLOCK", 3)
    monkeypatch.setattr(matching, "VECTOR_SLICE", 16)
    for least in (0.6, 0.0, -2.0):
        want = sorted(str((r.a, r.b, r.c)) for r in plain.where(F.col("c") >= least).collect())
        got = own(queries, frame, "id", "v", least)
        assert sorted(str(tuple(r)) for r in got.collect()) == want and len(want) > 20
        plan = got._jdf.queryExecution().toString()
        assert "FlatMapCoGroups" in plan and "aggregate(zip_with" not in plan
        sizes.append(len(want))
    assert sizes == sorted(sizes)
    blocked = own(queries.withColumn("k", F.col("id") % 20), frame.withColumn("k", F.col("id") % 20), "id", "v", 0.6, block="k")
    assert {tuple(r)[:2] for r in blocked.collect()} == {(r.a, r.b) for r in plain.where("c >= 0.6 and a % 20 = b % 20").collect()}
