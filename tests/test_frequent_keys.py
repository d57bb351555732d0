"""Joins whose keys few values share, and steps that must not run once a pass."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from hiresift.operators import discovery, domains, evaluation, matching, profiles
from hiresift.plans import all_oracles, all_queries


def test_study_words_part_at_letters_beyond_ascii_as_the_sql_does(spark, tmp_path):
    rows = [(1, 1, "der größte schoß\u00dfheit klein", "user"), (1, 2, "\u00dfthe \u00f8que", "und"), (2, 1, None, "user"), (2, 2, "la canci\u00f3n", "ci\u00f3n")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string, role string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sorted(con.execute(all_oracles()["study_words"]).fetchall())
    assert sorted(tuple(r) for r in all_queries()["study_words"](spark, str(tmp_path)).collect()) == want


def test_labels_meet_each_title_and_name_once(spark):
    # 100,000 rows of four titles and names: what is joined to the labels are these four.
    rows = spark.range(100_000).select(F.col("id").alias("place"), F.concat(F.lit("red t"), (F.col("id") % 2).cast("string")).alias("title"), F.concat(F.lit("n"), F.col("id").bitwiseAND(2).cast("string")).alias("name"))
    labels = spark.createDataFrame([(1, "t1", "n2"), (2, "T0", "n"), (3, "t1", "zz"), (4, "t1", "N2")], "label_id long, label_title string, label_name string")
    found = domains.approximate_labels(labels, rows)
    assert {(r.label_id, r.place, r.title, r.name) for r in found.collect()} == {(1, 3, "red t1", "n2"), (2, 0, "red t0", "n0"), (4, 3, "red t1", "n2")}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_frequent_key_is_dealt_to_many_tasks(spark):
    left = spark.range(900).select(F.col("id").alias("a"), F.when(F.col("id") % 9 != 0, "often").when(F.col("id") % 18 == 0, "seldom").alias("k"))
    right = spark.range(50).select(F.col("id").alias("b"), F.when(F.col("id") < 40, "often").when(F.col("id") < 45, "seldom").alias("k"))
    want = {tuple(r) for r in left.join(right, "k").select("a", "b").collect()}
    got = matching.spread_join(left, right, "k", task_pairs=1_000)
    listed = [tuple(r) for r in got.select("a", "b").collect()]
    assert len(listed) == len(set(listed)) == len(want) and set(listed) == want
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 10 and max(shares) < len(want) / 3


@pytest.mark.parametrize("turned", [False, True])
def test_many_rows_of_a_frequent_key_travel_once_to_few(spark, turned):
    few = spark.range(20).select(F.col("id").alias("a"), F.when(F.col("id") % 4 != 0, "often").when(F.col("id") > 0, "seldom").alias("k"))
    many = spark.range(3_000).select(F.col("id").alias("b"), F.when(F.col("id") % 10 != 0, "often").otherwise("seldom").alias("k"))
    want = {tuple(r) for r in few.join(many, "k").select("a", "b").collect()}
    for broadcast_rows in (None, 0):
        got = matching.spread_join(*((many, few) if turned else (few, many)), "k", task_pairs=1_000, broadcast_rows=broadcast_rows)
        listed = [tuple(r) for r in got.select("a", "b").collect()]
        assert got.columns == (["k", "b", "a"] if turned else ["k", "a", "b"]) and len(listed) == len(want) and set(listed) == want
        shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(shares) > 10 and max(shares) < len(want) / 5
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("Generate" in plan) == (broadcast_rows == 0)


def test_features_are_made_once_for_a_training(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return float(x % 7)

    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("label"), seen("id").alias("x"))
    model, validation = evaluation.train_logistic(rows, ("x",))
    assert made.value == 400 and 60 < validation.count() < 140


def test_pairs_are_joined_before_their_json_is_written(spark):
    plan = all_queries()["pair_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "annees_experience_totales" in plan[: plan.index("Join")] and "named_struct" not in plan[plan.index("Join") :]


def test_forms_of_a_line_are_made_once_for_all_diplomas(spark):
    rows = spark.createDataFrame([(1, 0, "Master 2 Informatique, Université de Tunis, 2019", "formation"), (1, 5, "l'ingenieur 2001", None)], "id long, at int, line string, section string")
    found = profiles.formations(rows)
    assert {(r.at, r.diploma, r.level, r.year) for r in found.collect()} == {(0, "Master 2", 5, 2019), (5, "Diplôme d'Ingénieur", 5, 2001)}
    marked = rows.select(profiles._first_diploma(F.col("line")).alias("d"))
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 1


def test_heuristic_scores_broadcasts_by_rows_not_by_file_size(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data here")
    joined = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    query = all_queries()["heuristic_scores"]
    few = query(spark, data)
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(matching, "TASK_ROWS", 300)
    many = query(spark, data)
    sides = lambda plan, join: {key for key in ("offer_id", "candidate_id") if re.search(rf"{join} \[{key}#", plan)}
    assert sides(joined(few), "BroadcastHashJoin") == sides(joined(many), "SortMergeJoin") == {"offer_id", "candidate_id"}
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    rows = spark.range(6_000).select("id", (F.col("id") % 700).alias("k"))
    got = matching.looked_up(rows, spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "k", 6_000)
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == rows.where("k < 600").count() and len(shares) > 15 and max(shares) < 900


def test_baskets_are_dealt_by_their_rows_and_pairs(spark, monkeypatch):
    # One item in two thirds of the baskets, another in half of them: the first reaches no lift of 2, the second can.
    rows = [(k, f"i{k * 7 % 23}") for k in range(600)] + [(k, f"j{k * 5 % 23}") for k in range(600)] + [(k, "all") for k in range(600) if k % 3] + [(k, "half") for k in range(0, 600, 2)]
    rows += [(k, f"h{k % 46}") for k in range(0, 600, 2)] + [(None, "half"), (7, None), (8, "half")]
    table = spark.createDataFrame(rows, "k long, i string")
    want = sorted(map(tuple, discovery.cooccurrences(table, "k", "i", 2, 2.0).collect()))
    monkeypatch.setattr(discovery, "TASK_ROWS", 400)
    monkeypatch.setattr(discovery, "TASK_PAIRS", 100)
    got = discovery.cooccurrences(table, "k", "i", 2, 2.0)
    assert sorted(map(tuple, got.collect())) == want and ("h0", "half") in {r[:2] for r in want} and not any("all" in r[:2] for r in want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    tasks = {int(n) for n in re.findall(r"hashpartitioning\(k#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)}
    assert len(tasks) == 1 and min(tasks) >= 25
    pairs = discovery.cooccurrences(table.limit(0), "k", "i", 2, 2.0)
    assert pairs.count() == 0 and pairs.columns == ["a", "b", "n_a", "n_b", "n", "lift"]
