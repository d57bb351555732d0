"""Stages of the pipeline on small tables."""

import random

import corpus_pipeline


def test_near_dedup_compares_five_words(spark):
    """Scattered edits leave two words alike but not five: such documents, and chains of them, stay; a copy with one edit goes."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(words))]
    near = list(words)
    near[60] = "edit"
    rows.append((1, " ".join(near)))
    for i in range(2, 6):
        for k in range(5):
            words[24 * k + 4 * i] = f"e{i}_{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()}
    assert kept == {0, 2, 3, 4, 5}


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, score_ string, repeats string, bpe string, ids string, n_tokens long, _row int"


def stages_over(spark, tmp_path, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, CLASHING)
    labels = spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if place + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert docs.columns == [c for c in columns if c not in ("ids", "n_tokens")] + [c for c in docs.columns if c not in columns or c in ("ids", "n_tokens")]
    return docs.withColumn("n", F.size("ids")).collect()


def test_stages_with_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        good = i % 3
        words = " ".join(f"{'w' if good else 'Q!'}{rng.randrange(500)}" for _ in range(rng.randrange(60, 90)))
        rows.append((i, words, "en", "s", len(words), 0.5, "x", "y", "z", "i", 3, 4))
    rows += [rows[1], rows[1], (None,) * 12, (None,) * 12, (61, None, None, None, None, None, None, None, None, None, None, None), (62, "", "en", "t", 0, *rows[0][5:])]
    long_text = " ".join(f"w{rng.randrange(500)}" for _ in range(120_000))
    rows.append((63, long_text, "en", "s", len(long_text), *rows[0][5:]))
    got = stages_over(spark, tmp_path, rows)
    assert got and all(r.n_tokens == r.n for r in got) and {r.score for r in got} <= {0.5, None}


def test_stages_on_empty_tables(spark, tmp_path):
    assert stages_over(spark, tmp_path, []) == []
