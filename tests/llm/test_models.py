"""Classifiers by held-out accuracy, search against brute force, the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hiresift.llm import quality, topk, toxicity
from hiresift.llm.common import crc_remainder

BAD = ["zorgnak", "vilmurx", "krabbeltod"]


def labelled(spark, n=900):
    rng = random.Random(4)
    syllables = ["ba", "ne", "ti", "ro", "lu", "sa", "mo", "de"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(30, 120))]
        toxic, good = i % 7 == 0, i % 5 != 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, "ba ne"), (n + 2, "ba ne")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = labelled(spark)
    held = crc_remainder("doc_id", 5) == 0
    model = module.fit(docs, labels.where(~held))
    scored = module.score(docs.withColumn("label", F.lit("clash")), model)
    rows = scored.join(labels.select("doc_id", F.col(label).alias("truth")), "doc_id").where(held).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.truth) for r in rows]) >= least
    edge = scored.where("doc_id >= 900").collect()
    assert len(edge) == 4 and all(0 <= r.score <= 1 for r in edge)
    assert len({r.score for r in edge if r.doc_id == 902}) == 1


@pytest.mark.parametrize("module", [toxicity, quality])
def test_fit_without_rows_of_both_labels(spark, module):
    docs, labels = labelled(spark, 20)
    for few in (labels.where("doc_id < 0"), labels.where("quality = 1 and toxic = 0"), labels.limit(3)):
        model = module.fit(docs, few)
        assert all(0 <= r.score <= 1 for r in module.score(docs, model).collect())
    assert module.score(docs.limit(0), model).count() == 0


def brute(rows, k):
    fine = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in fine:
        if q % 100 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_k(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "SEEDS", 20)
    monkeypatch.setattr(topk, "SLICE", (64, 64))
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(900, 8)) * np.exp(spread * rng.normal(size=(900, 1)))
    vectors[100:160] = vectors[100]  # ties
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1200, [0.0] * 8), (1201, [float("inf")] * 8), (1202, [])]
    rows += [(1300, [1.0, 2.0]), (1301, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in topk.top_k(table, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, 10)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_coordinate_pruning_keeps_every_result():
    rng = np.random.default_rng(7)
    vectors = rng.integers(-400, 400, size=(500, 6))
    queries = vectors[:40]
    scores = queries @ vectors.T
    theta = np.array([float(np.sort(np.delete(s, i))[-3]) for i, s in enumerate(scores)])
    got = topk.search_slice(np.arange(40), queries, theta, np.arange(500), vectors, 3)
    for q in range(40):
        want = sorted(((-s, i) for i, s in enumerate(scores[q]) if i != q))[:3]
        assert [(-s, i) for s, i in want] == list(got[got.query_id == q][["score", "vec_id"]].itertuples(index=False, name=None))


def test_pipeline_stages(spark, tmp_path):
    docs, labels = labelled(spark, 400)
    copy = docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 5000)
    whole = docs.unionByName(copy).select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = rows.columns
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, rows = rows, spark.read.parquet(f"{tmp_path}/{name}")
        if place + 1 < len(corpus_pipeline.STAGES):
            assert rows.columns == columns
        if name == "near_dedup":
            assert rows.where("doc_id >= 5000").count() == 0
        if name in ("quality", "near_dedup", "substring_dedup"):
            assert rows.count() <= before.count() and rows.count() > 0
    assert rows.where("not round_trip").count() == 0 and "ids" in rows.columns


@pytest.mark.parametrize("module", [toxicity, quality])
def test_very_long_texts_and_repeated_rows(spark, module):
    docs, labels = labelled(spark, 300)
    model = module.fit(docs, labels, most_bytes=20_000)
    long_text = "ba ne ti " * 150_000
    rows = spark.createDataFrame([(1, long_text), (2, long_text), (2, long_text), (None, None)], "doc_id long, text string")
    got = [r.score for r in module.score(rows, model).collect()]
    assert len(got) == 4 and len(set(got)) <= 2 and all(0 <= x <= 1 for x in got)


def test_quality_equals_a_plain_version(spark):
    """The score from the dictionaries of a fitted model, window by window, without the operator's helpers."""
    import math

    import zstandard

    docs, labels = labelled(spark, 300)
    model = quality.fit(docs, labels)
    found = {r.text: r.score for r in quality.score(docs, model).collect()}

    def size(text, content):
        data = text.encode()
        params = zstandard.ZstdCompressionParameters.from_level(quality.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        own = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=params)
        return sum(len(own.compress(data[i : i + quality.WINDOW])) for i in range(0, max(1, len(data)), quality.WINDOW))

    mean, scale, beta, intercept = model.fitted
    for text, score in list(found.items())[:60]:
        own = text or ""
        g, b = size(own, model.good), size(own, model.bad)
        x = [(b - g) / (b + g), (b - g) / max(1, len(own.encode()))]
        z = intercept + sum(w * (v - m) / s for w, v, m, s in zip(beta, x, mean, scale))
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxic_windows_do_not_depend_on_their_place(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    evidence = toxicity.Evidence(model.ordinary, model.toxic)
    for row in docs.where("text is not null").limit(40).collect():
        moved = evidence.windows("ba " + row.text)
        assert set(evidence.windows(row.text)) <= set(moved)
    rows = docs.where("length(text) > 200").selectExpr("doc_id", "text", "concat('ba ', text) as shifted").limit(300)
    scored = toxicity.score(toxicity.score(rows, model, "text", "a"), model, "shifted", "b").collect()
    assert sum((r.a >= 0.5) != (r.b >= 0.5) for r in scored) <= len(scored) * 0.01


def test_toxic_evidence_equals_a_plain_version(spark):
    """Counts of windows over each threshold, compressed one by one without any memory of earlier ones."""
    docs, labels = labelled(spark, 400)
    model = toxicity.fit(docs, labels)
    evidence = toxicity.Evidence(model.ordinary, model.toxic)
    grams = lambda d: {d[i : i + 5] for i in range(len(d) - 4)}
    only = grams(model.toxic) - grams(model.ordinary)
    for row in docs.where("text is not null").limit(25).collect():
        own = row.text.lower().split()
        pairs = []
        for a, b in zip(own, own[1:]):
            edge = f"{a} {b}".encode()
            space = len(a.encode())
            if any(g in only for g in (edge[i : i + 5] for i in range(len(edge) - 4)) if g in only and _spans(edge, g, space)):
                pairs.append(f" {a} {b} ")
        want = [f" {t} " for t in own] + pairs
        assert sorted(evidence.windows(row.text)) == sorted(want)
        saved = []
        for w in want:
            data = w.encode() + toxicity.CARRIER
            sizes = [len(toxicity.compressor(d, toxicity.LEVEL, **toxicity.SETTINGS).compress(data)) for d in (model.ordinary, model.toxic)] if len(saved) < 3 else None
            holds = any(w.encode()[i : i + n] in model.toxic and w.encode()[i : i + n] not in model.ordinary for n in toxicity.RUNS for i in range(len(w.encode()) - n + 1))
            plain = 10 * (sizes[0] - sizes[1]) / len(w.encode()) * holds if sizes else evidence.of([w])[0]
            saved.append(plain)
            assert evidence.of([w])[0] == pytest.approx(plain)
        features = toxicity._features([row.text], evidence, model.thresholds)[0]
        assert features[: len(model.thresholds)] == pytest.approx([np.log1p(sum(x > t for x in saved)) for t in model.thresholds])


def _spans(edge, gram, space):
    return any(edge[i : i + 5] == gram and i <= space < i + 5 for i in range(len(edge) - 4))
