"""What travels in the exact top-k search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiresift.llm import topk


@pytest.mark.parametrize(("spread", "share"), [(1.5, 0.35), (0.0, 1.0)])
def test_vectors_travel_only_where_they_can_matter(spark, monkeypatch, spread, share):
    """With norms of any spread most pairs of blocks and slices are never formed; with equal norms every group stays bounded."""
    monkeypatch.setattr(topk, "SLICE", (100, 100))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 50)
    monkeypatch.setattr(topk, "SEEDS", 200)
    rng = np.random.default_rng(1)
    n = 4000
    vectors = rng.normal(size=(n, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors *= np.exp(spread * rng.normal(size=(n, 1)))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    ready = topk.quantised(table)
    left, right = topk.dealt(ready.where(F.col("vec_id") % 10 == 0), ready, 10)
    blocks, slices = left.select("block").distinct().count(), n // 100
    assert blocks >= 8
    assert right.count() <= share * n * blocks + n and left.count() <= share * 400 * slices + 400 * (slices if spread == 0 else 1)
    sizes = right.groupBy("bucket", "slice", "block").count().agg(F.max("count")).first()[0]
    queries = left.groupBy("bucket", "slice", "block").count().agg(F.max("count")).first()[0]
    assert sizes <= 200 and queries <= 100


def test_one_needed_length_for_all_is_cut_by_hash(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE", (50, 50))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    table = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [-1.0, 0.0]) for i in range(600)], "vec_id long, embedding array<double>")
    ready = topk.quantised(table)
    left, right = topk.dealt(ready.where("vec_id % 3 = 0"), ready, 400)  # fewer than k seeds: no threshold
    assert left.groupBy("bucket", "slice", "block").count().agg(F.max("count")).first()[0] <= 45
    assert right.groupBy("bucket", "slice", "block").count().agg(F.max("count")).first()[0] <= 110
    got = topk.top_k(table, F.col("vec_id") % 300 == 0, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 2), (0, 4), (0, 6), (300, 0), (300, 2), (300, 4)]
