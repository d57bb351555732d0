"""Exact top-k by inner product in norm buckets.

Vectors are grouped by length. For a query whose k-th best score so far is
theta, a bucket can only matter where theta / (|query| * longest in the bucket),
its local cosine threshold, is at most 1. Where it is high, coordinate pruning
takes the feasible range of the query's largest coordinate in the bucket's list
sorted by that coordinate; else length pruning takes the bucket's vectors that
are long enough. What is left is verified by whole integer products.

The first theta of each query comes from a bounded set of vectors, the longest and
some others. All vectors are dealt to norm buckets, and within these to slices of
bounded size; queries to blocks in order of theta / |query|, the length that a
vector needs to matter. A block and a bucket meet only where the bucket's longest
vector is as long as the block's least needed length, so neither queries nor
vectors travel where they cannot matter. Where all vectors are about equally long
nothing can be excluded before the products' bounds are looked at inside a slice.
What a block and a slice return is at most k rows a query, merged by rank.

Defined results: vectors that are null or hold null or non-finite components
take no part; vectors of another length than a query's are no candidates of it;
a query's own rows (equal id) are no candidates; equal scores rank by the
smaller id; repeated rows are candidates each, but one query, and vectors that
share a query's id are queried together. An empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 1024
#: Vectors from which the first thresholds come: the longest, and as many others chosen by hash.
SEEDS = 1024
#: Queries in a block, and vectors in a slice at least and at most.
QUERY_BLOCK = 16_384
SLICE = (1024, 32_768)
#: Norm buckets of all vectors, and blocks of queries, at most.
NORM_BUCKETS, MOST_BLOCKS = 64, 8_192
#: Vectors of a slice in one norm bucket at most, and the ratio of lengths within one.
BUCKET_ROWS = 2048
BUCKET_RATIO = 1.1
#: Local cosine threshold from which coordinate pruning is tried.
COORDINATE_FROM = 0.6

SCORED = "query_id long, vec_id long, score long"


def usable(vector: str) -> Column:
    number = F.col(vector)
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return number.isNotNull() & (F.size(number) > 0) & fine


def quantised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v, norm) of the vectors that take part, with integer components."""
    return (
        vectors.where(F.col("vec_id").isNotNull() & usable(vector))
        .select(F.col("vec_id").cast("long"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("int64")


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in floating point where that cannot round."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        return (queries.astype("float64") @ vectors.astype("float64").T).astype("int64")
    return queries @ vectors.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search_slice(
    query_ids: np.ndarray, queries: np.ndarray, theta: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> pd.DataFrame:
    """Of each query the k best vectors of a slice that reach its theta; -inf: no threshold is known."""
    norms = np.sqrt((vectors.astype("float64") ** 2).sum(1))
    order = np.argsort(-norms, kind="stable")
    ids, vectors, norms = ids[order], vectors[order], norms[order]
    lengths = np.sqrt((queries.astype("float64") ** 2).sum(1))
    theta = theta.copy()
    held_scores = [np.zeros(0, "int64")] * len(query_ids)
    held_ids = [np.zeros(0, "int64")] * len(query_ids)

    def take(q: int, places: np.ndarray, scores: np.ndarray) -> None:
        fine = (scores >= theta[q]) & (ids[places] != query_ids[q])
        if not fine.any():
            return
        s, i = np.append(held_scores[q], scores[fine]), np.append(held_ids[q], ids[places][fine])
        top = best(s, i, k)
        held_scores[q], held_ids[q] = s[top], i[top]
        if len(top) == k:
            theta[q] = max(theta[q], s[top[-1]])

    begin = 0
    while begin < len(ids):
        end = begin + int(np.searchsorted(-norms[begin:], -norms[begin] / BUCKET_RATIO, side="right"))
        end = min(max(end, begin + 1), begin + BUCKET_ROWS)
        longest = norms[begin]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(theta <= 0, -1.0, theta / (lengths * longest))
        open_ = np.flatnonzero(~(local > 1 + 1e-9))
        by_length = []
        sorted_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q in open_:
            if local[q] >= COORDINATE_FROM:
                unit = queries[q] / lengths[q]
                f = int(np.argmax(np.abs(unit)))
                if f not in sorted_by:
                    values = vectors[begin:end, f] / np.maximum(norms[begin:end], 1e-300)
                    places = np.argsort(values, kind="stable")
                    sorted_by[f] = (values[places], places + begin)
                values, places = sorted_by[f]
                spread = np.sqrt(max(0.0, 1 - local[q] ** 2)) * np.sqrt(max(0.0, 1 - unit[f] ** 2))
                middle = local[q] * unit[f]
                # cosine >= local confines the angle to the axis to that of the query, give or take arccos(local)
                low = middle - spread if unit[f] > -local[q] else -1.0
                high = middle + spread if unit[f] < local[q] else 1.0
                a, b = np.searchsorted(values, (low - 1e-9, high + 1e-9))
                if b - a < (end - begin) // 4:
                    take(q, places[a:b], products(queries[q : q + 1], vectors[places[a:b]])[0])
                    continue
            by_length.append(q)
        if by_length:
            with np.errstate(divide="ignore", invalid="ignore"):
                needed = np.where(theta[by_length] <= 0, 0.0, theta[by_length] / lengths[by_length])
            shortest = float(np.nan_to_num(needed).min())
            reach = begin + int(np.searchsorted(-norms[begin:end], -shortest * (1 - 1e-12), side="right"))
            places = np.arange(begin, reach)
            scores = products(queries[by_length], vectors[begin:reach])
            for row, q in enumerate(by_length):
                take(q, places, scores[row])
        begin = end
    return pd.DataFrame(
        {
            "query_id": np.repeat(query_ids, [len(x) for x in held_ids]),
            "vec_id": np.concatenate([*held_ids, np.zeros(0, "int64")]),
            "score": np.concatenate([*held_scores, np.zeros(0, "int64")]),
        }
    )


def _seeded(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The queries with theta, the k-th best score among the seeds (null: fewer than k)."""
    own = vectors.select("vec_id", "v", "norm")
    longest = own.orderBy(F.col("norm").desc(), "vec_id").limit(SEEDS)
    others = own.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(SEEDS)
    # One row counts once, so that no threshold is too high.
    seeds = longest.unionByName(others).dropDuplicates(["vec_id"]).select("vec_id", "v").collect()
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {len(r.v) for r in seeds}:
        rows = [r for r in seeds if len(r.v) == width]
        by_width[width] = (np.array([r.vec_id for r in rows]), np.array([r.v for r in rows], "int64"))

    def seed(batches):
        for batch in batches:
            theta = []
            for own, v in zip(batch["vec_id"], batch["v"], strict=True):
                ids, rows = by_width.get(len(v), (np.zeros(0, "int64"), np.zeros((0, len(v)), "int64")))
                scores = products(np.asarray(v, "int64")[None, :], rows[ids != own])[0] if len(ids) else ids
                theta.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None)
            yield batch.assign(theta=pd.Series(theta, dtype="float64"))[["vec_id", "v", "norm", "theta"]]

    return queries.mapInPandas(seed, "vec_id long, v array<long>, norm double, theta double")


def _ranges(rows: DataFrame, value: str, parts: int) -> Column:
    """Number of the range of a column's values that a row lies in, at most ``parts`` of about as many rows."""
    if parts <= 1:
        return F.lit(0)
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = sorted(set(rows.agg(F.percentile_approx(value, shares, 10 * parts)).first()[0] or []))
    held = F.from_json(F.lit(json.dumps(bounds)), "array<double>")
    # Binding through a one-element array, so that the value is not computed anew for each bound.
    return F.transform(F.array(F.col(value)), lambda own: F.size(F.filter(held, lambda x: x < own)))[0]


def _table(values: dict[int, object], kind: str, key: str) -> Column:
    """The value of a row's key in a small table that is a constant of the plan."""
    listed = [values.get(i) for i in range(max(values, default=0) + 1)]
    return F.get(F.from_json(F.lit(json.dumps(listed)), f"array<{kind}>"), F.col(key))


def dealt(asked: DataFrame, ready: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors as they travel: once for each block and slice in which they can matter."""
    seeded = cut(_seeded(asked, ready, k))
    # The length that a vector needs for this query: none where theta is not known or not positive.
    seeded = seeded.withColumn("needed", F.when(F.col("theta") > 0, F.try_divide("theta", "norm")).otherwise(0.0))
    rows, queries = ready.count(), seeded.count()
    slice_rows = min(max(SLICE[0], rows // 200), SLICE[1])
    seeded = seeded.withColumn("range", _ranges(seeded, "needed", min(MOST_BLOCKS, max(1, -(-queries // QUERY_BLOCK)))))
    bucketed = ready.withColumn("bucket", _ranges(ready, "norm", min(NORM_BUCKETS, max(1, rows // slice_rows))))
    # Both tables are bounded by the numbers of ranges and buckets.
    ranges = seeded.groupBy("range").agg(F.min("needed").alias("needed"), F.count("*").alias("n")).orderBy("range").collect()
    buckets = bucketed.groupBy("bucket").agg(F.max("norm").alias("norm"), F.count("*").alias("n")).collect()
    # Equal needed lengths or norms fill one range or bucket: it is cut into blocks or slices by hash.
    blocks, first = {}, 0
    for r in ranges:
        blocks[r.range] = list(range(first, first + max(1, -(-r.n // QUERY_BLOCK))))
        first = blocks[r.range][-1] + 1
    slices = {g.bucket: max(1, -(-g.n // slice_rows)) for g in buckets}
    meet = [(r.range, g.bucket) for r in ranges for g in buckets if g.norm >= r.needed * (1 - 1e-9)]
    to_buckets = {r.range: [g for x, g in meet if x == r.range] for r in ranges}
    to_blocks = {g.bucket: [b for x, y in meet if y == g.bucket for b in blocks[x]] for g in buckets}

    def by_hash(seed: int, parts: Column, *of: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *of), parts).cast("int")

    left = (
        seeded.select(
            "vec_id", "v", "theta", F.size("v").alias("width"),
            (_table({r: b[0] for r, b in blocks.items()}, "int", "range") + by_hash(2, _table({r: len(b) for r, b in blocks.items()}, "int", "range"), "vec_id", "v")).alias("block"),
            F.explode(_table(to_buckets, "array<int>", "range")).alias("bucket"),
        )
        .withColumn("slice", F.explode(F.sequence(F.lit(0), _table(slices, "int", "bucket") - 1)))
    )
    right = bucketed.select(
        "vec_id", "v", F.size("v").alias("width"), "bucket",
        by_hash(1, _table(slices, "int", "bucket"), "vec_id").alias("slice"),
        F.explode(_table(to_blocks, "array<int>", "bucket")).alias("block"),
    )
    return left, right


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k vectors with the highest integer products."""
    ready = quantised(vectors, vector)
    asked = ready.where(is_query).dropDuplicates(["vec_id", "v"])
    left, right = dealt(asked, ready, k)

    def meet(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(own):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        theta = queries["theta"].fillna(float("-inf")).to_numpy("float64")
        return search_slice(
            queries["vec_id"].to_numpy("int64"), _matrix(queries["v"]), theta, own["vec_id"].to_numpy("int64"), _matrix(own["v"]), k
        )

    keys = ("bucket", "slice", "block", "width")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, SCORED)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
