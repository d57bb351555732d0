"""Shared parts of the two classifiers that compare zstandard dictionaries.

A classifier is fitted on a bounded sample of labelled rows (the bounds are
parameters: so many rows of either label, and fewer where their whole texts hold
more than so many bytes) and then scores every row of any table, window by
window, on the executors. Texts of the sample are taken whole.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty


def compressor(content: bytes, level: int, **settings: int) -> zstandard.ZstdCompressor:
    """Compressor over a dictionary whose frames hold no header fields to skew lengths; settings replace those of the level."""
    params = zstandard.ZstdCompressionParameters.from_level(
        level,
        **settings,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=params)


def train(samples: list[bytes], size: int, **cover: int) -> bytes:
    """zstandard dictionary of the samples; all of their plain text where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **cover).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"\n".join(samples) or b"no samples").rjust(8)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int) -> DataFrame:
    """(text, label, part): at most ``per_class`` rows of either label, cut from its lineage.

    Rows are chosen by the hash of their id, so reruns agree, and in that order as
    long as the texts of their label hold ``most_bytes`` together (the first row
    always). Ids are chosen in the label table alone, hence only a bounded id list
    is broadcast. ``part`` splits the rows into two thirds for the dictionaries (0)
    and one third for the calibration (1).
    """
    order = F.xxhash64("doc_id")
    chosen = [
        labels.where(F.col(label) == value)
        .select("doc_id", F.lit(value).alias("label"))
        .dropDuplicates(["doc_id"])
        .orderBy(order, "doc_id")
        .limit(per_class)
        for value in (0, 1)
    ]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    sample = cut(
        docs.select("doc_id", text_or_empty().alias("text"))
        .join(ids, "doc_id")
        .select("text", "label", (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(3)) == 0).cast("int").alias("part"), order.alias("order"))
    )
    sizes = sample.select("label", "order", F.octet_length("text").alias("size")).collect()
    last = {}
    for value in (0, 1):
        total = 0
        for row in sorted((r for r in sizes if r.label == value), key=lambda r: (r.order, r.size)):
            if value in last and total + row.size > most_bytes:
                break
            total += row.size
            last[value] = row.order
    fits = F.lit(False)
    for value, order_ in last.items():
        fits = fits | ((F.col("label") == value) & (F.col("order") <= order_))
    return sample.where(fits).select("text", "label", "part")


def class_shares(labels: DataFrame, label: str) -> tuple[float, float]:
    """Shares of the labels 0 and 1 among all labelled rows."""
    row = labels.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    total = max(1, row.n0 + row.n1)
    return row.n0 / total, row.n1 / total


def fit_logistic(
    features: np.ndarray, label: np.ndarray, shares: tuple[float, float], penalty: float = 1e-2
) -> tuple[list[float], list[float], list[float], float]:
    """Means, scales, weights and intercept of a ridge logistic fit by Newton steps.

    Rows are weighted so that the two labels have the shares given. Without rows
    of both labels the model is the constant share of label 1.
    """
    width = features.shape[1] if features.ndim == 2 else 0
    counts = [int((label == v).sum()) for v in (0, 1)]
    if not all(counts):
        share = min(max(shares[1], 1e-3), 1 - 1e-3)
        return [0.0] * width, [1.0] * width, [0.0] * width, math.log(share / (1 - share))
    mean, scale = features.mean(0), features.std(0) + 1e-9
    x = np.hstack([(features - mean) / scale, np.ones((len(features), 1))])
    weight = np.where(label == 1, shares[1] / counts[1], shares[0] / counts[0]) * len(label)
    beta = np.zeros(width + 1)
    ridge = penalty * np.append(np.ones(width), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (label - p)) - ridge * beta
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curvature, gradient)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return mean.tolist(), scale.tolist(), beta[:-1].tolist(), float(beta[-1])


def logistic(fitted: tuple, features) -> float:
    mean, scale, beta, intercept = fitted
    z = intercept + sum(b * (v - m) / s for v, m, s, b in zip(features, mean, scale, beta, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
