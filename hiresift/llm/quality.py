"""Quality by compression: dictionaries from good and from bad labelled text.

A text is cut into windows of ``WINDOW`` bytes (all of it, the last one shorter)
and each is compressed with either dictionary. The difference of the two sums of
sizes, against their sum and against the text's length, becomes a probability
through a logistic map calibrated on rows that the dictionaries have not seen, at
the shares that the labels have.

Null and empty texts count as one empty window: both sizes are equal and the
score follows from that. Repeated rows get equal scores. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType

from .common import map_texts
from .dictionaries import class_shares, compressor, fit_logistic, labelled_sample, logistic, train

WINDOW = 512
LEVEL = 3
DICTIONARY_BYTES = 100_000
#: Bytes of text of either label that the sample holds at most, in whole rows.
SAMPLE_BYTES = 16_000_000


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    fitted: tuple


def _windows(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data)), WINDOW)]


def _features(text: str, good, bad) -> list[float]:
    own = _windows(text)
    g = sum(len(good.compress(w)) for w in own)
    b = sum(len(bad.compress(w)) for w in own)
    size = max(1, sum(map(len, own)))
    return [(b - g) / (b + g), (b - g) / size]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, most_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Fit on at most ``per_class`` labelled rows of either label with at most ``most_bytes`` of text, all windows of each."""
    sample = labelled_sample(docs, labels, label, per_class, most_bytes)
    rows = [(r.label, w) for r in sample.where("part = 0").collect() for w in _windows(r.text)]
    samples = {v: sorted(w for value, w in rows if value == v) for v in (0, 1)}
    rng = np.random.default_rng(11)
    for own in samples.values():
        rng.shuffle(own)
    good, bad = (train(samples[v], DICTIONARY_BYTES) for v in (1, 0))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with_good, with_bad = compressor(good, LEVEL), compressor(bad, LEVEL)
        for batch in batches:
            yield pd.DataFrame(
                {"label": batch["label"].astype("int32"), "x": [_features(t, with_good, with_bad) for t in batch["text"]]}
            )

    seen = sample.where("part = 1").mapInPandas(measure, "label int, x array<double>").collect()
    x = np.array([r.x for r in seen]).reshape(-1, 2)
    return QualityModel(good, bad, fit_logistic(x, np.array([r.label for r in seen]), class_shares(labels, label)))


def score(docs: DataFrame, model: QualityModel, column: str = "text", into: str = "score") -> DataFrame:
    """The rows with a quality score from 0 to 1, over all windows of the whole text."""

    def start():
        good, bad = compressor(model.good, LEVEL), compressor(model.bad, LEVEL)
        return lambda texts: pa.array([logistic(model.fitted, _features(t, good, bad)) for t in texts], pa.float64())

    return map_texts(docs, column, into, DoubleType(), start)
