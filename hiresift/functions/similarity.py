"""String similarities for pairs that have already met, on a scale from 0 to 100.

``ratio`` is the share of characters in the longest common subsequence. The
kernels are small Python functions behind Arrow-batched UDFs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one integer as a row of bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * common_length(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a stretch of its length in the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    return max(ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio between what two token sets share and either set; 100 if one holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = x & y, x - y, y - x
    if shared and (not left or not right):
        return 100.0
    base = " ".join(sorted(shared))
    first = f"{base} {' '.join(sorted(left))}".strip()
    second = f"{base} {' '.join(sorted(right))}".strip()
    found = [ratio(first, second)]
    if base:
        found += [ratio(base, first), ratio(base, second)]
    return max(found)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def weighted_ratio(a: str, b: str) -> float:
    """Best of the whole, partial and token ratios, discounted by kind and by unequal lengths."""
    if not a or not b:
        return 0.0
    span = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    tokens = max(token_sort_ratio(a, b), token_set_ratio(a, b))
    if span < 1.5:
        return max(best, tokens * 0.95)
    scale = 0.9 if span <= 8 else 0.6
    return max(best, partial_ratio(a, b) * scale, partial_token_ratio(a, b) * 0.95 * scale)


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))


def _udf(kernel):
    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series(
                [None if a is None or b is None else kernel(a, b) for a, b in zip(left, right, strict=True)], dtype="float64"
            )

    return scored


def ratio_column(a, b):
    return _udf(ratio)(a, b)


def token_set_ratio_column(a, b):
    return _udf(token_set_ratio)(a, b)


def weighted_ratio_column(a, b):
    return _udf(weighted_ratio)(a, b)


#: Pairs of texts whose ratio a worker remembers.
REMEMBERED = 1 << 17


def best_token_set(required, own):
    """For each required string its best token-set ratio among a row's own strings, as an array.

    The same lists and the same strings meet again and again: a batch works out each pair of
    lists once, and a worker remembers the ratios of pairs of strings.
    """

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ratio_of = lru_cache(REMEMBERED)(token_set_ratio)
        for left, right in batches:
            done: dict[tuple, np.ndarray] = {}
            rows = []
            for wanted, have in zip(left, right, strict=True):
                key = (() if wanted is None else tuple(wanted), () if have is None else tuple(have))
                if key not in done:
                    done[key] = np.array([max((ratio_of(w, h) for h in key[1]), default=0.0) for w in key[0]], "float64")
                rows.append(done[key])
            yield pd.Series(rows)

    return scored(required, own)
