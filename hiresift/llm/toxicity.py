"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A
window of a text is compressed with either; the bytes that the toxic dictionary
saves, against the window's length, are its evidence. The thresholds from which
a window counts, and the map from a document's windows to a score, are calibrated
on labelled rows that the dictionaries have not seen.

* A window is a white-space token, lower-cased, or two neighbours. Each token is a
  window, so no window depends on where in the text it stands. Two neighbours are one
  where a match can span both in the toxic dictionary alone: where ``min_match`` bytes
  around the space between them are in it and not in the ordinary one. Anywhere else
  the toxic dictionary finds nothing in the two that it does not find in either.
* A window is followed by a fixed carrier that ends both dictionaries, behind bytes
  that no window holds: zstandard looks for no matches in the last bytes of an input
  and stores very short ones as they are, and with the carrier any saved byte shows.
* Both dictionaries begin with a common one trained on ordinary rows, so that
  they give ordinary text equal lengths; on it follows content trained on the
  ordinary rows again, or on the toxic ones.
* Most of a toxic row is ordinary text. Which of its windows tell is found across
  halves: a long dictionary of one half of the toxic rows judges the windows of the
  other half. The toxic content is trained on windows with more evidence than nearly
  all windows of ordinary rows, in at least ``LEAST_ROWS`` rows; then ``ROUNDS`` rounds
  follow, each on what the last dictionaries find telling.

Defined results: null and empty texts have no windows and get the score of a
document without evidence; words put before a text move no window that was there. Repeated rows get equal
scores. All other columns are kept, but for one named like the result, which is
replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import map_texts
from .dictionaries import class_shares, compressor, fit_logistic, labelled_sample, logistic, train

#: What each window ends with, and what stands before it in a dictionary, so that no match spans a window's end.
CARRIER, GAP = bytes(range(22, 32)) + bytes([127, 1, 30, 2, 29, 3]), bytes([4, 5, 6])
#: Settings of the compressors: matches of five bytes and more, from a binary tree that covers the whole dictionary.
LEVEL = 13
SETTINGS = {"strategy": zstandard.STRATEGY_BTLAZY2, "window_log": 19, "hash_log": 18, "chain_log": 19, "search_log": 3, "min_match": 5, "target_length": 32}
#: Lengths of the runs of bytes by which matches of one dictionary alone are told.
RUNS = range(5, 11)
#: Bytes of the common dictionary and of the content of either label.
COMMON_BYTES, LABEL_BYTES = 230_000, 32_000
#: Bytes of the pieces that the label content is put together from, and of the parts that these are chosen by.
COVER = {"k": 32, "d": 6}
ROUNDS = 2
#: Bytes of the content that finds the telling windows of either half of the toxic rows.
WIDE_BYTES = 128_000
#: Share of the ordinary windows below which a toxic row's window is not trained on.
ORDINARY = 0.995
#: Toxic rows in which a window must tell to be trained on.
LEAST_ROWS = 2
#: Shares of the ordinary windows that lie below the thresholds.
LEVELS = (0.98, 0.995, 0.999, 0.9997)
#: Tokens of a training sample.
SAMPLE_TOKENS = 16
#: Bytes of text of either label that the sample holds at most, in whole rows.
SAMPLE_BYTES = 16_000_000
#: Windows whose evidence a worker holds before it starts anew.
CACHED_WINDOWS = 400_000


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    thresholds: tuple[float, ...]
    fitted: tuple


def pieces(text: str, tokens: int) -> list[str]:
    """A text as runs of consecutive tokens, lower-cased; each token lies in one."""
    own = text.lower().split()
    return [f" {' '.join(own[i : i + tokens])} " for i in range(0, len(own), tokens)]


def _grams(content: bytes, size: int) -> set[bytes]:
    return {content[i : i + size] for i in range(len(content) - size + 1)}


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes two dictionaries begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


class Evidence:
    """Of windows, the bytes that the toxic dictionary saves over the ordinary one, in tenths of a window's.

    A window of which every run that the toxic dictionary holds is in the ordinary one too has
    no match there that it lacks here, hence no evidence; it need not be compressed.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = (compressor(d, LEVEL, **SETTINGS) for d in (ordinary, toxic))
        self.known: dict[str, float] = {}
        # What only the toxic dictionary holds, by length; the common part of both need not be looked at.
        own = toxic[_shared(ordinary, toxic) :]
        self.only = {size: _grams(own, size) - _grams(ordinary, size) for size in RUNS}
        self.joined: dict[str, bool] = {}

    def _crosses(self, edge: str) -> bool:
        data = edge.encode("utf-8", "surrogatepass")
        size, space = SETTINGS["min_match"], data.index(b" ")
        return any(data[i : i + size] in self.only[size] for i in range(max(0, space - size + 1), min(space, len(data) - size) + 1))

    def _may_save(self, data: bytes) -> bool:
        """Whether the toxic dictionary has a match for a window that the ordinary one lacks."""
        return any(data[i : i + size] in held for size, held in self.only.items() for i in range(len(data) - size + 1))

    def windows(self, text: str) -> list[str]:
        """Every token, and every two neighbours that a match of the toxic dictionary alone can span."""
        own = text.lower().split()
        found = [f" {t} " for t in own]
        joined, reach = self.joined, SETTINGS["min_match"] - 1
        if len(joined) > CACHED_WINDOWS:
            joined.clear()
        for a, b in zip(own, own[1:], strict=False):
            edge = f"{a[-reach:]} {b[:reach]}"
            hit = joined.get(edge)
            if hit is None:
                hit = joined[edge] = self._crosses(edge)
            if hit:
                found.append(f" {a} {b} ")
        return found

    def of(self, own: list[str]) -> list[float]:
        """The evidence of each window; what a window gave is kept."""
        known = self.known
        new = [w for w in dict.fromkeys(own) if w not in known]
        if new:
            if len(known) + len(new) > CACHED_WINDOWS:
                known = self.known = {}
                new = list(dict.fromkeys(own))
            ordinary, toxic = self.ordinary.compress, self.toxic.compress
            for w in new:
                data = w.encode("utf-8", "surrogatepass")
                if self._may_save(data):
                    known[w] = 10 * (len(ordinary(data + CARRIER)) - len(toxic(data + CARRIER))) / len(data)
                else:
                    known[w] = 0.0
        return [known[w] for w in own]


_EVIDENCE: dict[str, Evidence] = {}


def _evidence(ordinary: bytes, toxic: bytes) -> Evidence:
    """The evidence of one pair of dictionaries, kept by a Python worker."""
    key = hashlib.sha256(ordinary + toxic).hexdigest()
    if key not in _EVIDENCE:
        _EVIDENCE.clear()
        _EVIDENCE[key] = Evidence(ordinary, toxic)
    return _EVIDENCE[key]


def _features(texts: list[str], evidence: Evidence, thresholds: tuple[float, ...]) -> list[list[float]]:
    """Of each text, how many and which share of its windows lie over each threshold, their most and their mean evidence."""
    own = [evidence.windows(t) for t in texts]
    saved = np.array(evidence.of([w for of_text in own for w in of_text]))
    ends = np.cumsum([len(w) for w in own])
    out = []
    for begin, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        seen = saved[begin:end]
        if not len(seen):
            out.append([0.0] * (2 * len(thresholds) + 2))
            continue
        hits = [int((seen > t).sum()) for t in thresholds]
        out.append([*np.log1p(hits), *np.log1p([1000 * h / len(seen) for h in hits]), float(seen.max()), float(seen.mean())])
    return out


def _counted(sample: DataFrame, dictionaries: tuple[bytes, bytes]) -> Counter:
    """How many windows of the ordinary calibration rows have each evidence."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence, seen = _evidence(*dictionaries), Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(round(saved, 3) for saved in evidence.of(evidence.windows(text)))
        yield pd.DataFrame({"saved": list(seen), "n": list(seen.values())}).astype({"saved": "float64", "n": "int64"})

    found: Counter = Counter()
    for row in sample.where("part = 1 and label = 0").mapInPandas(count, "saved double, n long").collect():
        found[row.saved] += row.n
    return found


def _below(counted: Counter, share: float) -> float:
    """The least evidence that at least a share of the windows does not exceed."""
    total, so_far = sum(counted.values()), 0
    for saved in sorted(counted):
        so_far += counted[saved]
        if so_far >= share * total:
            return saved
    return 0.0


def _telling(sample: DataFrame, dictionaries: tuple[bytes, bytes], threshold: float, half: int | None = None) -> Counter:
    """Windows of the toxic training rows, or of one half of them, with more evidence than the threshold: in how many rows each is."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence, found = _evidence(*dictionaries), Counter()
        for batch in batches:
            for text in batch["text"]:
                own = list(dict.fromkeys(evidence.windows(text)))
                found.update(w for w, saved in zip(own, evidence.of(own), strict=True) if saved > threshold)
        own = [w.encode("utf-8", "surrogatepass") for w in found]
        yield pd.DataFrame({"own": pd.Series(own, dtype="object"), "rows": pd.Series(list(found.values()), dtype="int64")})

    rows = sample.where("part = 0 and label = 1")
    rows = rows if half is None else rows.where(_half() == half)
    found: Counter = Counter()
    for r in rows.select("text").mapInPandas(pick, "own binary, rows long").collect():
        found[bytes(r.own)] += r.rows
    return found


def _repeated(telling: Counter) -> list[bytes]:
    """Windows that tell in at least ``LEAST_ROWS`` rows, as often as they do; a word that tells once is chance."""
    return [w for w, n in sorted(telling.items()) if n >= LEAST_ROWS for _ in range(n)]


def _half() -> Column:
    return F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(2)).cast("int")


def _shuffled(samples: list[bytes]) -> list[bytes]:
    """Samples in an order that does not follow their content, the same in each run."""
    return sorted(samples, key=lambda s: hashlib.blake2b(s, digest_size=8).digest())


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2500, most_bytes: int = SAMPLE_BYTES, rounds: int = ROUNDS
) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled rows of either label with at most ``most_bytes`` of text."""
    sample = labelled_sample(docs, labels, label, per_class, most_bytes)
    texts: tuple[list[bytes], list[bytes], list[bytes]] = ([], [], [])
    for row in sample.where("part = 0").withColumn("half", _half()).collect():
        of = texts[0] if row.label == 0 else texts[1 + row.half]
        of.extend(w.encode("utf-8", "surrogatepass") for w in pieces(row.text, SAMPLE_TOKENS))
    ordinary, chosen = _shuffled(texts[0]), texts[1] + texts[2]
    common = train(ordinary, COMMON_BYTES)
    # Which windows of one half of the toxic rows does the text of the other half explain better than ordinary text does?
    wide, telling = train(ordinary, WIDE_BYTES, **COVER), Counter()
    for half in (0, 1):
        dictionaries = (common + wide + GAP + CARRIER, common + train(_shuffled(texts[2 - half]), WIDE_BYTES, **COVER) + GAP + CARRIER)
        telling += _telling(sample, dictionaries, _below(_counted(sample, dictionaries), ORDINARY), half)
    chosen = _repeated(telling) or chosen
    own = train(ordinary, LABEL_BYTES, **COVER)
    for place in range(rounds):
        dictionaries = (common + own + GAP + CARRIER, common + train(_shuffled(chosen), LABEL_BYTES, **COVER) + GAP + CARRIER)
        counted = _counted(sample, dictionaries)
        if place + 1 < rounds:
            chosen = _repeated(_telling(sample, dictionaries, _below(counted, ORDINARY))) or chosen
    thresholds = tuple(_below(counted, share) for share in LEVELS)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = _evidence(*dictionaries)
        for batch in batches:
            yield pd.DataFrame(
                {"label": batch["label"].astype("int32"), "x": _features(list(batch["text"]), evidence, thresholds)}
            )

    seen = sample.where("part = 1").mapInPandas(measure, "label int, x array<double>").collect()
    seen.sort(key=lambda r: (r.label, r.x))
    x = np.array([r.x for r in seen]).reshape(-1, 2 * len(LEVELS) + 2)
    return ToxicityModel(*dictionaries, thresholds, fit_logistic(x, np.array([r.label for r in seen]), class_shares(labels, label)))


def score(docs: DataFrame, model: ToxicityModel, column: str = "text", into: str = "score") -> DataFrame:
    """The rows with a toxicity score from 0 to 1, over all windows of the whole text."""

    def start():
        evidence = _evidence(model.ordinary, model.toxic)
        return lambda texts: pa.array([logistic(model.fitted, x) for x in _features(texts, evidence, model.thresholds)], pa.float64())

    return map_texts(docs, column, into, DoubleType(), start)


def predicted(score_column: str, threshold: float) -> Column:
    return (F.col(score_column) >= threshold).cast("int")
