"""Mixing of sources to target weights by the cube method.

Targets: sources in code-point order, null last, take weights in turn; together
they share the sum of all sizes by weight. A target stops at ``cap`` times its
source's size and the excess is shared again by weight. As a closed form: with
the sources in the order of cap over weight, the water level is the largest of
(total - caps before) / (weight from here on), and a target is the smaller of
its cap and weight times level.

Sample: a document is taken as many whole times as its source's target holds
its source's size, and once more with the fraction left as its inclusion
probability. The flight phase of the cube method moves these probabilities
through the null space of the two balancing constraints, documents and words,
until all but two of a group are 0 or 1. Groups are bounded slices of a source;
what they leave undecided is dealt into fewer groups and moved again, until a
source fits one group and the landing decides its last few documents so that
the words come nearest to the target.

Defined results: null texts have size 0; documents of size 0 are taken for 0
words; repeated rows are separate documents; nothing but the hash of the rows
decides, so reruns agree. An empty table gives an empty mix.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents that a group of the flight phase holds on average, over all sources.
GROUP_ROWS = 512
#: Sources up to which their table is broadcast; beyond, it is joined with salt.
BROADCAST_SOURCES = 50_000
EDGE = 1e-9


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target), one row for each source."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")).withColumn(
        "limit", F.col("source_size") * float(cap)
    )
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        weighed.withColumn("level", left / weight_left)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least("limit", F.col("weight") * F.col("level")).alias("target"))
    )


def _with_targets(sized: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    columns = [f"a.{c}" for c in sized.columns] + ["b.source_size", "b.target"]
    if n_sources <= BROADCAST_SOURCES:
        return sized.alias("a").join(F.broadcast(targets.alias("b")), same).select(*columns)
    salts = 64
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    spread = targets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.alias("a").join(spread.alias("b"), same & (F.col("a.salt") == F.col("b.salt"))).select(*columns)


def flight(share: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Shares moved until at most two are neither 0 nor 1; their sum and that of share * size stay."""
    share, size = share.tolist(), size.tolist()
    rng = np.random.default_rng(seed)
    draws = iter(rng.random(2 * len(share) + 4).tolist())
    active: list[int] = []
    waiting = iter([i for i, p in enumerate(share) if EDGE < p < 1 - EDGE])
    while True:
        while len(active) < 3:
            i = next(waiting, None)
            if i is None:
                break
            active.append(i)
        if len(active) < 3:
            return np.array(share)
        a, b, c = active
        move = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(move):
            move = (1.0, -1.0, 0.0)
        up = min(((1 - share[i]) / m if m > 0 else -share[i] / m) for i, m in zip(active, move, strict=True) if m)
        down = min((share[i] / m if m > 0 else (share[i] - 1) / m) for i, m in zip(active, move, strict=True) if m)
        step = up if next(draws) * (up + down) < down else -down
        kept = []
        for i, m in zip(active, move, strict=True):
            p = share[i] + step * m
            share[i] = 0.0 if p <= EDGE else 1.0 if p >= 1 - EDGE else p
            if 0.0 < share[i] < 1.0:
                kept.append(i)
        active = kept


def landing(share: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last undecided shares rounded so that the words, then the documents, come nearest."""
    share = share.copy()
    open_ = np.flatnonzero((share > 0) & (share < 1))
    if len(open_):
        words, documents = (share * size)[open_].sum(), share[open_].sum()
        share[open_] = min(
            itertools.product((0.0, 1.0), repeat=len(open_)),
            key=lambda x: (abs(float(np.dot(x, size[open_])) - words), abs(sum(x) - documents), x),
        )
    return share


def _fly(units: DataFrame, groups: int, level: int) -> DataFrame:
    """One round of the flight phase in ``groups`` slices of each source; the landing too if it is one."""
    columns = units.columns

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        # Long documents first: those that stay undecided are short, and so is the landing's error.
        rows = rows.sort_values(["size", "mark", "share"], ascending=[False, True, True], kind="stable")
        size = rows["size"].to_numpy("float64")
        seed = int(rows["mark"].iloc[0]) & 0x7FFFFFFF
        share = flight(rows["share"].to_numpy("float64"), size, seed)
        return rows.assign(share=landing(share, size) if groups == 1 else share)[columns]

    return (
        units.withColumn("slice", F.pmod(F.xxhash64(F.lit(level), "mark"), F.lit(groups)))
        .groupBy("source", "slice")
        .applyInPandas(lambda rows: move(rows.drop(columns="slice")), units.schema)
    )


def sample(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, column: str = "text") -> DataFrame:
    """(doc_id, mark, size, source_size, target, times): how often the mix takes each row.

    ``mark`` is a hash of id and text with which a caller can join the rows back.
    """
    text = text_or_empty(column)
    sized = cut(
        docs.select("doc_id", F.xxhash64("doc_id", text).alias("mark"), "source", word_count(text).alias("size"))
    )
    targets = cut(source_targets(sized, weights, cap))
    counts = sized.agg(F.count("*").alias("rows")).first()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aimed = (
        _with_targets(sized, targets, targets.count())
        .withColumn("ratio", ratio)
        .withColumn("whole", F.floor(F.col("ratio") + F.lit(1e-9)))
        .withColumn("share", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
        .withColumn("share", F.when((F.col("share") < 1e-9) | (F.col("size") == 0), 0.0).otherwise(F.col("share")))
        .drop("ratio")
    )
    undecided = aimed.where("share > 0")
    done = [aimed.where("share = 0")]
    rows, level = counts["rows"], 0
    while True:
        groups = max(1, -(-rows // GROUP_ROWS))
        flown = cut(_fly(undecided, groups, level))
        done.append(flown.where("share = 0 or share = 1"))
        if groups == 1:
            break
        undecided = flown.where("share > 0 and share < 1")
        rows, level = min(undecided.count(), rows // 2), level + 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select(
        "doc_id", "mark", "size", "source_size", "target", (F.col("whole") + F.col("share")).cast("long").alias("times")
    )


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, column: str = "text") -> DataFrame:
    """The rows as the mix takes them: repeated or left out. Rows equal in id and text share one decision."""
    times = (
        sample(docs, weights, cap, column)
        .groupBy(F.col("mark").alias("_mark"))
        .agg(F.max("times").cast("int").alias("_times"))
        .where("_times > 0")
    )
    # The rows travel as one struct, so that no name of theirs can clash.
    return (
        docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", text_or_empty(column)).alias("_mark"))
        .join(times, "_mark")
        .select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_times"))).alias("_repeat"))
        .select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    )
