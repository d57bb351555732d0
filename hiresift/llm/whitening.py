"""Embedding whitening from an exact integer scatter matrix.

Components become integers, and one vector of the table, the shift, is taken from
each. Sums and cross-products of what is left are kept as integers of any length;
the scatter matrix n * X'X - S S', which no shift changes, is formed from them
without rounding, and only then divided by n * n as floating point and decomposed.

Each distinct integer vector counts once in the fit. Tasks multiply blocks of rows
in floating point, in limbs so short that no product or sum rounds, and hand over
the rows of their matrices in limbs of 32 bits, so that adding them cannot overflow.
Rows of equal number meet in one task; the decomposition of a width is one task, as
it needs the whole matrix of width * width numbers. The driver gets a few numbers
for each dimension, never a matrix or a vector of the table.

Defined results: vectors that are null, empty or hold null or non-finite components
take no part. Vectors of different lengths are fitted and whitened apart, each
length as a table of its own. Integers beyond 64 bits count as the nearest 64-bit
ones. A component whose eigenvalue is zero up to rounding (constant or dependent
dimensions, one vector only) has no whitened value: it is null, as is the identity
error where no component has any. Repeated rows are one vector of the fit and are
all returned; an empty table gives no rows. A deviation of more than 38 digits is
null. Only the id and the vector are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from .topk import usable

#: Bits of the limbs in which blocks are multiplied, and rows of a block: 2 * 20 + 12 bits stay below 53.
LIMB_BITS, BLOCK_ROWS = 20, 4096
#: Bits of the limbs in which partial matrices travel, and how many there are: 64 + 64 bits, and 63 for the number of rows.
WIRE_BITS, WIRE_LIMBS = 32, 6
#: An accumulator of 64-bit integers is emptied before its bound gets here.
FULL = 2**62
#: Numbers below this are subtracted as 64-bit integers.
NARROW = 2**61

PARTIAL = "width int, row int, limbs binary"
FITTED = "width int, n string, sums array<string>, directions array<double>, eigenvalues array<double>, trace double"


@dataclass(frozen=True)
class Whitening:
    """What whitens the vectors of one width: n and the sums as whole numbers, a row of directions for each component."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def whole(self) -> np.ndarray:
        """Which components have any variance."""
        least = len(self.sums) * np.finfo("float64").eps * max(self.eigenvalues.max(initial=0.0), 0.0)
        return self.eigenvalues > least

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: 64-bit integers where they suffice, else Python's."""
        bound = self.n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, self.sums), default=0)
        kind = "int64" if bound < FULL else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """A column for each component, NaN where it has no variance."""
        centred = (deviations / self.n).astype("float64")
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.whole, centred @ self.directions.T / np.sqrt(self.eigenvalues), np.nan)


def integers(vectors: DataFrame, scale: int, vector: str, *columns: str) -> DataFrame:
    """(columns, x, width) of the vectors that take part, x as whole numbers rounded down."""
    return vectors.where(usable(vector)).select(
        *columns, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)).alias("x"), F.size(vector).alias("width")
    )


def by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each length, with their vectors as one matrix."""
    lists = batch.column(column)
    flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for width in np.unique(lengths):
        places = np.flatnonzero(lengths == width)
        yield places, flat[(ends[places] - width)[:, None] + np.arange(width)]


def _limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signed limbs, the lowest first: values = sum of limb[i] * 2 ** (bits * i)."""
    found = []
    while True:
        if (np.abs(values) < 2 ** (bits - 1)).all():
            return [*found, values.astype("int64")]
        low = ((values + 2 ** (bits - 1)) & (2**bits - 1)) - 2 ** (bits - 1)
        found.append(low.astype("int64"))
        values = (values - low) >> bits


def products(rows: np.ndarray) -> np.ndarray:
    """rows' * rows without rounding: 64-bit integers for short numbers, else Python's."""
    limbs = [x.astype("float64") for x in _limbs(rows, LIMB_BITS)]
    if len(limbs) == 1:
        return (limbs[0].T @ limbs[0]).astype("int64")
    total = np.zeros((rows.shape[1], rows.shape[1]), dtype=object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype("int64").astype(object) << (LIMB_BITS * (i + j))
    return total


class Scatter:
    """Running sum of y'y of rows y = (1, x - shift): n, the sums and the cross-products in one matrix."""

    def __init__(self, shift: list[int]):
        self.shift = np.array(shift, dtype=object)
        self.small = all(abs(s) < NARROW for s in shift)
        self.total = np.zeros((len(shift) + 1, len(shift) + 1), dtype=object)
        self.recent, self.bound = np.zeros(self.total.shape, "int64"), 0

    def add(self, x: np.ndarray) -> None:
        for begin in range(0, len(x), BLOCK_ROWS):
            part = x[begin : begin + BLOCK_ROWS]
            narrow = self.small and (part < NARROW).all() and (part > -NARROW).all()
            kind = "int64" if narrow else object
            moved = part.astype(kind) - self.shift.astype(kind)
            new = products(np.concatenate([np.ones((len(part), 1), kind), moved], axis=1))
            if new.dtype == object:
                self.total += new
                continue
            if self.bound + 2**53 >= FULL:
                self.flush()
            self.recent += new
            self.bound += 2**53

    def flush(self) -> np.ndarray:
        self.total += self.recent.astype(object)
        self.recent[:], self.bound = 0, 0
        return self.total


def wire(values: np.ndarray) -> bytes:
    """Whole numbers as WIRE_LIMBS limbs each, all but the highest without sign."""
    held, limbs = values.astype(object), []
    for _ in range(WIRE_LIMBS - 1):
        limbs.append((held & (2**WIRE_BITS - 1)).astype("int64"))
        held = held >> WIRE_BITS
    return np.stack([*limbs, held.astype("int64")]).tobytes()


def unwired(limbs: np.ndarray) -> list[int]:
    return [sum(int(x) << (WIRE_BITS * i) for i, x in enumerate(column)) for column in limbs.T]


def scatter_rows(fit: DataFrame, shifts: dict[int, list[int]]) -> DataFrame:
    """(width, row, limbs): each row of the upper triangle of the matrix of a width, summed over all vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Scatter] = {}
        for batch in batches:
            for _, x in by_width(batch, 0):
                held.setdefault(x.shape[1], Scatter(shifts[x.shape[1]])).add(x)
        for width, scatter in held.items():
            total = scatter.flush()
            for row in range(width + 1):
                yield _row(width, row, wire(total[row, row:]))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for width, row, limbs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                numbers = np.frombuffer(limbs, "int64").reshape(WIRE_LIMBS, -1)
                held[width, row] = held[width, row] + numbers if (width, row) in held else numbers
        for (width, row), numbers in held.items():
            yield _row(width, row, numbers.tobytes())

    return fit.select("x").mapInArrow(partial, PARTIAL).repartition("width", "row").mapInArrow(added, PARTIAL)


def _row(width: int, row: int, limbs: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([width], "int32"), pa.array([row], "int32"), pa.array([limbs], "binary")], names=["width", "row", "limbs"]
    )


def decomposed(n: int, sums: list[int], cross: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Directions, eigenvalues and trace of (n * cross - sums sums') / n**2; all three come as whole numbers."""
    column = np.array(sums, dtype=object)
    scatter = cross * n - np.outer(column, column)
    squared = n * n
    # Quotients of whole numbers are rounded once, however long the numbers are.
    covariance = np.array([[v / squared for v in row] for row in scatter], "float64")
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return vectors[:, order].T, np.maximum(values[order], 0.0), sum(scatter.diagonal()) / squared


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first vector of each width in a partition."""
    seen = set()
    for batch in batches:
        for places, x in by_width(batch, 0):
            if x.shape[1] not in seen:
                seen.add(x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], "int32"), batch.column(0).slice(places[0], 1)], names=["width", "x"])


def fit(distinct: DataFrame, components: int) -> dict[int, Whitening]:
    """The whitening of each width, from distinct integer vectors (x, width)."""
    shifts = {r.width: list(r.x) for r in distinct.select("x").mapInArrow(_firsts, "width int, x array<long>").groupBy("width").agg(F.min("x").alias("x")).collect()}

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        width = int(rows["width"].iloc[0])
        total = np.zeros((width + 1, width + 1), dtype=object)
        for row, limbs in zip(rows["row"], rows["limbs"], strict=True):
            numbers = unwired(np.frombuffer(limbs, "int64").reshape(WIRE_LIMBS, -1))
            total[row, row:] = numbers
            total[row:, row] = numbers
        n = total[0, 0]
        directions, values, trace = decomposed(n, list(total[0, 1:]), total[1:, 1:], components)
        sums = [str(s + n * at) for s, at in zip(total[0, 1:], shifts[width], strict=True)]
        return pd.DataFrame([[width, str(n), sums, directions.ravel(), values, trace]], columns=[f.split()[0] for f in FITTED.split(", ")])

    return {
        r.width: Whitening(int(r.n), tuple(map(int, r.sums)), np.array(r.directions).reshape(-1, r.width), np.array(r.eigenvalues), r.trace)
        for r in scatter_rows(distinct, shifts).groupBy("width").applyInPandas(solve, FITTED).collect()
    }


def identity_errors(distinct: DataFrame, models: dict[int, Whitening]) -> dict[int, float | None]:
    """Of each width the largest absolute entry of the whitened vectors' covariance minus the identity."""
    most = max((len(m.eigenvalues) for m in models.values()), default=0)
    names = [f"w{i}" for i in range(most)]
    schema = StructType([StructField("width", IntegerType()), *[StructField(c, DoubleType()) for c in names]])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in by_width(batch, 0):
                model = models[x.shape[1]]
                w = np.full((len(x), most), np.nan)
                w[:, : len(model.eigenvalues)] = model.whitened(model.deviations(x))
                columns = [pa.array(c, from_pandas=True) for c in w.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], "int32")), *columns], names=["width", *names])

    # covar_pop subtracts running means before it multiplies, and merges partial results of all tasks.
    pairs = [(i, j) for i in range(most) for j in range(i + 1)]
    covariances = distinct.select("x").mapInArrow(project, schema).groupBy("width").agg(
        F.count("*").alias("n"), *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]
    )
    return {
        r.width: max((abs(c - (i == j)) for i, j in pairs if (c := r[f"c{i}_{j}"]) is not None), default=None)
        for r in covariances.collect()
    }


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    ``deviation`` is the sum of (n * x - S) ** 2 as a whole number, ``explained`` the
    component's share of the whole variance.
    """
    rows = integers(vectors, scale, vector, key)
    distinct = rows.select("x", "width").distinct().persist(StorageLevel.DISK_ONLY)
    try:
        models = fit(distinct, components)
        errors = identity_errors(distinct, models) if models else {}
    finally:
        distinct.unpersist()
    named = [
        StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", DecimalType(38, 0)),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in by_width(batch, 1):
                model, error = models[x.shape[1]], errors[x.shape[1]]
                deviations, k = model.deviations(x), len(model.eigenvalues)
                whitened = model.whitened(deviations).ravel()
                explained = np.tile(model.eigenvalues / model.trace if model.trace else np.full(k, np.nan), len(x))
                rows_of = np.repeat(places, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows_of)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), len(x))),
                        pa.array(np.full(len(rows_of), model.n)),
                        _squares(deviations).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(whitened, from_pandas=True),
                        pa.array(explained, from_pandas=True),
                        pa.array([error] * len(rows_of), "double"),
                    ],
                    names=[key, *[f.name for f in named]],
                )

    return rows.select(key, "x").mapInArrow(run, StructType([rows.schema[key], *named]))


def _squares(deviations: np.ndarray) -> pa.Array:
    """Sums of the rows' squares as decimals; null beyond 38 digits."""
    most = int(np.abs(deviations).max(initial=0)) ** 2 * deviations.shape[1]
    if deviations.dtype != object and most < FULL:
        return pa.array((deviations**2).sum(1)).cast(pa.decimal128(38, 0))
    totals = (deviations.astype(object) ** 2).sum(1)
    return pa.array([Decimal(t) if t < 10**38 else None for t in totals], pa.decimal128(38, 0))
