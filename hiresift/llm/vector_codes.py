"""Vector codes by product quantisation; the codebooks come from Lloyd's rounds on partition-local heaps.

Vectors of whole numbers are cut into parts, and each part position has a codebook
of a few entries. A round assigns every part to its nearest entry and replaces each
entry by the rounded-down mean of its parts.

Rows stay in the partitions that they are read in, in blocks of bounded size. Each
block has a heap for each entry of each codebook. It holds the parts assigned to
the entry, keyed by slack: how much closer the entry is than any other, from exact
distances at the time, plus the drift that the entry had gathered by then. An
entry's drift grows each round by its own move and the largest move of another. A
part can only change where its key is at most the drift of today, so these, and no
others, are popped and compared exactly with all entries; bounds are rounded so
that a tie is always popped. A round gives the driver the changes of the sums, as
many numbers as the codebooks have, added up on the executors.

Between rounds the blocks are kept in Spark's cache, on disk where memory is short.
No round shuffles rows, so a lost executor's blocks are made again from the scan of
their own partitions alone.

Defined results: vectors that are null or hold null or non-finite components take
no part, nor do empty ones and those that cannot be cut evenly. Vectors of other
lengths have codebooks of their own. A codebook starts from the smallest ids that
are not null, of an id's several rows the smallest vector; with fewer ids it has as
many entries, and with none its length takes no part. Rows without id are coded
like all others; repeated rows count each and get equal codes. Integers beyond 64
bits count as the nearest 64-bit ones; errors of more than 38 digits are null. An
empty table gives no rows. Other columns are not read unless asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DecimalType, IntegerType, StringType, StructField, StructType

from .common import cut
from .slack_heaps import at_most, exchange
from .whitening import by_width, integers

#: Rows of a block at most.
BLOCK_ROWS = 32_768
#: Bounds and drifts are widened by this share, far more than floating point can be wrong by.
MARGIN = 1e-9
#: Groups whose totals are broadcast at most; beyond, only groups of more than 1 / HEAVY_SHARE of the rows are.
BROADCAST_GROUPS, HEAVY_SHARE = 10_000, 1_000

WHOLE = DecimalType(38, 0)


@dataclass
class Codebooks:
    """The entries of all parts of one width, their drifts, and the sums of what is assigned to them."""

    entries: np.ndarray  # part, entry, position: whole numbers
    drifts: np.ndarray  # part, entry
    totals: np.ndarray = field(repr=False)  # part, entry, 1 + position: count and sums, of any length

    @classmethod
    def start(cls, seeds: np.ndarray, parts: int) -> Codebooks:
        entries = np.stack(np.split(seeds, parts, axis=1))
        shape = entries.shape
        return cls(entries, np.zeros(shape[:2]), np.zeros((*shape[:2], shape[2] + 1), dtype=object))

    def updated(self, changes: np.ndarray) -> Codebooks:
        """The codebooks after the means of a round; entries without parts stay."""
        totals = self.totals + changes
        entries = self.entries.copy()
        for p, e in np.ndindex(entries.shape[:2]):
            if totals[p, e, 0]:
                entries[p, e] = [s // totals[p, e, 0] for s in totals[p, e, 1:]]
        squares = ((entries.astype(object) - self.entries.astype(object)) ** 2).sum(2)
        moves = np.sqrt(squares.astype("float64")) * (1 + MARGIN)
        order = np.sort(moves, axis=1)
        others = np.repeat(order[:, -1:], moves.shape[1], axis=1)
        top = moves.argmax(1)
        others[np.arange(len(moves)), top] = order[:, -2] if moves.shape[1] > 1 else 0.0
        return Codebooks(entries, (self.drifts + moves + others) * (1 + MARGIN), totals)

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column for each entry: in floating point only where it cannot round."""
    far = int(np.abs(parts).max(initial=0)) + int(np.abs(entries).max(initial=0)) if _tame(parts) and _tame(entries) else 2**64
    bound = 4 * parts.shape[1] * far * far
    if bound < 2**53:
        a, b = parts.astype("float64"), entries.astype("float64")
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    kind = "int64" if bound < 2**63 else object
    return np.stack([((parts.astype(kind) - e.astype(kind)) ** 2).sum(1) for e in entries], axis=1)


def _tame(values: np.ndarray) -> bool:
    return values.dtype != object and not (values == np.iinfo("int64").min).any()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part the nearest entry, ties to the first, and a lower bound of how much closer it is than the next."""
    found = distances(parts, entries)
    first = found.argmin(1)
    rows = np.arange(len(parts))
    own = np.sqrt(found[rows, first].astype("float64"))
    if len(entries) == 1:
        return first, np.full(len(parts), np.inf)
    others = found.astype("float64")
    others[rows, first] = np.inf
    return first, np.sqrt(others.min(1)) * (1 - MARGIN) - own * (1 + MARGIN)


@dataclass
class Block:
    """Some rows of one width with their heaps: keys and items (places in the block) of each part and entry."""

    vectors: np.ndarray
    heaps: list[list[tuple[np.ndarray, np.ndarray]]]

    @classmethod
    def start(cls, vectors: np.ndarray, books: Codebooks) -> tuple[Block, np.ndarray]:
        parts, entries, _ = books.entries.shape
        empty = (np.zeros(0), np.zeros(0, "int32"))
        block = cls(vectors, [[empty] * entries for _ in range(parts)])
        everything = np.arange(len(vectors), dtype="int32")
        changes = np.zeros(books.totals.shape, dtype=object)
        for part in range(parts):
            block._place(part, books, everything, None, [np.zeros(0, "int64")] * entries, changes)
        return block, changes

    def part(self, number: int, books: Codebooks) -> np.ndarray:
        size = books.entries.shape[2]
        return self.vectors[:, number * size : (number + 1) * size]

    def advance(self, books: Codebooks) -> np.ndarray:
        """Pop what the drifts may have moved, assign it anew; returns the changes of counts and sums."""
        changes = np.zeros(books.totals.shape, dtype=object)
        for part, heaps in enumerate(self.heaps):
            holes = [at_most(keys, books.drifts[part, e]) for e, (keys, _) in enumerate(heaps)]
            popped = np.concatenate([items[at] for (_, items), at in zip(heaps, holes, strict=True)])
            if len(popped):
                self._place(part, books, popped, np.repeat(np.arange(len(holes)), [len(h) for h in holes]), holes, changes)
        return changes

    def _place(self, part: int, books: Codebooks, items, before, holes, changes) -> None:
        vectors = self.part(part, books)[items]
        now, slack = nearest(vectors, books.entries[part])
        keys = slack + books.drifts[part][now]
        moved = np.ones(len(items), bool) if before is None else now != before
        numbers = vectors.astype("int64" if _tame(vectors) and np.abs(vectors).max(initial=0) < 2**47 else object)
        for e, (old_keys, old_items) in enumerate(self.heaps[part]):
            arrived = now == e
            if len(holes[e]) or arrived.any():
                self.heaps[part][e] = exchange(old_keys, old_items, holes[e], keys[arrived], items[arrived])
            _count(changes[part, e], numbers[arrived & moved], 1)
            if before is not None:
                _count(changes[part, e], numbers[(before == e) & moved], -1)

    def codes(self) -> np.ndarray:
        """Entry of each row and part."""
        found = np.empty((len(self.vectors), len(self.heaps)), "uint8")
        for part, heaps in enumerate(self.heaps):
            for e, (_, items) in enumerate(heaps):
                found[items, part] = e
        return found

    def errors(self, codes: np.ndarray, books: Codebooks) -> list[int]:
        total = np.zeros(len(codes), dtype=object)
        for part, entries in enumerate(books.entries):
            total += distances_to_own(self.part(part, books), entries[codes[:, part]])
        return [int(t) for t in total]


def distances_to_own(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    largest = max(int(np.abs(x).max(initial=0)) if _tame(x) else 2**64 for x in (parts, entries))
    kind = "int64" if parts.shape[1] * (2 * largest) ** 2 < 2**63 else object
    return ((parts.astype(kind) - entries.astype(kind)) ** 2).sum(1).astype(object)


def _count(change: np.ndarray, vectors: np.ndarray, sign: int) -> None:
    if len(vectors):
        change[0] += sign * len(vectors)
        change[1:] += sign * vectors.sum(0).astype(object)


def _whole(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


def _state_fields(kept: list[StructField]) -> StructType:
    """A block as a row: its kept columns as arrays, its numbers as packed bytes, the last changes of the sums."""
    return StructType(
        [
            *[StructField(f.name, ArrayType(f.dataType, True)) for f in kept],
            StructField("width", IntegerType()), StructField("kind", StringType()), StructField("vectors", BinaryType()),
            StructField("sizes", BinaryType()), StructField("keys", BinaryType()), StructField("items", BinaryType()),
            StructField("changes", ArrayType(WHOLE)),
        ]
    )


def _packed(kept: list[pa.Array], block: Block, changes: np.ndarray, names: list[str]) -> pa.RecordBatch:
    heaps = [heap for part in block.heaps for heap in part]
    own = [
        pa.array([block.vectors.shape[1]], "int32"),
        pa.array([block.vectors.dtype.str]),
        pa.array([block.vectors.tobytes()], "binary"),
        pa.array([np.array([len(k) for k, _ in heaps], "int32").tobytes()], "binary"),
        pa.array([np.concatenate([k for k, _ in heaps]).tobytes()], "binary"),
        pa.array([np.concatenate([i for _, i in heaps]).tobytes()], "binary"),
        pa.ListArray.from_arrays(pa.array([0, changes.size], "int32"), _whole(changes.ravel().tolist())),
    ]
    return pa.RecordBatch.from_arrays([*kept, *own], names=names)


def _unpacked(batch: pa.RecordBatch, row: int, parts: int) -> Block:
    value = {c: batch.column(c)[row].as_py() for c in ("width", "kind", "vectors", "sizes", "keys", "items")}
    vectors = np.frombuffer(value["vectors"], value["kind"]).reshape(-1, value["width"])
    cuts = np.cumsum(np.frombuffer(value["sizes"], "int32"))[:-1]
    keys, items = np.split(np.frombuffer(value["keys"]), cuts), np.split(np.frombuffer(value["items"], "int32"), cuts)
    heaps = list(zip(keys, items, strict=True))
    entries = len(heaps) // parts
    return Block(vectors, [heaps[p * entries : (p + 1) * entries] for p in range(parts)])


def _narrowed(vectors: np.ndarray) -> np.ndarray:
    """The vectors in the shortest integers that hold them."""
    low, high = vectors.min(initial=0), vectors.max(initial=0)
    for kind in ("int16", "int32"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return vectors.astype(kind)
    return vectors


def blocks(rows: DataFrame, books: dict[int, Codebooks], kept: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows in blocks, all parts assigned to the first codebooks."""
    schema = _state_fields([rows.schema[c] for c in kept])
    names, place = schema.fieldNames(), len(kept)

    def made(held: list[tuple[list[pa.Array], np.ndarray]]) -> pa.RecordBatch:
        vectors = _narrowed(np.concatenate([v for _, v in held]))
        block, changes = Block.start(vectors, books[vectors.shape[1]])
        columns = [pa.concat_arrays([k[i] for k, _ in held]) for i in range(place)]
        ends = pa.array([0, len(vectors)], "int32")
        return _packed([pa.ListArray.from_arrays(ends, c) for c in columns], block, changes, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            for places, vectors in by_width(batch, place):
                for begin in range(0, len(places), block_rows):
                    at = pa.array(places[begin : begin + block_rows])
                    held = waiting.setdefault(vectors.shape[1], [])
                    if held and sum(len(v) for _, v in held) + len(at) > block_rows:
                        yield made(held)
                        held.clear()
                    held.append(([batch.column(i).take(at) for i in range(place)], vectors[begin : begin + block_rows]))
        for held in waiting.values():
            yield made(held)

    return rows.select(*kept, "x").mapInArrow(run, schema)


def advanced(state: DataFrame, books: dict[int, Codebooks], parts: int) -> DataFrame:
    """The blocks after one more assignment."""
    names = state.columns
    place = names.index("width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _unpacked(batch, row, parts)
                changes = block.advance(books[block.vectors.shape[1]])
                yield _packed([batch.column(i).slice(row, 1) for i in range(place)], block, changes, names)

    return state.mapInArrow(run, state.schema)


def summed(state: DataFrame, books: dict[int, Codebooks]) -> dict[int, Codebooks]:
    """The codebooks after the means of the blocks' last assignment."""
    changes = {width: np.zeros(b.totals.size, dtype=object) for width, b in books.items()}
    totals = state.select("width", F.posexplode("changes").alias("at", "change")).groupBy("width", "at").agg(F.sum("change").alias("change"))
    for r in totals.where("change <> 0").collect():
        changes[r.width][r["at"]] = int(r.change)
    return {width: b.updated(changes[width].reshape(b.totals.shape)) for width, b in books.items()}


def coded(state: DataFrame, books: dict[int, Codebooks], kept: list[StructField], parts: int) -> DataFrame:
    """The rows with their codes and errors by the codebooks that they were assigned to last."""
    schema = StructType([*kept, StructField("code", StringType()), StructField("error", WHOLE), StructField("codebooks_sha256", StringType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _unpacked(batch, row, parts)
                own = books[block.vectors.shape[1]]
                codes = block.codes()
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(row, 1).flatten() for i in range(len(kept))],
                        pa.array([c.tobytes().hex() for c in codes]),
                        _whole(block.errors(codes, own)),
                        pa.array([own.digest] * len(codes)),
                    ],
                    names=names,
                )

    return state.mapInArrow(run, schema)


def first_vectors(rows: DataFrame, key: str, entries: int) -> list[list[int]]:
    """The vectors of the smallest ids; of an id's several rows the smallest."""
    found, after = [], F.col(key).isNotNull()
    while len(found) < entries:
        page = rows.where(after).orderBy(key, "x").select(key, "x").limit(entries).collect()
        if not page:
            break
        for r in page:
            if not found or r[key] != found[-1][key]:
                found.append(r)
        after = F.col(key) > page[-1][key]
    return [list(r.x) for r in found[:entries]]


def encode(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    vector: str = "embedding", key: str = "vec_id", keep: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, kept columns, code, error, codebooks_sha256) of the vectors that take part.

    The code has two hex digits for each part; the error is the sum of the parts' final
    squared distances; the digest is that of the final codebooks of the vector's length.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part: 256 entries at most")
    kept = [key, *[c for c in keep if c != key]]
    named = [F.col(c).alias(f"kept{i}") for i, c in enumerate(kept)]
    rows = vectors.select(*named, F.col(vector).alias("vector"))
    columns = [f"kept{i}" for i in range(len(kept))]
    rows = integers(rows, scale, "vector", *columns).where(F.col("width") % parts == 0)
    widths = [r.width for r in rows.groupBy("width").count().collect()]
    seeds = {w: first_vectors(rows.where(F.col("width") == w), "kept0", entries) for w in widths}
    books = {w: Codebooks.start(np.array(s, "int64"), parts) for w, s in seeds.items() if s}
    if not books:
        fields = [StructField(c, f.dataType) for c, f in zip(kept, (rows.schema[c] for c in columns), strict=True)]
        return vectors.sparkSession.createDataFrame(
            [], StructType([*fields, StructField("code", StringType()), StructField("error", WHOLE), StructField("codebooks_sha256", StringType())])
        )
    rows = rows.where(F.col("width").isin(list(books)))
    before, state = None, blocks(rows, books, columns, block_rows).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(rounds):
        books = summed(state, books)
        if before is not None:
            before.unpersist()
        before, state = state, advanced(state, books, parts).persist(StorageLevel.MEMORY_AND_DISK)
    found = cut(coded(state, books, [rows.schema[c] for c in columns], parts))
    for held in (before, state):
        if held is not None:
            held.unpersist()
    return found.withColumnsRenamed(dict(zip(columns, kept, strict=True)))


def with_group_totals(rows: DataFrame, group: str, value: str, into: str) -> DataFrame:
    """The rows with the sum of a value over the rows of equal group, nulls together.

    Totals are added up before they travel. Few of them are broadcast; of many only
    those of large groups, at most HEAVY_SHARE, and the rest meet their rows by key.
    """
    totals = cut(rows.groupBy(group).agg(F.sum(value).alias(into), F.count("*").alias("members")))
    seen = totals.agg(F.count("*").alias("groups"), F.sum("members").alias("rows")).first()

    def met(own: DataFrame, with_: DataFrame) -> DataFrame:
        other = with_.select(F.col(group).alias("group_of_total"), into)
        return own.join(other, F.col(group).eqNullSafe(F.col("group_of_total")), "inner").drop("group_of_total")

    if seen.groups <= BROADCAST_GROUPS:
        return met(rows, F.broadcast(totals))
    is_heavy = F.col("members") > seen.rows // HEAVY_SHARE
    heavy = F.broadcast(totals.where(is_heavy))
    rest = rows.join(heavy.select(F.col(group).alias("heavy")), F.col(group).eqNullSafe(F.col("heavy")), "left_anti")
    return met(rows, heavy).unionByName(met(rest, totals.where(~is_heavy)))
