"""Near-duplicate documents by min-max hashing.

Under each permutation both the smallest and the largest hash of a document's
shingles are kept, so half the hash evaluations give a signature of the usual
length. ``BANDS`` bands of ``ROWS`` values each choose candidates: at the
threshold of 0.8 a pair shares no band with probability (1 - 0.8**5)**40 < 2e-7.

1. Documents with equal shingle sets form a class, represented by its smallest
   id. Everything that follows is about representatives.
2. Round 1: within each band bucket every member is paired with one hub, which
   differs from band to band. Pairs whose signatures are far too unlike go; the
   others are confirmed on their full shingle sets. This joins a group of copies
   with a number of pairs in proportion to its size.
3. Round 2: only within buckets whose members still belong to several
   components, members of different components are compared by their signatures,
   block by block for large buckets, each pair in the first band that it shares.
   The documents of likely pairs, not the pairs, go on with their full sets to
   the same blocks, which return one link for each two components that have any.

Defined results: null and empty texts have no shingles and are linked with
nothing; a text of one word has one shingle; rows without id keep a null
component and stay; repeated rows form one class; rows that share an id but no
set are linked as one document. An empty table gives no rows. All counts cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty, words
from .components import connected_components

ROWS = 5
BANDS = 40
VALUES = ROWS * BANDS
PERMUTATIONS = VALUES // 2
#: Share of equal signature values under which a pair at the threshold would lie 6 deviations off.
UNLIKE = 0.62
PERCENT = 80
#: Members of a band bucket that are compared in one block of round 2, and shingles that they have together, on average.
BLOCK, BLOCK_SHINGLES = 2048, 500_000
#: Columns of the shingle matrix that a block multiplies at once.
COLUMNS = 8192
#: Classes with over this share of all rows (at most its inverse in number) are broadcast.
HOT_SHARE = 1e-3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """Distinct 64-bit hashes of the word shingles of a text, A-Z in lower case."""

    def shingles(own: Column) -> Column:
        last = F.size(own) - size
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        whole = F.when(
            (F.size(own) > 0) & (last < 0), F.array(F.xxhash64(F.lit("short"), F.concat_ws(" ", own)))
        ).otherwise(F.array().cast("array<bigint>"))
        many = F.transform(starts, lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(size)]))
        return F.concat(F.array_distinct(many), whole)

    # One binding, so that the words are cut only once.
    return F.flatten(F.transform(F.array(words(F.translate(text, UPPER, LOWER))), shingles))


_RNG = np.random.default_rng(20_240_229)
_FACTORS = _RNG.integers(1, 2**63, PERMUTATIONS, dtype="uint64") * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, PERMUTATIONS, dtype="uint64")


def signatures(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Signature of each document, its shingle hashes lying in ``values`` from its begin on; no document is empty."""
    out = np.empty((len(begins), VALUES), "uint64")
    with np.errstate(over="ignore"):
        for p in range(PERMUTATIONS):
            hashed = values * _FACTORS[p] + _SHIFTS[p]
            hashed ^= hashed >> np.uint64(32)
            out[:, p] = np.minimum.reduceat(hashed, begins)
            out[:, PERMUTATIONS + p] = np.maximum.reduceat(hashed, begins)
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; a band holds values of different permutations."""
    keys = np.zeros((len(signature), BANDS), "uint64")
    with np.errstate(over="ignore"):
        for row in range(ROWS):
            part = signature[:, row * BANDS : (row + 1) * BANDS]
            keys = (keys ^ part) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
        keys += np.arange(BANDS, dtype="uint64") * np.uint64(0xD1342543DE82EF95)
    return keys.view("int64")


def sketch_of(signature: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """One byte of each signature value, then four of each band key."""
    values = (signature >> np.uint64(17)).astype("uint8")
    return np.hstack([values, np.ascontiguousarray(bands.astype("int32")).view("uint8")])


def _sketches(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes and band marks of a column of sketches."""
    rows = np.frombuffer(b"".join(column), "uint8").reshape(len(column), -1)
    return rows[:, :VALUES], np.ascontiguousarray(rows[:, VALUES:]).view("int32")


SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = batch.column(batch.schema.get_field_index("shingles"))
        offsets = sets.offsets.to_numpy()
        values = sets.values.to_numpy(zero_copy_only=False).view("uint64")
        counts = np.diff(offsets)
        full = np.flatnonzero(counts)
        bands = np.zeros((len(counts), BANDS), "int64")
        sketch = [None] * len(counts)
        # Slices of documents whose hashes fit a processor's cache.
        begin = 0
        while begin < len(full):
            total = np.cumsum(counts[full[begin:]])
            end = begin + max(1, int(np.searchsorted(total, 65_536, side="right")))
            own = full[begin:end]
            low, high = offsets[own[0]], offsets[own[-1] + 1]
            signed = signatures(values[low:high], offsets[own] - low)
            bands[own] = bands_of(signed)
            for i, s in zip(own, sketch_of(signed, bands[own]), strict=True):
                sketch[i] = s.tobytes()
            begin = end
        band_offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))]).astype("int32")
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_shingles", "k1", "k2")],
                pa.ListArray.from_arrays(pa.array(band_offsets), pa.array(bands[full].ravel())),
                pa.array(sketch, pa.binary()),
            ],
            names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
        )


def signed_documents(docs: DataFrame, column: str = "text", size: int = 5) -> DataFrame:
    """Id, set size, a 128-bit key of the set, band keys and sketch of each document."""
    return (
        docs.select(F.col("doc_id").cast("long"), shingle_hashes(text_or_empty(column), size).alias("shingles"))
        .withColumn("n_shingles", F.size("shingles").cast("long"))
        .withColumn("_sorted", F.sort_array("shingles"))
        .select(
            "doc_id", "n_shingles", F.xxhash64(F.lit(1), "_sorted").alias("k1"), F.xxhash64(F.lit(2), "_sorted").alias("k2"), "shingles"
        )
        .mapInArrow(_sign, SIGNED)
    )


def _likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the threshold."""
    own = signed.select(F.col("doc_id"), "n_shingles", "sketch")
    sided = pairs.join(own.toDF("a", "na", "sa"), "a").join(own.toDF("b", "nb", "sb"), "b")
    sided = sided.where("100 * least(na, nb) >= {0} * greatest(na, nb)".format(PERCENT))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                left, right = _sketches(batch["sa"])[0], _sketches(batch["sb"])[0]
                yield batch.loc[(left == right).mean(1) >= UNLIKE, ["a", "b"]]

    return sided.select("a", "b", "sa", "sb").mapInPandas(compare, "a long, b long").distinct()


def _sets(docs: DataFrame, ids: DataFrame, column: str, size: int) -> DataFrame:
    """Full shingle sets of the documents listed."""
    return (
        docs.select(F.col("doc_id").cast("long"), text_or_empty(column).alias("_text"))
        .join(ids, "doc_id", "left_semi")
        .select("doc_id", shingle_hashes(F.col("_text"), size).alias("shingles"))
    )


def confirmed(pairs: DataFrame, docs: DataFrame, column: str, size: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full shingle sets."""
    sets = cut(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), column, size))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        both.withColumn("shared", shared)
        .where(F.col("shared") * 100 >= (F.size("sa") + F.size("sb") - F.col("shared")) * PERCENT)
        .select("a", "b")
        .distinct()
    )


def _stars(buckets: DataFrame) -> DataFrame:
    """Each member of a bucket with its hub, the member with the smallest hash in that band."""
    hub = buckets.groupBy("band", "key").agg(
        F.min(F.struct(F.xxhash64("band", "doc_id").alias("h"), "doc_id")).alias("hub"), F.count("*").alias("n")
    )
    return (
        buckets.join(hub.where("n > 1"), ["band", "key"])
        .where(F.col("doc_id") != F.col("hub.doc_id"))
        .select(F.greatest("doc_id", "hub.doc_id").alias("a"), F.least("doc_id", "hub.doc_id").alias("b"))
        .distinct()
    )


def _mixed_blocks(buckets: DataFrame, signed: DataFrame, component: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, once for each pair of blocks that they are in."""
    named = buckets.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )
    mixed = (
        named.groupBy("band", "key")
        .agg(
            F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.min("component").alias("least"), F.max("component").alias("most")
        )
        .where("least < most")
        .select("band", "key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    # A member of a bucket of several blocks meets each of them, in the pair (i, j) with i <= j.
    return (
        named.join(mixed, ["band", "key"])
        .join(signed.select("doc_id", "n_shingles", "sketch"), ["doc_id", "n_shingles"])
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            "own", "doc_id", "component", "n_shingles", "sketch",
        )
    )


PLACED = "band int, key long, i int, j int, own int, doc_id long, component long, n_shingles long, sketch binary"


def _with_likely_partner(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one pair of blocks the members that have a likely partner in another component."""
    rows = rows.sort_values("n_shingles", kind="stable")
    chosen = np.zeros(len(rows), bool)
    for at, near in _likely_in_block(rows):
        chosen[at] = chosen[near] = True
    return rows[chosen]


def _likely_in_block(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Places of likely pairs of different components, each in the first band that both share; rows come by size."""
    band, i, j = (int(rows[c].iloc[0]) for c in ("band", "i", "j"))
    names, sizes, block = (rows[c].to_numpy() for c in ("component", "n_shingles", "own"))
    values, marks = _sketches(rows["sketch"])
    for at in range(len(rows)):
        end = int(np.searchsorted(sizes, sizes[at] * 100 // PERCENT, side="right"))
        near = np.arange(at + 1, max(at + 1, end))
        near = near[(names[near] != names[at]) & ((i == j) | (block[near] != block[at]))]
        if len(near):
            near = near[~(marks[near, :band] == marks[at, :band]).any(1)]
            near = near[(values[near] == values[at]).mean(1) >= UNLIKE]
            if len(near):
                yield at, near


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of shingles that each two sets share, from their incidence matrix, column slice by column slice."""
    sizes = [len(x) for x in sets]
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1  # a shingle of one set alone is shared by no two
    place = np.cumsum(often) - 1
    row, column = row[often[column]], place[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), "float32")
    for begin in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, (begin, begin + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), "float32")
        part[row[a:b], column[a:b] - begin] = 1
        total += part @ part.T
    return total


def _links_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """One confirmed link for each two components that the likely pairs of a block link."""
    rows = rows.sort_values("n_shingles", kind="stable")
    ids, names, sizes = (rows[c].to_numpy() for c in ("doc_id", "component", "n_shingles"))
    shared = shared_counts([np.asarray(x, "int64") for x in rows["shingles"]])
    found = {}
    for at, near in _likely_in_block(rows):
        linked = near[shared[at, near] * 100 >= (sizes[at] + sizes[near] - shared[at, near]) * PERCENT]
        for x in linked:
            found.setdefault((min(names[at], names[x]), max(names[at], names[x])), (max(ids[at], ids[x]), min(ids[at], ids[x])))
    return pd.DataFrame(list(found.values()), columns=["a", "b"], dtype="int64")


def links_across(buckets: DataFrame, signed: DataFrame, component: DataFrame, docs: DataFrame, column: str, size: int) -> DataFrame:
    """Confirmed links between members of one bucket that belong to different components."""
    keys = ("band", "key", "i", "j")
    # Few bytes, much work: as many partitions as the session shuffles to, not merged by their size.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = _mixed_blocks(buckets, signed, component).repartition(parts, *keys)
    placed = cut(members.groupBy(*keys).applyInPandas(_with_likely_partner, PLACED))
    sets = _sets(docs, placed.select("doc_id").distinct(), column, size).withColumn("n_shingles", F.size("shingles").cast("long"))
    return placed.join(sets, ["doc_id", "n_shingles"]).repartition(parts, *keys).groupBy(*keys).applyInPandas(_links_in_block, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, column: str = "text", size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of the input."""
    signed = cut(signed_documents(docs, column, size))
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cut(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("representative"), F.count("*").alias("n")))
    representatives = cut(
        filled.join(
            classes.select("k1", "k2", F.col("representative").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi"
        ).dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "n_shingles", "bands", "sketch")
    )
    buckets = representatives.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    repeated = buckets.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    buckets = cut(buckets.join(repeated, ["band", "key"], "left_semi"))
    links = cut(confirmed(cut(_likely(_stars(buckets), representatives)), docs, column, size))
    component = connected_components(links)
    more = cut(links_across(buckets, representatives, component, docs, column, size))
    if not more.isEmpty():
        component = connected_components(links.unionByName(more))
    return _members(signed, classes, component)


def _members(signed: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    named = cut(
        classes.join(component.withColumnRenamed("node", "representative"), "representative", "left").select(
            "k1", "k2", "n", F.coalesce("component", "representative").alias("component_id")
        )
    )
    rows = signed.select("doc_id", "n_shingles", "k1", "k2")
    least = max(1000, int(rows.count() * HOT_SHARE))
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    hot = F.broadcast(named.where(F.col("n") > least).drop("n"))
    in_hot = filled.join(hot, ["k1", "k2"], "left")
    out = (
        in_hot.where("component_id is not null")
        .unionByName(in_hot.where("component_id is null").drop("component_id").join(named.drop("n"), ["k1", "k2"]))
        .select("doc_id", "n_shingles", "component_id")
        .unionByName(
            rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        )
    )
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
