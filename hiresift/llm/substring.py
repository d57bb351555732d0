"""Removal of word sequences that an earlier document holds too.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window
that covers it also starts in a document with a smaller id.

1. Of each window the least of its ``GRAM``-word hashes is its anchor. Equal
   windows have equal anchors, so only windows whose anchor occurs in two
   documents can repeat. Of documents equal in all their words, one with the
   smallest id stands for all; the others go as a whole.
2. The stretch of words around such an anchor, with all consecutive windows that
   it anchors (at most ``RUN`` of them, so that a long run of one phrase is a few
   stretches), is dealt to a shard by the anchor. An anchor of very many or very
   long stretches is hot: of its equal stretches those of the smallest id stand
   for all, the others go as a whole, and the rest is dealt to several shards by
   content.
3. Each shard builds a compressed FM-index of its distinct stretches and streams
   them through it by backward search: a window whose interval holds an earlier
   document is reported.
4. For hot anchors, the distinct windows of a stretch that its shard has not
   reported meet those of other shards by their hash, pre-aggregated to the
   smallest id.

Words are compared by 48 bits of a 64-bit hash inside equal 64-bit anchors, equal
stretches of hot anchors by a 64-bit hash of the stretch inside equal anchors.

Defined results: null and empty texts have no words; texts shorter than a window
lose nothing; rows without id lose nothing and take nothing; rows that share an
id take nothing from each other, repeated rows neither. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import WORD_PATTERN, cut, text_or_empty, text_slices, words
from .fmindex import FmIndex

WINDOW = 50
GRAM = 8
WORD_BYTES = 6
#: Words that a shard's stretches have on average.
SHARD_WORDS = 250_000
#: Windows of a stretch at most.
RUN = 1_000
#: Stretches from which an anchor counts as hot, and how many of them one of its shards gets.
HOT_DOCUMENTS, HOT_SHARE = 2_000, 500
#: Windows from which it does, of which one of its shards gets a quarter.
HOT_WINDOWS = 500_000
#: Words whose anchors are looked for at once.
SLICE_WORDS = 200_000

#: A document: its id and a hash of its words; for copies under other ids a second hash confirms the first.
KEY = ["doc_id", "k1"]


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _keyed(docs: DataFrame, column: str) -> DataFrame:
    """doc_id, the hashes of the words, and two hashes of all of them."""
    return docs.select(F.col("doc_id").cast("long"), word_hashes(text_or_empty(column)).alias("hashes")).select(
        "doc_id", F.xxhash64(F.lit(1), "hashes").alias("k1"), F.xxhash64(F.lit(2), "hashes").alias("k2"), "hashes"
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each document as ``WORD_BYTES`` bytes each."""
    for batch in batches:
        offsets, values = _list_parts(batch.column("hashes"))
        own = np.ascontiguousarray(values[offsets[0] : offsets[-1]].view("uint8").reshape(-1, 8)[:, :WORD_BYTES])
        ends = pa.py_buffer(((offsets - offsets[0]) * WORD_BYTES).astype("int64"))
        words_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, ends, pa.py_buffer(own)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], words_], names=[*KEY, "words"])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
        return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def anchors(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram hash at each place, and the place of the leftmost least one in the window from each place."""
    size = len(hashes) - gram + 1
    grams = np.zeros(max(0, size), "uint64")
    with np.errstate(over="ignore"):
        for j in range(gram):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + size]
            grams ^= grams >> np.uint64(31)
    width = window - gram + 1
    least = np.arange(len(grams))
    known = 1
    while known < width:
        by = min(known, width - known)
        a, b = least[: len(least) - by], least[by:]
        least = np.where(grams[a] <= grams[b], a, b)
        known += by
    return grams, least


def slice_hashes(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice: two overlapping blocks, of a power of two words, cover it."""
    sizes = ends - begins
    out = np.zeros(len(sizes), "uint64")
    block, power = hashes, 1
    while True:
        fits = np.flatnonzero((sizes >= power) & (sizes < 2 * power))
        out[fits] = _mixed(_mixed(block[begins[fits]], block[ends[fits] - power]), sizes[fits].astype("uint64"))
        if 2 * power > sizes.max(initial=0):
            return out
        block, power = _mixed(block[: len(block) - power], block[power:]), 2 * power


def _list_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


ANCHORED = "doc_id long, k1 long, k2 long, n_words int, anchors array<long>, contents array<long>, first array<int>"


def _anchored(window: int, gram: int):
    """For each document its stretches in order: anchor, hash of the content, and first window; each ends before the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = _list_parts(batch.column("hashes"))
            values = values.view("uint64")
            counts = np.diff(offsets)
            names, contents, firsts, sizes = [], [], [], np.zeros(len(counts), "int64")
            begin = 0
            while begin < len(counts):
                end = begin + max(1, int(np.searchsorted(np.cumsum(counts[begin:]), SLICE_WORDS, side="right")))
                low = offsets[begin]
                own_words = values[low : offsets[end]]
                grams, least = anchors(own_words, window, gram)
                begins, ends = [], []
                for row in range(begin, end):
                    if counts[row] < window:
                        continue
                    start = offsets[row] - low
                    own = grams[least[start : start + counts[row] - window + 1]]
                    change = np.append(True, own[1:] != own[:-1])
                    runs = np.flatnonzero(change)
                    since = np.arange(len(own)) - np.repeat(runs, np.diff(np.append(runs, len(own))))
                    edge = np.flatnonzero(since % RUN == 0)
                    names.append(own[edge].view("int64"))
                    firsts.append(edge)
                    begins.append(start + edge)
                    ends.append(start + np.append(edge[1:], len(own)) - 1 + window)
                    sizes[row] = len(edge)
                if begins:
                    contents.append(slice_hashes(own_words, np.concatenate(begins), np.concatenate(ends)).view("int64"))
                begin = end
            spans = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))

            def listed(parts, kind, spans=spans):
                return pa.ListArray.from_arrays(spans, pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))

            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in (*KEY, "k2")],
                    pa.array(counts.astype("int32")),
                    listed(names, "int64"),
                    listed(contents, "int64"),
                    listed(firsts, "int32"),
                ],
                names=[*KEY, "k2", "n_words", "anchors", "contents", "first"],
            )

    return run


STRETCH = "shard long, doc_id long, k1 long, hot boolean, anchor long, content long, first int, words binary"


def _stretches(window: int):
    """Cuts the words around each anchor out of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_words = batch.column("words")
            hits = {n: _list_parts(batch.column(f"{n}s")) for n in ("shard", "hot", "anchor", "content", "first", "last")}
            spans = hits["first"][0]
            rows = np.repeat(np.arange(len(batch)), np.diff(spans))
            first, last = hits["first"][1], hits["last"][1]
            texts = []
            for row in range(len(batch)):
                own = own_words[row].as_py()
                texts += [
                    own[a * WORD_BYTES : (b + window) * WORD_BYTES]
                    for a, b in zip(first[spans[row] : spans[row + 1]].tolist(), last[spans[row] : spans[row + 1]].tolist(), strict=True)
                ]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hits["shard"][1]),
                    *[batch.column(c).take(take) for c in KEY],
                    pa.array(hits["hot"][1].astype(bool)),
                    *[pa.array(hits[n][1]) for n in ("anchor", "content")],
                    pa.array(first.astype("int32")),
                    pa.array(texts, pa.binary()),
                ],
                names=["shard", *KEY, "hot", "anchor", "content", "first", "words"],
            )

    return run


#: Spans of documents (without h1), and distinct windows of a hot stretch that its shard has not reported, with their places in it.
FOUND = "doc_id long, k1 long, begin int, end int, anchor long, content long, h1 long, h2 long, places array<int>"


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // WORD_BYTES, 8), "uint8")
    wide[:, :WORD_BYTES] = np.frombuffer(data, "uint8").reshape(-1, WORD_BYTES)
    return wide.view("int64").ravel()


def _search(window: int):
    """Searches the stretches of one shard in its FM-index."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "k1", "first"], kind="stable").reset_index(drop=True)
        place = rows.groupby("words", sort=False).ngroup().to_numpy()
        distinct = np.flatnonzero(~rows["words"].duplicated().to_numpy())
        owner = rows["doc_id"].to_numpy("int64")
        pieces = [_unpack(rows["words"].iloc[i]) for i in distinct]
        sizes = np.array([len(p) for p in pieces])
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = np.zeros(int((sizes + 1).sum()), "int64")
        inside = np.ones(len(text), bool)
        inside[begins + sizes] = False
        text[inside] = np.unique(np.concatenate(pieces), return_inverse=True)[1] + 1
        owners = np.repeat(owner[distinct], sizes + 1)
        least = FmIndex(text, owners, window).least_owners(text, begins, begins + sizes)

        keys, firsts = rows[KEY].to_numpy("int64"), rows["first"].to_numpy("int64")
        names = rows[["anchor", "content"]].to_numpy("int64")
        found = []
        for i in range(len(rows)):
            p = place[i]
            a, n = begins[p], sizes[p] - window + 1
            earlier = least[a : a + n] < owner[i]
            edges = np.flatnonzero(np.diff(earlier.astype("int8"), prepend=0, append=0))
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                found.append((*keys[i], firsts[i] + x, firsts[i] + y - 1 + window, None, None, None, None, None))
        for i in distinct[rows["hot"].to_numpy(bool)[distinct]].tolist():
            p = place[i]
            words_ = pieces[p]
            places: dict[bytes, list[int]] = {}
            for x in np.flatnonzero(least[begins[p] : begins[p] + sizes[p] - window + 1] == owner[i]).tolist():
                places.setdefault(hashlib.blake2b(words_[x : x + window].tobytes(), digest_size=16).digest(), []).append(x)
            for mark, own in places.items():
                halves = [int.from_bytes(mark[j : j + 8], "little", signed=True) for j in (0, 8)]
                found.append((*keys[i], None, None, *names[i], *halves, own))
        columns = [*KEY, "begin", "end", "anchor", "content", "h1", "h2", "places"]
        whole = dict.fromkeys(KEY, "int64") | dict.fromkeys(("begin", "end"), "Int32") | dict.fromkeys(("anchor", "content", "h1", "h2"), "Int64")
        return pd.DataFrame(found, columns=columns, dtype="object").astype(whole)

    return run


def _hits(documents: DataFrame, window: int) -> DataFrame:
    """One row for each stretch: its document, anchor, content, first and last window."""
    return documents.select(
        *KEY, "n_words", F.posexplode(F.arrays_zip("anchors", "contents", "first")).alias("place", "hit"), F.col("first").alias("all")
    ).select(
        *KEY,
        F.col("hit.anchors").alias("anchor"),
        F.col("hit.contents").alias("content"),
        F.col("hit.first").alias("first"),
        (F.coalesce(F.get("all", F.col("place") + 1), F.col("n_words") - window + 1) - 1).alias("last"),
    )


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of rows with one row for each of their groups, which counts them in ``n``.

    Groups with over a thousandth of all rows number less than a thousand: they
    are broadcast, so that no task gets one of them whole.
    """
    frequent = F.col("n") > max(HOT_DOCUMENTS, total // 1000)
    marked = rows.join(F.broadcast(groups.where(frequent)), keys, "left")
    return marked.where(F.col("n").isNotNull()).unionByName(
        marked.where(F.col("n").isNull()).select(*rows.columns).join(groups.where(~frequent), keys)
    )


def _total(rows: DataFrame, value: Column) -> int:
    return int(rows.agg(F.sum(value)).first()[0] or 0)


def repeated_spans(docs: DataFrame, column: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, k1, k2, begin, end): spans of words that go; they may overlap."""
    anchored = cut(
        _keyed(docs.where(F.col("doc_id").isNotNull()), column).mapInArrow(_anchored(window, gram), ANCHORED)
    ).where(F.col("n_words") >= window)
    first = anchored.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).withColumn("stands", F.lit(True))
    anchored = cut(anchored.join(first, [*KEY, "k2"], "left").drop("k2").dropDuplicates(KEY))
    spans = anchored.where("stands is null").select(*KEY, F.lit(0).alias("begin"), F.col("n_words").alias("end"))
    single = anchored.where("stands")
    hits = _hits(single, window)
    windows = F.col("last") - F.col("first") + 1
    parts = F.greatest(F.ceil(F.col("n") / HOT_SHARE), F.ceil(F.col("w") * 4 / HOT_WINDOWS))
    shared = cut(
        hits.groupBy("anchor")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"), F.sum(windows).alias("w"))
        .where("a < b")
        .select("anchor", "n", F.when((F.col("n") > HOT_DOCUMENTS) | (F.col("w") > HOT_WINDOWS), parts).otherwise(1).alias("parts"))
    )
    hits = cut(_joined(hits, shared, ["anchor"], _total(single, F.size("anchors"))).drop("n"))
    group = ["anchor", "content"]
    held = hits.where("parts = 1")
    of_parts = hits.where("parts > 1")
    hot = None
    if not of_parts.isEmpty():
        contents = cut(of_parts.groupBy(*group).agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")))
        owned = _joined(of_parts, contents, group, _total(contents, F.col("n")))
        # Equal stretches of later ids go; those of the smallest id are left to search.
        spans = spans.unionByName(
            owned.where("doc_id > owner").select(*KEY, F.col("first").alias("begin"), (F.col("last") + window).alias("end"))
        )
        hot = cut(owned.where("doc_id = owner").select(*hits.columns))
        held = held.unionByName(hot)
    shards = max(1, -(-_total(held, windows + window - 1) // SHARD_WORDS))
    salt = F.pmod("content", F.col("parts"))
    shard = F.pmod(F.when(F.col("parts") > 1, F.xxhash64("anchor", salt)).otherwise(F.xxhash64("anchor")), F.lit(shards))
    names = ("shard", "hot", "anchor", "content", "first", "last")
    of_document = (
        held.select(*KEY, F.struct(shard.alias("shard"), (F.col("parts") > 1).cast("int").alias("hot"), *names[2:]).alias("hit"))
        .groupBy(*KEY)
        .agg(F.collect_list("hit").alias("hits"))
        .select(*KEY, *[F.col(f"hits.{name}").alias(f"{name}s") for name in names])
    )
    found = cut(
        _keyed(docs, column)
        .select(*KEY, "hashes")
        .mapInArrow(_packed, "doc_id long, k1 long, words binary")
        .join(of_document, KEY)
        .mapInArrow(_stretches(window), STRETCH)
        .groupBy("shard")
        .applyInPandas(_search(window), FOUND)
    )
    spans = spans.unionByName(found.where(F.col("h1").isNull()).select(*KEY, "begin", "end"))
    if hot is not None:
        open_ = found.where(F.col("h1").isNotNull())
        earliest = open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        late = open_.join(earliest, ["h1", "h2"]).where(F.col("doc_id") > F.col("least")).select(*group, F.explode("places").alias("place"))
        begin = F.col("first") + F.col("place")
        spans = spans.unionByName(hot.join(late, group).select(*KEY, begin.alias("begin"), (begin + window).alias("end")))
    return spans


_WORD = re.compile(WORD_PATTERN)


def remove_repeats(
    docs: DataFrame, column: str = "text", window: int = WINDOW, gram: int = GRAM, into: str = "repeats", texts: bool = True
) -> DataFrame:
    """The rows with a struct of n_words, n_removed, kept_sha256 and kept.

    ``kept`` are the remaining words joined by one space, null if ``texts`` is
    false; ``kept_sha256`` is their digest.
    """
    spans = repeated_spans(docs, column, window, gram).groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans")
    )
    spans = spans.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("spans.begin").alias("_begins"), F.col("spans.end").alias("_ends"))
    # The rows travel as one struct, so that no name of theirs can clash.
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.lit(1), word_hashes(text_or_empty(column))).alias("_own"))
    same = (F.col("_row.doc_id").cast("long") == F.col("_doc_id")) & (F.col("_own") == F.col("_k1"))
    joined = keyed.join(spans, same, "left").select("_row", "_begins", "_ends")
    kept = StructType(
        [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), StructField("kept", StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in text_slices(batch, batch.column("_row").field(column)):
                done = [_kept(*x, texts) for x in zip(own, part.column("_begins").to_pylist(), part.column("_ends").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(done, to_arrow_type(kept))], names=["_row", "_done"])

    out = StructType([joined.schema["_row"], StructField("_done", kept)])
    return joined.mapInArrow(run, out).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != into], F.col("_done").alias(into)
    )


def _kept(text: str, begins: list[int] | None, ends: list[int] | None, texts: bool) -> dict:
    own = _WORD.findall(text)
    n = len(own)
    if begins is not None:
        change = np.zeros(n + 1, "int64")
        np.add.at(change, begins, 1)
        np.subtract.at(change, ends, 1)
        own = [own[i] for i in np.flatnonzero(np.cumsum(change[:n]) == 0)]
    kept = " ".join(own)
    digest = hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
    return {"n_words": n, "n_removed": n - len(own), "kept_sha256": digest, "kept": kept if texts else None}
