"""Byte-level BPE encoding and decoding.

Encoding cuts a text at added tokens, then into pre-tokens, and merges the
symbols of each pre-token: a priority queue holds the merge ranks of adjacent
symbols of a doubly linked list, and entries whose symbols have changed since
are skipped when they surface. Decoding joins the vocabulary strings of the ids.

The vocabulary is a ``tokenizers`` JSON file, given by its path on the
executors. Null and empty texts give no ids. Repeated rows give equal ids. All
other columns are kept.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import map_texts

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pre-tokens that either of a worker's two caches, a younger and an older, holds.
CACHED_PRE_TOKENS = 150_000
LONGEST_CACHED = 64
#: Widths of the fields of merge keys and of queue entries.
ID_BITS, PLACE_BITS = 24, 40
ID_MASK, PLACE_MASK = (1 << ID_BITS) - 1, (1 << PLACE_BITS) - 1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for shift, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + shift)
    return [letters[b] for b in range(256)]


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are packed as little-endian 32-bit integers")
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocab: dict[str, int] = content["model"]["vocab"]
        letters = byte_letters()
        value = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = [vocab[letter] for letter in letters]
        self.merges = {}
        for rank, pair in enumerate(content["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << ID_BITS | vocab[right]] = rank << ID_BITS | vocab[left + right]
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.strings = {i: bytes(value[c] for c in name) for name, i in vocab.items() if name not in self.added}
        self.strings |= {i: name.encode() for name, i in self.added.items()}
        self.pre_tokens = regex.compile(PRE_TOKEN)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        byte_ids, merges = self.byte_ids, self.merges
        symbol = [byte_ids[b] for b in data]
        end = len(symbol)
        if end == 1:
            return symbol
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        queue = []  # rank and place of a merge in one integer
        left = symbol[0]
        for i in range(1, end):
            right = symbol[i]
            found = merges.get(left << ID_BITS | right)
            if found is not None:
                queue.append(found >> ID_BITS << PLACE_BITS | i - 1)
            left = right
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & PLACE_MASK
            j = after[i]
            left = symbol[i]
            if left < 0 or j >= end:
                continue  # stale: the symbol has been merged into another since
            found = merges.get(left << ID_BITS | symbol[j])
            if found is None or found >> ID_BITS != entry >> PLACE_BITS:
                continue  # stale: one of the two has changed since
            merged = symbol[i] = found & ID_MASK
            symbol[j] = -1
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                found = merges.get(merged << ID_BITS | symbol[k])
                if found is not None:
                    heappush(queue, found >> ID_BITS << PLACE_BITS | i)
            h = before[i]
            if h >= 0:
                found = merges.get(symbol[h] << ID_BITS | merged)
                if found is not None:
                    heappush(queue, found >> ID_BITS << PLACE_BITS | h)
        return [s for s in symbol if s >= 0]

    def _known(self, token: str) -> bytes:
        """Packed ids of a pre-token that the younger cache does not hold."""
        known = self.older.get(token)
        if known is None:
            known = array("I", self.merge(token.encode("utf-8", "surrogatepass"))).tobytes()
            if len(token) > LONGEST_CACHED:
                return known
        if len(self.cache) >= CACHED_PRE_TOKENS:
            self.older, self.cache = self.cache, {}
        self.cache[token] = known
        return known

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for piece in self.added_pattern.split(text) if self.added_pattern else [text]:
            if piece in self.added:
                out.append(array("I", [self.added[piece]]).tobytes())
                continue
            for token in self.pre_tokens.findall(piece):
                known = self.cache.get(token)
                out.append(self._known(token) if known is None else known)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return unpack(self.packed(text)).tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.get, ids)).decode("utf-8", "replace")


def unpack(packed: bytes) -> array:
    ids = array("I")
    ids.frombytes(packed)
    return ids


_LOADED: dict[str, ByteBpe] = {}


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary lies on this machine; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def loaded(name: str) -> ByteBpe:
    """The vocabulary, read once in each Python worker."""
    if name not in _LOADED:
        _LOADED[name] = ByteBpe(vocabulary_path(name))
    return _LOADED[name]


IDS = ArrayType(IntegerType())
CHECKED = StructType([StructField("ids", IDS), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())])
DIGESTS = StructType(
    [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
)


def id_lists(packed: list[bytes]) -> pa.ListArray:
    """Packed ids as lists of integers."""
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "int32")))


def encode(docs: DataFrame, vocabulary: str, column: str = "text", into: str = "ids") -> DataFrame:
    """The rows with the ids of the whole text as an array of integers."""

    def start():
        bpe = loaded(vocabulary)
        return lambda texts: id_lists([bpe.packed(t) for t in texts])

    return map_texts(docs, column, into, IDS, start)


def decode(rows: DataFrame, vocabulary: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of an array of ids; null ids give the empty text."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(vocabulary)
        for ids in batches:
            yield pd.Series(["" if x is None else bpe.decode(x.tolist()) for x in ids])

    return rows.withColumn(into, decoded(F.col(column)))


def encode_checked(docs: DataFrame, vocabulary: str, column: str = "text", into: str = "bpe") -> DataFrame:
    """The rows with a struct of ids, n_tokens and round_trip: whether decoding the ids gives the text.

    Encoding and decoding share one pass, and so one Python worker for each task.
    """

    def start():
        bpe = loaded(vocabulary)

        def run(texts: list[str]) -> pa.StructArray:
            packed = [bpe.packed(t) for t in texts]
            same = [bpe.decode(unpack(p)) == t for p, t in zip(packed, texts, strict=True)]
            counts = pa.array([len(p) // 4 for p in packed], pa.int64())
            return pa.StructArray.from_arrays([id_lists(packed), counts, pa.array(same)], names=CHECKED.names)

        return run

    return map_texts(docs, column, into, CHECKED, start)


def round_trip(docs: DataFrame, vocabulary: str, column: str = "text", into: str = "bpe") -> DataFrame:
    """The rows with a struct of n_tokens, ids_sha256 and decoded_sha256.

    The ids are made and decoded in one pass, so that they need not travel.
    """

    def start():
        bpe = loaded(vocabulary)

        def run(texts: list[str]) -> pa.StructArray:
            counts, ids, texts_back = [], [], []
            for text in texts:
                packed = bpe.packed(text)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts_back.append(hashlib.sha256(bpe.decode(unpack(packed)).encode("utf-8")).hexdigest())
            return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts_back)], names=DIGESTS.names)

        return run

    return map_texts(docs, column, into, DIGESTS, start)
