"""Document fingerprints by I-Match, with DataFrame functions only.

A term is a lower-cased word. The lexicon keeps the terms whose share of
documents lies in a band, that is, whose inverse document frequency does. Of a
text's distinct lexicon terms, those in each of several randomised subsets of the
lexicon are sorted and hashed; the fingerprint is the list of these hashes. The
subsets have different shares, so that long and short texts alike have some in
which only a few of their terms lie.

The lexicon is bounded: terms in at least a share ``LOWEST`` of all documents
number at most (mean distinct terms of a document) / ``LOWEST``, however many
documents there are. Up to ``LEXICON_TERMS`` of them reach the executors as a
constant of the plan, dealt into buckets so that looking up a term is one array
access. A larger lexicon (of very long documents) stays a table: the terms of the
texts are joined with it.

Defined results: null text counts as empty; a text without lexicon terms is
fingerprinted by all its terms; equal texts have equal fingerprints; the
likeness of two fingerprints is the share of equal hashes among the subsets in
which either has terms. Documents are ordered by descending id, null ids last,
then by a hash of the text, then text. An empty table gives no rows. Other columns
take no part.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty, words

#: Band of the share of documents that a lexicon term occurs in.
LOWEST, HIGHEST = 0.002, 0.1
#: Randomised orders of the lexicon, and the subsets taken of each: one term in two to these powers.
ORDERS, HALVINGS = 4, range(3, 11)
HASHES = 1 + ORDERS * len(HALVINGS)
LEXICON_BUCKETS = 16_384
#: Terms of a lexicon that is a constant of the plan at most.
LEXICON_TERMS = 400_000
#: Documents of neighbouring ids in one window, and such windows at most; ids looked at for each window's bounds.
ID_RANGE_ROWS = 500
MOST_ID_RANGES = 8_192
BOUND_SAMPLE = 20
LEAST_LONG = -(1 << 63)


def terms(text: Column) -> Column:
    """Distinct hashes of the terms of a text."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon_terms(docs: DataFrame, column: str = "text", lowest: float = LOWEST, highest: float = HIGHEST) -> DataFrame:
    """(term): the term hashes whose share of documents lies in the band."""
    total = docs.count()
    least = max(2, -int(-lowest * total // 1))
    most = max(least, int(highest * total))
    counted = docs.select(F.explode(terms(text_or_empty(column))).alias("term")).groupBy("term").count()
    return counted.where(F.col("count").between(least, most)).select("term")


def constant_lexicon(found: DataFrame) -> Column:
    """Constant array of arrays of term hashes, by hash modulo ``LEXICON_BUCKETS``."""
    buckets = defaultdict(list)
    for row in found.collect():
        buckets[row.term % LEXICON_BUCKETS].append(row.term)
    content = json.dumps([sorted(buckets.get(b, [])) for b in range(LEXICON_BUCKETS)], separators=(",", ":"))
    return F.from_json(F.lit(content), "array<array<bigint>>")


def lexicon_filter(docs: DataFrame, column: str = "text") -> Callable[[DataFrame, str, str], DataFrame]:
    """A function that adds to rows, from their text column, the sorted terms that the lexicon of ``docs`` holds."""
    found = cut(lexicon_terms(docs, column))
    if found.count() <= LEXICON_TERMS:
        words_kept = constant_lexicon(found)

        def in_lexicon(t: Column) -> Column:
            return F.array_contains(F.get(words_kept, F.pmod(t, F.lit(LEXICON_BUCKETS)).cast("int")), t)

        return lambda rows, text, into: rows.withColumn(into, F.sort_array(F.filter(terms(F.col(text)), in_lexicon)))

    def joined(rows: DataFrame, text: str, into: str) -> DataFrame:
        key = [F.xxhash64(F.lit(k), text).alias(f"_h{k}") for k in (1, 2)]
        kept = (
            rows.select(*key, F.explode(terms(F.col(text))).alias("term"))
            .join(found, "term")
            .groupBy("_h1", "_h2")
            .agg(F.sort_array(F.collect_set("term")).alias(into))
        )
        return (
            rows.select("*", *key)
            .join(kept, ["_h1", "_h2"], "left")
            .drop("_h1", "_h2")
            .withColumn(into, F.coalesce(into, F.array().cast("array<bigint>")))
        )

    return joined


def _ordered(k: int, t: Column) -> Column:
    return F.xxhash64(t, F.lit(k))


def fingerprint(text: Column, kept_terms: Column) -> Column:
    """Array of the hashes of a text's terms in the lexicon, given sorted, and in each subset of it; 0 where it has none there."""
    halvings = F.array(*[F.lit((1 << level) - 1).cast("bigint") for level in HALVINGS])

    def of_subset(chosen: Column) -> Column:
        return F.when(F.size(chosen) > 0, F.xxhash64(chosen)).otherwise(F.lit(0).cast("bigint"))

    def of_order(ordered: Column) -> Column:
        return F.transform(halvings, lambda mask: of_subset(F.filter(ordered, lambda h: h.bitwiseAND(mask) == 0)))

    def hashes(kept: Column) -> Column:
        orders = [F.transform(kept, partial(_ordered, k)) for k in range(ORDERS)]
        return F.concat(F.array(of_subset(kept)), F.flatten(F.transform(F.array(*orders), of_order)))

    # Binding through a one-element array, so that the terms are not evaluated twice.
    return F.flatten(
        F.transform(
            F.array(kept_terms),
            lambda x: F.when(F.size(x) > 0, hashes(x)).otherwise(F.array_repeat(F.xxhash64(F.sort_array(terms(text))), HASHES)),
        )
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes of two fingerprints among the subsets in which either has terms."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    used = F.size(F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0)))
    equal = F.size(F.filter(pairs, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
    return (equal / used).cast("double")


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "-")


def _id_ranges(rows: DataFrame) -> Column:
    """Number of the range of ids, then of falling hashes of the text, that a row lies in; ranges hold about equally many rows.

    Their bounds come from a sample by hash of bounded size, so neither outlying
    nor clustered nor null nor repeated ids make a range large. Looking a row up
    is one step over the square root of all bounds and one over as many.
    """
    key = F.struct(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG)).alias("a"),
        F.col("doc_id").isNotNull().cast("long").alias("b"),
        F.bitwise_not(F.xxhash64("text")).alias("c"),
    )
    total = rows.count()
    ranges = min(MOST_ID_RANGES, max(1, -(-total // ID_RANGE_ROWS)))
    one_in = max(1, total // (ranges * BOUND_SAMPLE))
    sample = rows.select(key.alias("key")).where(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(one_in)) == 0).distinct()
    # A group of copies under one id counts once, so the sample may be larger than meant by no more than chance.
    ordered = sorted(tuple(r.key) for r in sample.collect())
    step = max(1, len(ordered) // ranges)
    bounds = ordered[step::step]
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def constant(value: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), kind)

    as_rows = [[dict(zip("abc", b, strict=True)) for b in g] for g in groups]
    one = "struct<a:bigint,b:bigint,c:bigint>"
    firsts, all_ = constant([g[0] for g in as_rows], f"array<{one}>"), constant(as_rows, f"array<array<{one}>>")
    reached = F.size(F.filter(firsts, lambda x: x <= key))
    inside = F.size(F.filter(F.get(all_, reached - 1), lambda x: x <= key))
    return F.when(reached == 0, F.lit(0)).otherwise((reached - 1) * width + inside).cast("long")


def with_next(rows: DataFrame, following: dict[str, str], mark: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The rows with columns of the next row by descending doc_id; after the last comes the first.

    Ids are cut into ranges of about ``ID_RANGE_ROWS`` rows. Each range is a
    window, to which the first row of the next range is dealt as a guest. ``mark``
    adds the columns that are taken from the next row and not there yet.
    """
    ranged = rows.withColumn("_range", _id_ranges(rows))
    falling = Window.orderBy(F.col("_range").desc())
    heads = cut(
        ranged.select("doc_id", F.xxhash64("text").alias("h"), "_range")
        .groupBy("_range")
        .agg(F.max_by(F.struct("doc_id", "h"), F.struct("doc_id", F.bitwise_not("h"))).alias("head"))
    )
    # One row for each range: their number is bounded.
    heads = heads.select(
        F.coalesce(F.lag("_range").over(falling), F.min("_range").over(Window.partitionBy())).alias("_host"),
        F.col("head.doc_id").alias("_head_id"), F.col("head.h").alias("_head_hash"), F.col("_range").alias("_of"),
    )
    is_head = (F.col("_range") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_head_id")) & (F.xxhash64("text") == F.col("_head_hash"))
    guests = ranged.join(F.broadcast(heads), is_head).select(*rows.columns, F.col("_host").alias("_range"), F.lit(1).alias("_guest"))
    own = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    both = mark(ranged.withColumn("_guest", F.lit(0)).unionByName(guests))
    return (
        both.select("*", *[F.lead(c).over(own).alias(name) for c, name in following.items()])
        .where("_guest = 0")
        .drop("_guest", "_range")
    )


def edited_pairs(docs: DataFrame, column: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, with the edited text itself.

    The edited text has its last half replaced by as much of the next document's beginning.
    """
    rows = docs.select("doc_id", text_or_empty(column).alias("text"))
    in_lexicon = lexicon_filter(rows)

    def marked(both: DataFrame, text: str, into: str) -> DataFrame:
        return in_lexicon(both, text, "_kept").withColumn(into, fingerprint(F.col(text), F.col("_kept"))).drop("_kept")

    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = with_next(rows, {"text": "next_text", "hashes": "next_hashes"}, lambda both: marked(both, "text", "hashes")).withColumn(
        "edited",
        F.concat(
            F.substring(F.col("text"), F.lit(1), F.char_length("text") - half),
            F.substring(F.col("next_text"), F.lit(1), half),
        ),
    )
    return marked(edited, "edited", "edited_hashes")
