"""Dictionaries of any size met by their texts: an automaton finds all terms in one pass, where a text is read.

Terms are shipped to the tasks, at most ``MOST_CHARS`` characters of them at once.
A larger dictionary is cut by a hash of its terms, and a text passes one automaton
after another in the same scan; nothing of a text travels for it, and no n-gram is
formed. Time is in proportion to the text and to the occurrences found.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from hiresift.functions.arrow import map_strings
from hiresift.functions.automaton import GUARDS, Terms, counter, leftmost_longest

#: Characters of terms that one automaton holds at most.
MOST_CHARS = 8_000_000

# What confirms a term that is also a letter or a plain word.
CONTEXTS = {
    "c": (
        r"\bC\s*/\s*C\+\+", r"\bC\+\+", r"\blangage\s+C\b", r"\bprogrammation\s+(?:en\s+)?C\b", r"\bC\s+programming\b",
        r"\bC\b(?:\s*,\s*(?:C\+\+|Python|Java|Go|Rust))", r"(?:Python|Java|Go|Rust)\s*,\s*\bC\b", r"\bC\s*[/|]\s*C#",
    ),
    "r": (
        r"\bR\s+Studio\b", r"\blangage\s+R\b", r"\bR\s+programming\b", r"\bR\b(?:\s*,\s*(?:Python|Matlab|Julia|SPSS))",
        r"(?:Python|Matlab|Julia|SPSS)\s*,\s*\bR\b", r"\bstatistiques?\s+(?:avec|en)\s+R\b",
    ),
    "go": (
        r"\bGolang\b", r"\bGo\s+(?:lang|Language)\b", r"\bGo\b(?:\s*,\s*(?:Rust|Python|Java|C\+\+))", r"(?:Rust|Python|Java|C\+\+)\s*,\s*\bGo\b",
        r"\bGo\b\s*[/|,]\s*(?:Gin|Fiber|Echo)",
    ),
}

MENTION = StructType(
    [StructField("term", StringType()), StructField("category", StringType()), StructField("begin", IntegerType()), StructField("end", IntegerType())]
)
NUMBERS = ArrayType(StructType([StructField("_place", IntegerType()), StructField("n", LongType())]))


def pieces(terms: DataFrame, name: str, most: int | None = None) -> list[list]:
    """The rows of a dictionary in pieces whose names have no more characters than one automaton holds."""
    held = terms.where(F.col(name).isNotNull() & (F.col(name) != ""))
    count = -(-(held.agg(F.sum(F.length(name))).first()[0] or 0) // (most or MOST_CHARS))
    if count <= 1:
        return [held.collect()]
    return [held.where(F.pmod(F.xxhash64(name), F.lit(count)) == i).collect() for i in range(count)]


def _by_term(rows: list) -> tuple[list[str], list[list[str]]]:
    """Distinct terms in order, and the categories of each."""
    categories: defaultdict[str, list[str]] = defaultdict(list)
    for r in rows:
        categories[r.term].append(r.category)
    return list(categories), [sorted(c, key=lambda x: (x is not None, x)) for c in categories.values()]


def mentions(
    texts: DataFrame, terms: DataFrame, text: str = "text", into: str = "mentions", guard: str = "word", longest: bool = False,
    contexts: dict[str, tuple[str, ...]] | None = None, most: int | None = None,
) -> DataFrame:
    """The rows with every mention of a dictionary term, without regard to case, by begin and end.

    ``terms`` has (term, category); places are those of the lower-cased text, from 0.
    Guards: a "word" is not part of another word, "space" wants spaces around, "none"
    takes any substring. With ``longest``, overlapping mentions give way to the leftmost
    and longest. A term with ``contexts`` counts only in texts where one of these patterns
    is found. Null and empty texts mention nothing.
    """
    contexts = CONTEXTS if contexts is None else contexts
    held = pieces(terms.select(F.lower("term").alias("term"), "category").distinct(), "term", most)
    kind, one_piece = ArrayType(MENTION), len(held) == 1

    def arranged(found: list[dict]) -> list[dict]:
        found.sort(key=lambda m: (m["begin"], m["end"], m["term"], m["category"] or ""))
        if not longest:
            return found
        taken = set(leftmost_longest({(m["begin"], m["end"]) for m in found}))
        return [m for m in found if (m["begin"], m["end"]) in taken]

    found = texts
    for number, rows in enumerate(held):
        names, categories = _by_term(rows)

        def start(names: list[str] = names, categories: list[list[str]] = categories):
            check, spaced = GUARDS[guard]
            automaton = Terms(names, spaced)
            patterns = {i: [re.compile(p, re.I) for p in contexts[n]] for i, n in enumerate(names) if n in contexts}

            def one(value: str | None) -> list[dict]:
                spans = automaton.spans((value or "").lower(), check)
                if patterns:
                    sure = {p for p in {s[2] for s in spans} & set(patterns) if any(x.search(value) for x in patterns[p])}
                    spans = [s for s in spans if s[2] not in patterns or s[2] in sure]
                out = [{"term": names[p], "category": c, "begin": b, "end": e} for b, e, p in spans for c in categories[p]]
                return arranged(out) if one_piece else out

            return lambda values: [one(v) for v in values]

        found = map_strings(found, [text], f"{into}_{number}", kind, start)
    each = [f"{into}_{i}" for i in range(len(held))]
    if one_piece:
        return found.drop(into).withColumnRenamed(each[0], into)
    return map_strings(found.withColumn(into, F.concat(*each)).drop(*each), [into], into, kind, lambda: lambda rows: [arranged(r) for r in rows])


def held(texts: DataFrame, terms: DataFrame, text: str = "text", into: str = "terms", most: int | None = None) -> DataFrame:
    """The rows with the distinct (term, category) of a dictionary that stand between spaces in a text, however often."""
    kind = ArrayType(StructType([StructField("term", StringType()), StructField("category", StringType())]))
    found, each = texts, []
    for number, rows in enumerate(pieces(terms.select("term", "category").distinct(), "term", most)):
        names, categories = _by_term(rows)

        def start(names: list[str] = names, categories: list[list[str]] = categories):
            own = Terms(names, spaced=True)
            return lambda values: [[(names[p], c) for p in sorted(own.found(v or "")) for c in categories[p]] for v in values]

        each.append(f"_{into}_{number}")
        found = map_strings(found, [text], each[-1], kind, start)
    return found.withColumn(into, F.concat(*each)).drop(*each)


def counts(texts: DataFrame, terms: DataFrame, key: str, text: str = "text", guard: str = "word", most: int | None = None) -> DataFrame:
    """(key, term, category, n): how often each dictionary term stands in the texts of a key, overlapping ones too.

    Counts travel by the numbers of terms; the terms meet them when they are added up.
    """
    held = pieces(terms.select("term", "category").distinct(), "term", most)
    found, every, own_categories, first = None, [], [], 0
    for rows in held:
        names, categories = _by_term(rows)

        def start(names: list[str] = names, first: int = first):
            count, kind = counter(names, guard), to_arrow_type(NUMBERS)

            def run(values: list[str | None]) -> pa.Array:
                each = [count(v) if v else {} for v in values]
                ends = np.cumsum([0, *map(len, each)], dtype="int32")
                places = np.fromiter(chain.from_iterable(each), "int32", ends[-1]) + np.int32(first)
                numbers = np.fromiter(chain.from_iterable(c.values() for c in each), "int64", ends[-1])
                return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(places), pa.array(numbers)], fields=list(kind.value_type)), type=kind)

            return run

        own = map_strings(texts.select(key, text), [text], "_found", NUMBERS, start).select(key, F.inline("_found"))
        found = own if found is None else found.unionByName(own)
        every += names
        own_categories += categories
        first += len(names)
    named = pa.table(
        {
            "_place": pa.array(np.repeat(np.arange(first, dtype="int32"), list(map(len, own_categories)))),
            "term": pa.array([t for t, c in zip(every, own_categories, strict=True) for _ in c], pa.string()),
            "category": pa.array([x for c in own_categories for x in c], pa.string()),
        }
    )
    sums = found.groupBy(key, "_place").agg(F.sum("n").alias("n"))
    return sums.join(F.broadcast(texts.sparkSession.createDataFrame(named)), "_place").select(key, "term", "category", "n")
