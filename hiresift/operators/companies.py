"""Companies of experience blocks: candidates from the head of a block, scored, the best one kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions.text import clean_company

from .matching import small

#: Lines of a block in which known names are looked for, and in which separators count.
KNOWN_LINES, HEAD_LINES = 4, 3
_BULLET = r"^[\-•–—*→▪►●◆○◯◦]"


def candidates(blocks: DataFrame, stop: list[str], spans: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(key, name, source): names after a word or sign that separates a title from a company, pieces of the first lines, and given spans.

    ``blocks`` has the lines of a block as an array; ``spans`` (key, name) are organisations that a tagger found.
    """
    head = F.transform(F.slice("lines", 1, HEAD_LINES), lambda x: F.trim(x))
    plain = F.filter(head, lambda x: ~x.rlike(_BULLET))
    after = F.regexp_extract(F.get("lines", F.lit(0)), r"(?iU)\s(?:chez|at|@)\s+([^\-–—|,;]+)", 1)
    pieces = F.flatten(F.transform(plain, lambda x: F.slice(F.split(x, r"\s*[–—|]\s*|\s+-\s+"), 2, 100)))
    strong = F.transform(pieces, lambda p: F.regexp_replace(F.split(p, ",")[0], r"\([^)]*$", ""))
    tokens = F.flatten(F.transform(F.slice("lines", 1, KNOWN_LINES), lambda x: F.split(x, r"[|,;]")))
    named = lambda values, source: F.transform(values, lambda v: F.struct(v.alias("name"), F.lit(source).alias("source")))
    found = blocks.select(key, F.explode(F.concat(named(F.array(after), "separator"), named(strong, "piece"), named(tokens, "token"))).alias("c")).select(key, "c.*")
    if spans is not None:
        found = found.unionByName(spans.select(key, "name", F.lit("tagger").alias("source")))
    return found.withColumn("name", clean_company(F.col("name"), stop)).where(F.length("name") >= 2)


def score(name: Column, source: Column, times_known: Column, title_pattern: str, stop: list[str], tools: list[str]) -> Column:
    """How likely a name is a company's: 4 to 7 if known, 3 if tagged, 2 for its length, 1 for a capital, 2 for a legal form, less for what speaks against it."""
    low = F.lower(name)
    return (
        F.when(times_known > 0, 4 + F.least(times_known, F.lit(3))).otherwise(0)
        + F.when(source == "tagger", 3).otherwise(0)
        + F.when(F.length(name).between(3, 40), 2).otherwise(0)
        + F.when(name.rlike(r"^\p{Lu}"), 1).otherwise(0)
        + F.when(low.rlike(r"\b(?:sarl|sas?|llc|ltd|inc|corp|gmbh|bv|spa|plc)\b|s\.a\."), 2).otherwise(0)
        - F.when(low.rlike(title_pattern), 5).otherwise(0)
        - F.when(low.rlike(r"(?U)^(?:les?|la|une?|d[eu]s?|the|an?)\b"), 3).otherwise(0)
        - F.when(name.rlike(r"[0-9]{4}"), 2).otherwise(0)
        - F.when(low.isin(*stop, ""), 5).otherwise(0)
        - F.when(low.isin(*tools, ""), 6).otherwise(0)
    )


def best_companies(
    blocks: DataFrame, known: DataFrame, title_pattern: str, stop: list[str] = [], tools: list[str] = [], spans: DataFrame | None = None, key: str = "id"  # noqa: B006
) -> DataFrame:
    """(key, company, score): the best candidate of each block, if its score is not negative; of equal ones the first by name.

    ``known`` has (name, times) of companies seen before. Single tokens of the
    first lines are candidates only where they are known.
    """
    found = candidates(blocks, stop, spans, key).withColumn("_low", F.lower("name"))
    seen = known.select(F.lower("name").alias("_low"), "times").groupBy("_low").agg(F.sum("times").alias("times"))
    marked = found.join(small(seen), "_low", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    fit = marked.where("source <> 'token' or times > 0").withColumn(
        "score", score(F.col("name"), F.col("source"), F.col("times"), title_pattern, [s.lower() for s in stop], [s.lower() for s in tools])
    )
    best = fit.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    return best.where(F.col("b.s") <= 0).select(key, F.col("b.name").alias("company"), (-F.col("b.s")).alias("score"))
