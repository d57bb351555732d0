"""Professional and study domains of texts, what they allow, and labels that follow from them.

Keyword tables are parameters of any size: an automaton finds all keywords of a text
in one pass, where it is read, without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from hiresift.functions.arrow import map_strings
from hiresift.functions.automaton import FirstPattern, Terms
from hiresift.functions.text import normalise_code, strip_accents

from .dictionary import pieces
from .matching import contains_either, small

#: Least score from which a domain counts as detected, and that of a text inside a keyword.
LEAST_DOMAIN, INSIDE = 0.35, 0.90


_SCORED = StructType([StructField("score", DoubleType()), StructField("p", LongType()), StructField("code", StringType())])
_HITS = ArrayType(StructType([StructField("domain", StringType()), StructField("p", LongType()), StructField("n", LongType())]))


class _Keywords:
    """Keywords (place, keyword, code) with what tells the best of them for a text."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        self.rows = sorted(rows)
        self.terms = Terms(dict.fromkeys(k for _, k, _ in self.rows))
        self.first: dict[str, int] = {}
        self.words: defaultdict[str, list[int]] = defaultdict(list)
        self.sizes = []
        for i, (_, keyword, _) in enumerate(self.rows):
            self.first.setdefault(keyword, i)
            own = set(keyword.split(" "))
            self.sizes.append(len(own))
            for w in own:
                self.words[w].append(i)
        self.joined = "\n".join(self.terms.terms)
        self.starts, at = [], 0
        for t in self.terms.terms:
            self.starts.append(at)
            at += len(t) + 1

    def best(self, text: str) -> tuple[float, int] | None:
        """Score and row of the best keyword; of equal scores the first row."""
        held = self.terms.found(text)
        if held:
            return max((1.0 + len(k) / 10_000, -self.first[k]) for k in (self.terms.terms[t] for t in held))
        words = set(text.split(" "))
        shared = Counter(i for w in words for i in self.words.get(w, ()))
        found = [(n / max(len(words), self.sizes[i]), -i) for i, n in shared.items()]
        holder = self.joined.find(text)
        if holder >= 0:
            # Keywords stand in the order of their first rows.
            found.append((INSIDE, -self.first[self.terms.terms[bisect_right(self.starts, holder) - 1]]))
            found = [f for f in found if f[0] >= INSIDE and (f[0] == INSIDE or text not in self.rows[-f[1]][1])]
        return max(found, default=None)


def detect_domain(texts: DataFrame, keywords: DataFrame, text: str = "text", into: str = "domain", most: int | None = None) -> DataFrame:
    """The rows with a struct (code, score) of the domain whose keyword fits the text best; null under ``LEAST_DOMAIN``.

    ``keywords`` has (place, keyword, code). A keyword in the text scores 1 and a
    bit for its length, a text inside a keyword 0.9, else the share of common
    words; the first keyword of equal scores wins. Texts without words have none.
    Scores are given with three decimals, halves rounded up.
    """
    held = pieces(keywords.select("place", normalise_code(F.col("keyword")).alias("keyword"), "code"), "keyword", most)
    found = texts.withColumn("_own", normalise_code(F.coalesce(F.col(text), F.lit(""))))
    for i, rows in enumerate(held):

        def start(rows: list[tuple] = [(r.place, r.keyword, r.code) for r in rows]):
            own = _Keywords(rows)

            def one(value: str) -> dict | None:
                best = own.best(value) if value else None
                return best and {"score": best[0], "p": -own.rows[-best[1]][0], "code": own.rows[-best[1]][2]}

            return lambda values: [one(v) for v in values]

        found = map_strings(found, ["_own"], f"_{i}", _SCORED, start)
    each = [F.col(f"_{i}") for i in range(len(held))]
    best = F.greatest(*each) if len(each) > 1 else each[0]
    rounded = (F.floor(best["score"] * 1_000 + 0.5) / 1_000).alias("score")
    return found.withColumn(into, F.when(best["score"] >= LEAST_DOMAIN, F.struct(best["code"].alias("code"), rounded))).drop("_own", *[f"_{i}" for i in range(len(held))])


def study_domain(
    texts: DataFrame, keywords: DataFrame, text: str = "text", specialty: str | None = None, into: str = "study", most: int | None = None, ascii_words: bool = False
) -> DataFrame:
    """The rows with the study domain that has the most keyword hits, the first of equals; null without a hit.

    ``keywords`` has (place, domain, keyword). Without a specialty, hits are
    substrings of the text; with one, whole words, twice for the specialty and once
    for the text. Letters outside ASCII that are no accented ones belong to words, or with ``ascii_words`` part them.
    """
    plain = lambda value: strip_accents(F.lower(F.coalesce(value, F.lit(""))))
    apart = lambda value: F.concat(F.lit(" "), F.regexp_replace(value, r"[^\w]" if ascii_words else r"(?U)[^\w]", " "), F.lit(" "))
    seen = [text] if specialty is None else [text, specialty]
    weights = (1, 2)
    name = plain(F.col("keyword"))
    held = pieces(keywords.where("keyword <> ''").select("place", "domain", (name if specialty is None else apart(name)).alias("keyword")), "keyword", most)
    # The place of a domain is that of its first keyword, wherever the dictionary is cut.
    places = {r.domain: r.place for r in keywords.groupBy("domain").agg(F.min("place").alias("place")).collect()}
    found = texts.withColumns({f"_own{j}": plain(F.col(c)) if specialty is None else apart(plain(F.col(c))) for j, c in enumerate(seen)})
    for i, rows in enumerate(held):
        listed: defaultdict[str, list[str]] = defaultdict(list)
        for r in rows:
            listed[r.keyword].append(r.domain)

        def start(listed: dict[str, list[str]] = dict(listed)):
            terms, domains = Terms(listed), list(listed.values())

            def one(*values: str) -> list[dict]:
                n: Counter = Counter()
                for weight, value in zip(weights, values, strict=False):
                    for t in terms.found(value):
                        for domain in domains[t]:
                            n[domain] += weight
                return [{"domain": d, "p": -places[d], "n": k} for d, k in n.items()]

            return lambda *columns: [one(*v) for v in zip(*columns, strict=True)]

        found = map_strings(found, [f"_own{j}" for j in range(len(seen))], f"_{i}", _HITS, start)
    hits = F.concat(*[F.col(f"_{i}") for i in range(len(held))])
    if len(held) > 1:
        sums = lambda d: F.aggregate(F.filter(hits, lambda h: h["domain"] == d), F.lit(0).cast("long"), lambda a, h: a + h["n"])
        hits = F.transform(hits, lambda h: F.struct(h["domain"].alias("domain"), h["p"].alias("p"), sums(h["domain"]).alias("n")))
    best = F.array_max(F.transform(hits, lambda h: F.struct(h["n"].alias("n"), h["p"].alias("p"), h["domain"].alias("domain"))))
    return found.withColumn(into, best["domain"]).drop(*[f"_own{j}" for j in range(len(seen))], *[f"_{i}" for i in range(len(held))])


def first_pattern(texts: DataFrame, patterns: DataFrame, text: str = "text", into: str = "code") -> DataFrame:
    """The rows with the code of the first pattern (place, pattern, code) found in the text, without regard to case; null if none is.

    Of each pattern the literals are worked out of which every match has one, and an
    automaton tells which of them stand in a text: it meets only patterns that can match.
    """
    rows = sorted((r.place, r.pattern, r.code) for r in patterns.select("place", "pattern", "code").collect())

    def start():
        first, listed = FirstPattern(p for _, p, _ in rows), [c for _, _, c in rows]

        def one(value: str | None) -> str | None:
            at = first.first(value or "")
            return None if at is None else listed[at]

        return lambda values: [one(v) for v in values]

    return map_strings(texts, [text], into, StringType(), start)


def study_compatibility(candidate: str, offer: str, adjacent: Column) -> Column:
    """1 for equal study domains, 0.75 for adjacent, 0.45 for others, 0.8 where either is not known."""
    a, b = F.col(candidate), F.col(offer)
    return F.when(a.isNull() | b.isNull(), 0.80).when(a == b, 1.0).when(adjacent, 0.75).otherwise(0.45)


def level_cap(required: Column, level: Column) -> Column:
    """Highest score that a lack of education levels allows; null without a lack or where a level is not known."""
    gap = required - level
    return F.when((required > 0) & (level > 0), F.when(gap >= 5, 0.25).when(gap >= 3, 0.40).when(gap >= 2, 0.52).when(gap == 1, 0.65))


def relation_cap(relation: Column) -> Column:
    """Highest score that the relation of two domains allows; null where it sets none."""
    return F.when(relation == "same_major", 0.65).when(relation == "different", 0.35)


def capped(score: Column, *caps: Column) -> Column:
    """A score under all caps that are set."""
    return F.least(score, *caps)


def role_level(major: Column) -> Column:
    """Role level from 1 to 5 of a major group of occupations; 3 where it is not known."""
    return F.when(major == 1, 5).when(major == 2, 4).when(major == 3, 3).when(major.isin(4, 5), 2).when(major >= 6, 1).otherwise(3)


def approximate_labels(labels: DataFrame, rows: DataFrame, order: str = "place") -> DataFrame:
    """Each label row with the first row whose title and name each hold the label's, or are held by it.

    ``labels`` has (label_id, label_title, label_name), ``rows`` (title, name) and an order.
    Labels and rows of one title and name are compared once.
    """
    place = F.struct(order, F.struct(*[c for c in rows.columns if c not in ("title", "name")]).alias("rest"))
    firsts = rows.groupBy("title", "name").agg(F.min_by(place, order).alias("_first"))
    asked = labels.select("label_title", "label_name").distinct()
    titles = contains_either(asked.select("label_title").distinct(), firsts.select("title").distinct(), "label_title", "title")
    a, b = F.lower("label_name"), F.lower("name")
    near = asked.join(small(titles), "label_title").join(firsts, "title").where(F.contains(a, b) | F.contains(b, a))
    best = near.groupBy("label_title", "label_name").agg(F.min_by(F.struct("title", "name", "_first.rest"), F.col(f"_first.{order}")).alias("_best"))
    return labels.join(best, ["label_title", "label_name"]).select(*labels.columns, "_best.title", "_best.name", "_best.rest.*")


def deduplicated_discoveries(profiles: DataFrame, into: str = "kept") -> DataFrame:
    """The rows with the discoveries that add to the known skills, in order.

    ``known`` and ``found`` are arrays of names. A discovery goes if it equals a
    known or kept one, or if one holds the other and the shorter has five
    characters or more. One profile is decided in sequence, small as it is.
    """

    @F.pandas_udf("array<string>")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for known, found in batches:
            out = []
            for have, new in zip(known, found, strict=True):
                names = {str(x).lower() for x in ([] if have is None else have)}
                own = []
                for name in [] if new is None else new:
                    low = name.lower()
                    if low in names or any((low in x or x in low) and min(len(low), len(x)) >= 5 for x in names):
                        continue
                    own.append(name)
                    names.add(low)
                out.append(own)
            yield pd.Series(out)

    return profiles.withColumn(into, kept(F.col("known"), F.col("found")))


def built_pairs(grid: DataFrame) -> DataFrame:
    """Skills of a made-up candidate for each point of a grid, and the features that follow.

    ``grid`` has rate, kind, required, beside (skills that go with the domain),
    other (skills of the other domain), required_level, level, required_years, years.
    """
    n = F.greatest(F.lit(0), F.floor(F.col("rate") * F.size("required")).cast("int"))
    own = (
        F.when(F.col("kind") == "same", F.concat(F.slice("required", F.lit(1), n), F.slice("beside", 1, 2)))
        .when(
            F.col("kind") == "adjacent",
            F.concat(F.slice("required", F.lit(1), F.greatest(F.lit(1), F.floor(n / 2).cast("int"))), F.slice("other", 1, 4)),
        )
        .otherwise(F.slice("other", 1, 6))
    )
    fold = lambda value: F.array_distinct(F.transform(value, lambda s: F.trim(F.lower(s))))
    shared = F.size(F.array_intersect(fold(F.col("required")), fold(F.col("own_skills"))))
    ratio = F.greatest(F.lit(0.1), F.col("years") / F.greatest(F.lit(1), F.col("required_years")))
    four = lambda value: F.floor(value * 10_000 + 0.5) / 10_000
    return (
        grid.withColumn("own_skills", own)
        .withColumn("skills_raw", four(shared / F.greatest(F.lit(1), F.size(fold(F.col("required"))))))
        .withColumn("edu_gap", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("required_level") - F.col("level")) / 5.0)))
        .withColumn("experience", four(F.when(F.col("years") >= F.col("required_years"), 1.0).otherwise(ratio)))
        .withColumn("compatibility", F.when(F.col("kind") == "same", 1.0).when(F.col("kind") == "adjacent", 0.65).otherwise(0.0))
        .withColumn("semantic", four(0.4 + F.col("skills_raw") * 0.5))
        .withColumn("formation", F.greatest(F.lit(0.1), 1.0 - F.greatest(F.lit(0.0), F.col("edu_gap"))))
    )


def listed_skills(text: Column) -> Column:
    """The skills of a list that stands as text, ``['a', "b"]``; none where it is no list."""
    inside = F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), r"(?s)^\[(.*)\]$", 1)
    return F.transform(F.regexp_extract_all(inside, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0)), lambda s: F.substring(s, F.lit(2), F.char_length(s) - 2))


def real_pair_features(pairs: DataFrame, keywords: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Features and label of real pairs (required, own as listed text; job_text, resume_text; cosine; percent).

    The study domains come from the first 300 characters of either text, which is the rule.
    """
    fold = lambda value: F.array_distinct(F.transform(listed_skills(value), lambda s: F.trim(F.lower(s))))
    required, own = fold(F.col("required")), fold(F.col("own"))
    four = lambda value: F.floor(value * 10_000 + 0.5) / 10_000
    share = F.when(F.size(required) > 0, four(F.size(F.array_intersect(required, own)) / F.size(required))).otherwise(F.lit(0.0))
    heads = pairs.withColumn("_job", F.substring("job_text", 1, 300)).withColumn("_resume", F.substring("resume_text", 1, 300))
    known = study_domain(study_domain(heads, keywords, "_job", into="_offer"), keywords, "_resume", into="_own")
    near = adjacency.toDF("_own", "_offer").withColumn("_near", F.lit(True))
    clip = lambda value: F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return (
        known.join(small(near), ["_own", "_offer"], "left")
        .withColumn("semantic", clip((F.col("cosine") + 1) / 2))
        .withColumn("skills_raw", share)
        .withColumn("study_compat", study_compatibility("_own", "_offer", F.col("_near").isNotNull()))
        .withColumn("domain_ratio", four(F.least(F.lit(1.0), F.col("skills_raw") * 1.5)))
        .withColumn("label", four(clip(F.coalesce(F.col("percent"), F.lit(50.0)) / 100.0)))
        .drop("_job", "_resume", "_offer", "_own", "_near")
    )


def annotated_labels(annotations: DataFrame) -> DataFrame:
    """(offer_id, candidate_id, label): relevance 1 and more is 1, 0 is 0, no relevance is left out."""
    return annotations.where(F.col("relevance") >= 0).select("offer_id", "candidate_id", (F.col("relevance") >= 1).cast("int").alias("label"))
