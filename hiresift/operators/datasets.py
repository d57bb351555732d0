"""Dictionaries and training rows from text, texts for encoders, small networks, summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions import scores
from hiresift.functions.text import clip_characters, normalise

from .evaluation import numbered_by_hash


def alias_dictionary(clusters: DataFrame, longest: int = 2) -> DataFrame:
    """(term, synonym) in both directions from clusters (cluster, term): pairs that share a word or are short."""
    own = clusters.select("cluster", normalise(F.col("term")).alias("term")).where("term <> ''").distinct()
    pairs = own.join(own.withColumnRenamed("term", "synonym"), "cluster").where("term <> synonym")
    words, others = F.split("term", " "), F.split("synonym", " ")
    fine = F.arrays_overlap(words, others) | ((F.size(words) <= longest) & (F.size(others) <= longest))
    return pairs.where(fine).select("term", "synonym").distinct()


def triplets(lines: DataFrame, column: str = "line") -> DataFrame:
    """(anchor, other, label) from lines "anchor | positive | negative": a positive and a negative pair for each."""
    parts = F.transform(F.split(column, r"\s*\|\s*"), lambda p: F.trim(p))
    rows = lines.select(parts.alias("p")).where("size(p) = 3 and p[0] <> '' and p[1] <> '' and p[2] <> ''")
    both = F.array(F.struct(F.col("p")[1].alias("other"), F.lit(1).alias("label")), F.struct(F.col("p")[2].alias("other"), F.lit(0).alias("label")))
    return rows.select(F.col("p")[0].alias("anchor"), F.explode(both).alias("x")).select("anchor", "x.other", "x.label")


# Shapes of technical terms.
SHAPES = {
    "camel": r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b",
    "dotted": r"\b[A-Za-z]{2,}\.(?:js|io|net|ai|py)\b",
    "versioned": r"\b[A-Za-z]{2,}[ -]?[0-9]+(?:\.[0-9]+)+\b",
    "slashed": r"\b[A-Z]{2,}/[A-Z]{2,}\b",
    "capitals": r"\b[A-Z]{3,8}\b",
}


def discovered_skills(docs: DataFrame, known: DataFrame, key: str = "id", text: str = "raw_text") -> DataFrame:
    """(key, term, shape): technical terms by their shape that no dictionary term (term) equals; the first shape wins."""
    found = None
    for place, (shape, pattern) in enumerate(SHAPES.items()):
        part = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("term"), F.lit(place).alias("p"), F.lit(shape).alias("shape"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(key, "term").agg(F.min(F.struct("p", "shape")).alias("s"))
    return best.join(known.select(F.lower("term").alias("_t")).distinct(), F.lower(best["term"]) == F.col("_t"), "left_anti").select(key, "term", "s.shape")


def encoder_texts(pairs: DataFrame) -> DataFrame:
    """offer_text and candidate_text for an encoder, from labelled parts that are there."""

    def part(name: str, value: Column) -> Column:
        return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(f"{name}: "), value))

    offer = F.concat_ws(
        " ", part("Poste", F.col("titre")), part("Compétences requises", F.array_join("competences_requises", ", ")),
        F.substring("description", 1, 250), part("Localisation", F.col("localisation")),
    )
    own = [part("Compétences", F.array_join("skills", ", ")), part("Expériences", F.array_join("titles", ", ")), part("Formations", F.array_join("diplomas", ", "))]
    present = F.size(F.filter(F.array(*own), lambda x: x.isNotNull()))
    candidate = F.when(present >= 2, F.concat_ws(" ", *own)).otherwise(clip_characters(F.col("raw_text"), 3000))
    return pairs.withColumns({"offer_text": offer, "candidate_text": candidate})


def mlp_scores(rows: DataFrame, features: Sequence[str], layers: list[tuple[np.ndarray, np.ndarray]], into: str = "score") -> DataFrame:
    """Output of a small network, ReLU between its layers and a sigmoid at the end, batch by batch."""

    @F.pandas_udf("double")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, len(features)))
            for place, (weight, bias) in enumerate(layers):
                x = x @ weight + bias
                x = np.maximum(x, 0) if place + 1 < len(layers) else 1 / (1 + np.exp(-x))
            yield pd.Series(x[:, 0])

    return rows.withColumn(into, forward(F.array(*[F.col(f).cast("double") for f in features])))


def summaries(pairs: DataFrame) -> DataFrame:
    """A sentence for each scored pair, from its score and matched and missing skills."""
    name = scores.band(F.col("score"), scores.SUMMARY, "faible")
    text = F.concat_ws(
        " ", F.concat(F.col("nom"), F.lit(" : profil "), name, F.format_string(" (%d %%).", F.floor(F.col("score") * 100 + 0.5).cast("int"))),
        F.when(F.size("matched") > 0, F.concat(F.lit("Points forts : "), F.array_join(F.slice("matched", 1, 5), ", "), F.lit("."))),
        F.when(F.size("missing") > 0, F.concat(F.lit("À vérifier : "), F.array_join(F.slice("missing", 1, 5), ", "), F.lit("."))),
    )
    return pairs.withColumn("summary", text)


def domain_pairs(offers: DataFrame, candidates: DataFrame, adjacency: DataFrame, negatives: int = 5, seed: int = 42) -> DataFrame:
    """Pairs of one domain, of adjacent ones, and up to some others drawn by hash for each offer; offers and candidates have (id, domain)."""
    o = offers.select(F.col("id").alias("offer_id"), F.col("domain").alias("od"))
    c = candidates.select(F.col("id").alias("candidate_id"), F.col("domain").alias("cd"))
    same = o.join(c, F.col("od") == F.col("cd")).select("offer_id", "candidate_id", F.lit("same").alias("kind"))
    near = adjacency.toDF("od", "cd").unionByName(adjacency.toDF("cd", "od").select("od", "cd")).distinct()
    beside = o.join(F.broadcast(near), "od").join(c, "cd").select("offer_id", "candidate_id", F.lit("adjacent").alias("kind"))
    # Each offer draws places in the numbered list of candidates, so that no product of both sides is made.
    n = max(1, c.count())
    places = numbered_by_hash(c, "candidate_id", seed).join(c, "candidate_id")
    draws = o.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(negatives * 4)))).withColumn(
        "place", F.pmod(F.xxhash64(F.lit(seed), "offer_id", "draw"), F.lit(n))
    )
    far = (
        draws.join(places, "place").where("od <> cd").join(near.withColumn("_n", F.lit(True)), ["od", "cd"], "left").where("_n is null")
        .groupBy("offer_id").agg(F.slice(F.sort_array(F.collect_set("candidate_id")), 1, negatives).alias("ids"))
        .select("offer_id", F.explode("ids").alias("candidate_id"), F.lit("different").alias("kind"))
    )
    return same.unionByName(beside).unionByName(far).dropDuplicates(["offer_id", "candidate_id"])
