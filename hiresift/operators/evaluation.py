"""Evaluation of rankings, and labelled sets for learning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, group: str, ks: Sequence[int] = (2, 3, 4, 5), relevant: int = 1) -> DataFrame:
    """P@k, NDCG@k with linear gain and the reciprocal rank of each group, over rows with a relevance.

    Rows hold score, relevance and a tie-breaking id. P@k divides by k; both are
    null where a group has fewer than k rows.
    """
    own = Window.partitionBy(group)
    rows = (
        ranked.where(F.col("relevance").isNotNull())
        .withColumn("rank", F.row_number().over(own.orderBy(F.col("score").desc(), "id")))
        .withColumn("ideal", F.row_number().over(own.orderBy(F.col("relevance").desc(), "id")))
    )
    hit = F.col("relevance") >= relevant

    def gain(place: str, k: int) -> Column:
        return F.sum(F.when(F.col(place) <= k, F.col("relevance") / F.log2(F.col(place) + 1)).otherwise(F.lit(0.0)))

    aggregates = [F.count("*").alias("n"), F.min(F.when(hit, F.col("rank"))).alias("_first")]
    for k in ks:
        aggregates += [F.count_if(hit & (F.col("rank") <= k)).alias(f"_h{k}"), gain("rank", k).alias(f"_g{k}"), gain("ideal", k).alias(f"_i{k}")]
    out = rows.groupBy(group).agg(*aggregates)
    columns = [F.col(group), F.col("n"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        enough = F.col("n") >= k
        columns.append(F.when(enough, F.col(f"_h{k}") / k).alias(f"p_at_{k}"))
        ndcg = F.when(F.col(f"_i{k}") > 0, F.col(f"_g{k}") / F.col(f"_i{k}")).otherwise(F.lit(0.0))
        columns.append(F.when(enough, ndcg).alias(f"ndcg_at_{k}"))
    return out.select(*columns)


def offline_metrics(ranked: DataFrame, group: str, k: int) -> DataFrame:
    """P@k over the rows there are, and NDCG@k with gain 2^relevance - 1 and no discount at the first two ranks' logarithm below 1."""
    own = Window.partitionBy(group)
    rows = ranked.withColumn("rank", F.row_number().over(own.orderBy(F.col("score").desc(), "id"))).withColumn(
        "ideal", F.row_number().over(own.orderBy(F.col("relevance").desc(), "id"))
    )

    def gain(place: str) -> Column:
        discount = F.when(F.col(place) == 1, F.lit(1.0)).otherwise(F.log2(F.col(place)))
        return F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), F.col("relevance")) - 1) / discount).otherwise(F.lit(0.0)))

    out = rows.groupBy(group).agg(
        F.count_if((F.col("rank") <= k) & (F.col("relevance") >= 1)).alias("_h"), F.least(F.count("*"), F.lit(k)).alias("_n"),
        gain("rank").alias("_g"), gain("ideal").alias("_i"),
    )
    return out.select(
        group, (F.col("_h") / F.col("_n")).alias("precision"), F.when(F.col("_i") > 0, F.col("_g") / F.col("_i")).otherwise(F.lit(0.0)).alias("ndcg")
    )


def spearman(rows: DataFrame, group: str, expected: str, score: str) -> DataFrame:
    """Rank correlation of an expected order (1 first) and a score (highest first), and whether both agree on the first."""
    own = Window.partitionBy(group)
    ranked = rows.withColumn("_a", F.row_number().over(own.orderBy(expected, "id"))).withColumn(
        "_b", F.row_number().over(own.orderBy(F.col(score).desc(), "id"))
    )
    n = F.col("n")
    return (
        ranked.groupBy(group)
        .agg(F.count("*").alias("n"), F.sum((F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b"))).alias("_d"),
             F.bool_or((F.col("_a") == 1) & (F.col("_b") == 1)).alias("top1"))
        .select(group, "n", F.when(n > 1, 1 - 6.0 * F.col("_d") / (n * (n * n - 1))).alias("rho"), "top1")
    )


def inversions(scored: DataFrame, critical: DataFrame, group: str) -> DataFrame:
    """Critical pairs (group, better, worse) that the scores put the wrong way round."""
    a = scored.select(group, F.col("id").alias("better"), F.col("score").alias("sb"))
    b = scored.select(group, F.col("id").alias("worse"), F.col("score").alias("sw"))
    return critical.join(a, [group, "better"]).join(b, [group, "worse"]).where("sb <= sw").select(group, "better", "worse")


def labelled(matches: DataFrame) -> DataFrame:
    """Accepted as 1 and rejected as 0; all others are left out."""
    label = F.when(F.col("status") == "accepted", 1).when(F.col("status") == "rejected", 0)
    return matches.withColumn("label", label).where("label is not null")


def synthetic_negatives(matches: DataFrame, least: int, seed: int = 42) -> DataFrame:
    """Pairs of known candidates and offers that never met, as many as lack to ``least`` negatives.

    Each candidate draws places in the numbered list of all offers, as often as
    the lack asks for, so no product is made and every offer can be drawn; what is
    missing after that (nearly all pairs met) is not there to be drawn.
    """
    lack = max(0, least - matches.where("label = 0").count())
    people, jobs = matches.select("candidate_id").distinct(), matches.select("offer_id").distinct()
    n_people, n_jobs = people.count(), jobs.count()
    if not lack or not n_people:
        return matches.select("candidate_id", "offer_id", F.lit(0).alias("label")).limit(0)
    draws = min(n_jobs, 8 + 4 * -(-lack // n_people))
    # Places in hash order: numbers inside ranges of the hash, and the rows before each range.
    numbered = numbered_by_hash(jobs, "offer_id", seed)
    start = F.pmod(F.xxhash64(F.lit(seed), "candidate_id"), F.lit(n_jobs))
    drawn = (
        people.select("candidate_id", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("turn"))
        .withColumn("place", F.pmod(F.col("start") + F.col("turn") * max(1, n_jobs // draws), F.lit(n_jobs)))
        .join(numbered, "place")
        .select("candidate_id", "offer_id")
        .distinct()
        .join(matches, ["candidate_id", "offer_id"], "left_anti")
    )
    order = F.xxhash64(F.lit(seed), "candidate_id", "offer_id")
    return drawn.orderBy(order, "candidate_id", "offer_id").limit(lack).select("candidate_id", "offer_id", F.lit(0).alias("label"))


def numbered_by_hash(rows: DataFrame, key: str, seed: int, parts: int = 4_096) -> DataFrame:
    """(key, place): distinct keys numbered from 0 in the order of their hashes, without one task for all."""
    hashed = rows.select(key, F.xxhash64(F.lit(seed), key).alias("h")).withColumn("part", F.shiftrightunsigned("h", 52))
    if parts != 4_096:
        hashed = hashed.withColumn("part", F.pmod("part", F.lit(parts)))
    counts = hashed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("h", key)) - 1
    return hashed.withColumn("own", own).join(F.broadcast(before), "part").select(key, (F.col("own") + F.col("before")).alias("place"))


def train_logistic(rows: DataFrame, features: Sequence[str], seed: int = 42, before: Sequence = ()):
    """Logistic regression with balanced class weights; a quarter of each class is held out unless there are too few rows.

    ``before`` has transformers that make the features, which are made once for all passes of the training. Returns the
    fitted pipeline and the validation rows with predictions.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    made = rows
    for stage in before:
        made = stage.transform(made)
    # Put together before they are kept, or every pass would do it again.
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    made = assembler.transform(made).select("id", "label", "_features").persist()
    try:
        sizes = {r.label: r["count"] for r in made.groupBy("label").count().collect()}
        total = sum(sizes.values())
        weight = F.lit(1.0)
        for label, n in sizes.items():
            weight = F.when(F.col("label") == label, F.lit(total / (len(sizes) * n))).otherwise(weight)
        held = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(4)) == 0
        small = total < 8 or min(sizes.values(), default=0) < 2
        weighed = made.withColumn("_weight", weight)
        regression = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=50)
        fitted = regression.fit(weighed if small else weighed.where(~held))
    finally:
        made.unpersist()
    model = PipelineModel([*before, assembler, fitted])
    validation = rows.withColumn("_weight", weight)
    return model, model.transform(validation if small else validation.where(held))


def pseudo_labels(scored: DataFrame, a: str, b: str, high: float, low: float) -> DataFrame:
    """1 where both scores are high, 0 where both are low; the rest has none."""
    label = F.when((F.col(a) >= high) & (F.col(b) >= high), 1).when((F.col(a) <= low) & (F.col(b) <= low), 0)
    return scored.withColumn("label", label)


def extreme_labels(scored: DataFrame, group: str, score: str, k: int = 2) -> DataFrame:
    """The best and the worst rows of each group as 1 and 0."""
    own = Window.partitionBy(group)
    rows = scored.withColumn("_t", F.row_number().over(own.orderBy(F.col(score).desc(), "id"))).withColumn(
        "_b", F.row_number().over(own.orderBy(F.col(score).asc(), F.col("id").desc()))
    )
    label = F.when(F.col("_t") <= k, 1).when(F.col("_b") <= k, 0)
    return rows.withColumn("label", label).where("label is not null").drop("_t", "_b")


def banded_sample(pairs: DataFrame, score: str, edges: Sequence[float], per_band: int, seed: int = 42) -> DataFrame:
    """At most ``per_band`` pairs of each similarity band, chosen by hash."""
    band = F.lit(0)
    for place, edge in enumerate(edges, 1):
        band = F.when(F.col(score) >= edge, place).otherwise(band)
    order = Window.partitionBy("band").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    return pairs.withColumn("band", band).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_band).drop("_r")


def split(rows: DataFrame, shares: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """Rows with the number of their part, by the hash of their id."""
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(10_000)) / 10_000
    part, upper = F.lit(len(shares) - 1), 1.0
    for i in range(len(shares) - 2, -1, -1):
        upper = sum(shares[: i + 1])
        part = F.when(place < upper, i).otherwise(part)
    return rows.withColumn("part", part)


def _uniform(seed: int, *of: str) -> Column:
    """A number from 0 to 1 (excluded) drawn from the hash of a row's columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / float(1 << 53)


def augmented(rows: DataFrame, features: Sequence[str], copies: int, noise: float, seed: int = 42, key: str = "id") -> DataFrame:
    """Copies of rows whose features and label are moved by small normal noise, kept within 0 and 1.

    The noise comes from the hash of the row's key, so reruns on any partitions agree.
    """
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    moved = {}
    for place, column in enumerate((*features, "label")):
        a, b = _uniform(seed + 2 * place, key, "copy"), _uniform(seed + 2 * place + 1, key, "copy")
        normal = F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * F.pi() * b)
        moved[column] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column) + normal * noise))
    return out.withColumns(moved)


def mixed_up(rows: DataFrame, features: Sequence[str], seed: int = 42, key: str = "id") -> DataFrame:
    """Each row mixed with the next one by hash: features and label weighed by a share from 0.3 to 0.7."""
    order = numbered_by_hash(rows, key, seed)
    n = order.count()
    share = 0.3 + 0.4 * _uniform(seed + 99, key)
    columns = (*features, "label")
    a = rows.join(order, key)
    b = a.select(F.pmod(F.col("place") - 1, F.lit(max(1, n))).alias("place"), *[F.col(c).alias(f"_{c}") for c in columns])
    mixed = a.withColumn("_share", share).join(b, "place")
    return mixed.withColumns({c: F.col(c) * F.col("_share") + F.col(f"_{c}") * (1 - F.col("_share")) for c in columns}).select(*rows.columns)


def weighted_labels(formula: DataFrame, human: DataFrame, weight: float = 2.0) -> DataFrame:
    """Rows labelled by formula, with weight 1, and by people, with more."""
    return formula.withColumn("weight", F.lit(1.0)).unionByName(human.withColumn("weight", F.lit(weight)))


def pair_grid(domains: DataFrame, rates: Sequence[float], offsets: Sequence[int], factors: Sequence[float]) -> DataFrame:
    """Each domain (place, domain) with itself over all rates, offsets and factors, and with its next and seventh next."""
    n = domains.count()
    near = domains.select(F.col("place").alias("other_place"), F.col("domain").alias("other"))

    def beside(step: int) -> DataFrame:
        return domains.withColumn("other_place", (F.col("place") + step) % n).join(near, "other_place").select("domain", "other")

    def grid(rows: DataFrame, kind: str, rs: Sequence[float], os: Sequence[int], fs: Sequence[float]) -> DataFrame:
        out = rows.withColumn("kind", F.lit(kind))
        for name, values in (("rate", rs), ("offset", os), ("factor", fs)):
            out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
        return out

    return (
        grid(beside(0), "same", rates, offsets, factors)
        .unionByName(grid(beside(1), "adjacent", rates[:3], offsets[:2], factors[:1]))
        .unionByName(grid(beside(7), "different", rates[:2], offsets[:2], factors[:1]))
    )
