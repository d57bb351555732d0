"""Dashboard aggregates: totals, status counts, per-offer pipeline, bands, alerts, activity.

Scores are percentages from 0 to 100; a score of 0 is one not yet given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiresift.functions.scores import HISTOGRAM, acceptance_rate, band


def totals(offers: DataFrame, candidates: DataFrame, matches: DataFrame, users: DataFrame) -> DataFrame:
    """One row of global counts; each table is read once."""
    parts = [
        candidates.agg(F.count("*").alias("n_candidates")),
        offers.agg(F.count("*").alias("n_offers"), F.count_if(F.col("status") == "active").alias("n_active")),
        matches.agg(F.count("*").alias("n_matches"), F.count_if(F.col("score_pct") > 0).alias("n_scored")),
        users.agg(F.count("*").alias("n_users")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, F.lit(True))  # single rows
    return out


def status_counts(rows: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows of each status of the domain, 0 for those that do not occur."""
    names = rows.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    counted = rows.groupBy(column).count()
    return F.broadcast(names).join(counted, column, "left").select(column, F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def decided(candidates: DataFrame) -> DataFrame:
    accepted = F.count_if(F.col("candidature_status") == "accepte")
    refused = F.count_if(F.col("candidature_status") == "refuse")
    return candidates.agg(accepted.alias("accepted"), refused.alias("refused"), acceptance_rate(accepted, refused).cast("long").alias("rate"))


def offer_pipeline(offers: DataFrame, matches: DataFrame) -> DataFrame:
    """Of each offer, also one without matches, the number, best, mean and bands of its scores."""
    scored = F.col("score_pct") > 0
    name = band(F.col("score_pct"), HISTOGRAM, "faible")
    per_offer = matches.groupBy("offer_id").agg(
        F.count("*").alias("n_matches"),
        F.count_if(scored).alias("n_scored"),
        F.max(F.when(scored, F.col("score_pct"))).alias("best"),
        F.sum(F.when(scored, F.col("score_pct"))).alias("total"),
        *[F.count_if(scored & (name == b)).alias(b) for b in ("excellent", "moyen", "faible")],
    )
    counts = ("n_matches", "n_scored", "excellent", "moyen", "faible")
    return offers.join(per_offer, offers["id"] == per_offer["offer_id"], "left").select(
        offers["id"],
        "titre",
        "status",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        "best",
        (F.col("total") / F.when(F.col("n_scored") > 0, F.col("n_scored"))).alias("mean"),
    )


def score_distribution(matches: DataFrame) -> DataFrame:
    name = band(F.col("score_pct"), HISTOGRAM, "faible")
    return matches.where("score_pct > 0").groupBy(name.alias("band")).agg(F.count("*").alias("n"))


def alerts(pipeline: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Offers that need attention, and two counts over all candidates."""
    kind = (
        F.when(F.col("n_matches") == 0, "no_match")
        .when(F.col("n_scored") == 0, "unscored")
        .when(F.col("best") < 35, "weak_best")
    )
    per_offer = pipeline.where("status = 'active'").select(kind.alias("kind"), F.col("id").alias("offer_id"), F.col("n_matches").alias("n"))
    unmatched = candidates.join(matches, candidates["id"] == matches["candidate_id"], "left_anti").agg(F.count("*").alias("n"))
    pending = candidates.where("candidature_status = 'en_attente'").agg(F.count("*").alias("n"))
    nobody = F.lit(None).cast("long").alias("offer_id")
    return (
        per_offer.where("kind is not null")
        .unionByName(unmatched.where("n > 0").select(F.lit("unmatched_candidates").alias("kind"), nobody, "n"))
        .unionByName(pending.where("n > 0").select(F.lit("pending_candidates").alias("kind"), nobody, "n"))
    )


def recent(rows: DataFrame, as_of: str, days: int = 7, at: str = "created_at") -> DataFrame:
    """Rows of the last days before a given moment."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return rows.where((F.col(at) >= end - F.expr(f"INTERVAL {days} DAYS")) & (F.col(at) <= end))


def top_matches(offers: DataFrame, candidates: DataFrame, matches: DataFrame, k: int = 8) -> DataFrame:
    """The k best matches over all offers, with names."""
    best = matches.where("score_pct > 0").orderBy(F.col("score_pct").desc(), "id").limit(k)
    return (
        best.join(offers.select(F.col("id").alias("offer_id"), "titre"), "offer_id")
        .join(candidates.select(F.col("id").alias("candidate_id"), "nom"), "candidate_id")
        .select("id", "nom", "titre", "score_pct")
    )


def status_rollup(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Status of a candidate from its matches: any accepted, else any rejected, else waiting; its own without matches."""
    rolled = matches.groupBy("candidate_id").agg(
        F.bool_or(F.col("status") == "accepted").alias("accepted"), F.bool_or(F.col("status") == "rejected").alias("rejected")
    )
    status = (
        F.when(F.col("candidate_id").isNull(), F.col("candidature_status"))
        .when(F.col("accepted"), "accepte")
        .when(F.col("rejected"), "refuse")
        .otherwise("en_attente")
    )
    return candidates.join(rolled, candidates["id"] == rolled["candidate_id"], "left").select("id", status.alias("status"))


def first_seen_titles(offers: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct offer titles of each candidate in the order in which they first occur."""
    seen = matches.join(offers.select(F.col("id").alias("offer_id"), "titre"), "offer_id").groupBy("candidate_id", "titre").agg(
        F.min(F.struct("created_at", "id")).alias("first")
    )
    return seen.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("first", "titre"))).alias("t")).select(
        "candidate_id", F.array_join("t.titre", "|").alias("titles"), F.size("t").cast("long").alias("n_titles")
    )


def radar(matches: DataFrame, dimensions: tuple[str, ...], k: int = 5) -> DataFrame:
    """Mean of each dimension over an offer's k best matches, one row a dimension."""
    order = Window.partitionBy("offer_id").orderBy(F.col("score_pct").desc(), "id")
    top = matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    long = top.unpivot(["offer_id"], list(dimensions), "dimension", "value")
    return long.groupBy("offer_id", "dimension").agg((F.sum("value") / F.count("value")).alias("mean"))


def report_rows(offers: DataFrame, matches: DataFrame) -> DataFrame:
    """Rank of each match in its offer, and whether it is among as many as the offer has posts."""
    order = Window.partitionBy("offer_id").orderBy(F.col("score_pct").desc(), F.col("created_at").desc(), "id")
    return (
        matches.join(offers.select(F.col("id").alias("offer_id"), "nb_postes"), "offer_id")
        .withColumn("rank", F.row_number().over(order))
        .select("id", "offer_id", "rank", (F.col("rank") <= F.col("nb_postes")).alias("retained"))
    )


def class_balance(rows: DataFrame, label: Column) -> DataFrame:
    """Numbers of high, low and middle labels."""
    return rows.select(label.alias("y")).agg(
        F.count_if(F.col("y") >= 0.65).alias("high"), F.count_if(F.col("y") < 0.35).alias("low"),
        F.count_if((F.col("y") >= 0.35) & (F.col("y") < 0.65)).alias("middle"),
    )


def agreement_rate(rows: DataFrame, a: Column, b: Column, within: float = 0.3) -> DataFrame:
    """Share of rows whose two labels differ by less than ``within``."""
    return rows.agg(F.count_if(F.abs(a - b) < within).alias("agree"), F.count("*").alias("n")).withColumn(
        "rate", F.col("agree") / F.col("n")
    )


def term_frequencies(terms: DataFrame, column: str, least: int, stop: tuple[str, ...] = ()) -> DataFrame:
    """How often each discovered term of at least some length occurs, apart from stop terms."""
    term = F.lower(F.trim(column))
    return (
        terms.select(term.alias("term"))
        .where((F.length("term") >= least) & ~F.col("term").isin(list(stop) or [""]))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )


def unread_of_newest(notifications: DataFrame, user: str, newest: int = 50) -> DataFrame:
    """Unread among the newest notifications of each user."""
    order = Window.partitionBy(user).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (
        notifications.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= newest)
        .groupBy(user)
        .agg(F.count_if(~F.col("is_read")).alias("n_unread"), F.count("*").alias("n_listed"))
    )


def profile_totals(profiles: DataFrame) -> DataFrame:
    """Years of experience with one decimal, highest level of education and number of skills of nested profiles."""
    months = F.aggregate("experiences", F.lit(0), lambda a, e: a + F.coalesce(e["duree_mois"], F.lit(0)))
    return profiles.select(
        "id",
        (F.floor(months / 12 * 10 + 0.5) / 10).alias("years"),
        F.coalesce(F.array_max(F.transform("formations", lambda f: f["niveau_bac_plus"])), F.lit(0)).alias("level"),
        F.size("competences").cast("long").alias("n_skills"),
    )


def skills_by_category(profiles: DataFrame) -> DataFrame:
    """Map from category to the names of a profile's skills."""
    grouped = (
        profiles.select("id", F.posexplode("competences").alias("at", "skill"))
        .groupBy("id", F.col("skill.category").alias("category"))
        .agg(F.sort_array(F.collect_list(F.struct("at", F.col("skill.name").alias("name")))).alias("s"))
    )
    return grouped.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("category", F.col("s.name")))).alias("skills"))
