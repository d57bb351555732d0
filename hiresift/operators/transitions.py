"""State transitions as new versions of tables, and the rows that they append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def auto_close(offers: DataFrame, as_of: str) -> DataFrame:
    """Active offers past their deadline become closed."""
    late = (F.col("status") == "active") & F.col("date_limite").isNotNull() & (F.col("date_limite") < F.lit(as_of).cast("date"))
    return offers.withColumn("status", F.when(late, "closed").otherwise(F.col("status")))


def anonymise(candidates: DataFrame, key: str = "id", cleared: Sequence[str] = ()) -> DataFrame:
    """Personal data masked; applying it twice changes nothing more."""
    mark = F.concat(F.lit("anonyme_"), F.substring(F.col(key).cast("string"), 1, 8), F.lit("@anonyme.com"))
    out = candidates.withColumns({"nom": F.lit("Anonyme"), "email": mark, "anonymized": F.lit(True)})
    if "telephone" in candidates.columns:
        out = out.withColumn("telephone", F.lit("00000000"))
    for column in cleared:
        out = out.withColumn(column, F.lit(None).cast(candidates.schema[column].dataType))
    return out


def select_candidates(matches: DataFrame, offers: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches, offers and errors after a selection (offer_id, candidate_id).

    In offers with a selection the selected are accepted and all others rejected;
    such an offer closes once it has as many accepted as posts. Offers with more
    selected than posts are errors and stay as they are.
    """
    chosen = selected.select("offer_id", "candidate_id").distinct()
    sizes = chosen.groupBy("offer_id").agg(F.count("*").alias("n_selected"))
    judged = offers.select(F.col("id").alias("offer_id"), "nb_postes").join(sizes, "offer_id")
    errors = judged.where("n_selected > nb_postes")
    fine = judged.where("n_selected <= nb_postes").select("offer_id")
    marks = chosen.join(fine, "offer_id", "left_semi").withColumn("_chosen", F.lit(True))
    touched = fine.withColumn("_touched", F.lit(True))
    after = (
        matches.join(touched, "offer_id", "left")
        .join(marks, ["offer_id", "candidate_id"], "left")
        .withColumn("status", F.when(F.col("_chosen"), "accepted").when(F.col("_touched"), "rejected").otherwise(F.col("status")))
        .select(*matches.columns)
    )
    accepted = (
        after.join(fine, "offer_id", "left_semi").where("status = 'accepted'").groupBy(F.col("offer_id").alias("id")).agg(F.countDistinct("candidate_id").alias("_n"))
    )
    closed = offers.join(accepted, "id", "left").withColumn(
        "status", F.when(F.col("_n") >= F.col("nb_postes"), "closed").otherwise(F.col("status"))
    )
    return after, closed.select(*offers.columns), errors


def change_status(rows: DataFrame, changes: DataFrame, key: str = "id", column: str = "status") -> DataFrame:
    """Rows with the status that a table (key, new status) gives them."""
    new = changes.select(key, F.col(column).alias("_new")).dropDuplicates([key])
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*rows.columns)


def status_notifications(changed: DataFrame, text: Column, at: str) -> DataFrame:
    """One notification for each changed row."""
    return changed.select(
        "user_id", F.lit("status").alias("type"), text.alias("message"), F.lit(False).alias("is_read"), F.lit(at).cast("timestamp_ntz").alias("created_at")
    )


def audit(rows: DataFrame, action: str, resource: str, at: str) -> DataFrame:
    """One audit row for each row."""
    return rows.select(
        "user_id", F.lit(action).alias("action"), F.lit(resource).alias("resource_type"), F.col("id").cast("string").alias("resource_id"),
        F.lit(at).cast("timestamp_ntz").alias("created_at"),
    )


def delete(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows without those whose key is listed; use it again on dependent tables to cascade."""
    return rows.join(ids.select(F.col(key).alias("_k")).distinct(), rows[key] == F.col("_k"), "left_anti")


def missing_links(left: DataFrame, right: DataFrame, existing: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pairs of all ids of both sides that do not exist yet; the linking of every candidate to every open offer.

    The result itself is the product of both sides, so the smaller side is meant
    to be a short list of open offers.
    """
    pairs = left.select(left_key).distinct().join(right.select(right_key).distinct(), F.lit(True))
    return pairs.join(existing.select(left_key, right_key), [left_key, right_key], "left_anti")


def link_rows(missing: DataFrame, at: str) -> DataFrame:
    """New matches for missing pairs, score 0 and pending."""
    return missing.select("*", F.lit(0).cast("long").alias("score_pct"), F.lit("pending").alias("status"), F.lit(at).cast("timestamp_ntz").alias("created_at"))


def store_scores(matches: DataFrame, scores: DataFrame) -> DataFrame:
    """Matches with the scores and details of a table (id, score_pct, details)."""
    new = scores.select("id", F.col("score_pct").alias("_s"), F.col("details").alias("_d"))
    old = F.col("details") if "details" in matches.columns else F.lit(None).cast(scores.schema["details"].dataType)
    names = [*[c for c in matches.columns if c != "details"], "details"]
    return matches.join(new, "id", "left").withColumns({"score_pct": F.coalesce("_s", "score_pct"), "details": F.coalesce("_d", old)}).select(*names)


def mark_read(notifications: DataFrame, which: Column) -> DataFrame:
    return notifications.withColumn("is_read", F.col("is_read") | F.coalesce(which, F.lit(False)))


def update_offers(offers: DataFrame, changes: DataFrame, resettable: Sequence[str] = ()) -> DataFrame:
    """Partial update: a null leaves a field as it is, unless the field is resettable and listed in ``was_set``."""
    fields = [c for c in changes.columns if c not in ("id", "was_set")]
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in fields], *(["was_set"] if "was_set" in changes.columns else []))
    out = offers.join(new, "id", "left")
    for c in fields:
        if c in resettable:
            out = out.withColumn(c, F.when(F.array_contains("was_set", c), F.col(f"_{c}")).otherwise(F.col(c)))
        else:
            out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*offers.columns)


def replace_recruiters(bridge: DataFrame, assigned: DataFrame) -> DataFrame:
    """Bridge rows with the recruiters of the listed offers replaced by the assigned ones."""
    kept = bridge.join(assigned.select("offer_id").distinct(), "offer_id", "left_anti")
    return kept.unionByName(assigned.select("offer_id", "user_id").where("user_id is not null").distinct())


def manual_candidates(forms: DataFrame) -> DataFrame:
    """Candidates from entry forms, their skills as structs of a manual source."""
    return forms.select(
        "id", "nom", F.lower(F.trim("email")).alias("email"),
        F.transform("skills", lambda s: F.struct(F.trim(s).alias("name"), F.lit("manuel").alias("source"))).alias("competences"),
        F.lit("manuel").alias("extraction_method"),
    )


def upload_effects(uploads: DataFrame, users: DataFrame, offers: DataFrame, at: str, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New links and notifications of uploaded candidates: every active offer, every active recruiter and admin.

    ``existing`` has the links (candidate_id, offer_id) that are there, so that a second upload makes none twice.
    """
    people, open_ = uploads.select(F.col("id").alias("candidate_id")), offers.where("status = 'active'").select(F.col("id").alias("offer_id"))
    known = existing if existing is not None else people.join(open_, F.lit(False))
    links = link_rows(missing_links(people, open_, known, "candidate_id", "offer_id"), at)
    staff = users.where("is_active and role in ('recruteur', 'admin')").select(F.col("id").alias("user_id"))
    notes = uploads.select(F.col("id").alias("candidate_id"), "nom").join(staff, F.lit(True)).select(
        "user_id", F.lit("upload").alias("type"), F.concat(F.lit("Nouveau CV : "), "nom").alias("message"), F.lit(False).alias("is_read")
    )
    return links, notes


def set_active(users: DataFrame, ids: DataFrame, active: bool) -> DataFrame:
    marks = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return users.join(marks, "id", "left").withColumn("is_active", F.when(F.col("_hit"), F.lit(active)).otherwise(F.col("is_active"))).select(*users.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str, allowed: Sequence[object] | None = None) -> DataFrame:
    """Merged annotations: a new value replaces an old one of the same key; values that are not allowed are left out."""
    if allowed is not None:
        new = new.where(F.col(value).isin(list(allowed)))
    return (
        old.select(*keys, F.col(value).alias("_old"))
        .join(new.select(*keys, F.col(value).alias("_new")), list(keys), "full")
        .select(*keys, F.coalesce("_new", "_old").alias(value))
    )
