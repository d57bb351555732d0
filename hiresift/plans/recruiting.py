"""The recruiting tables, read through the driver's star schema.

Offers are parts, candidates are customers, matches are line items (the customer
of the order applies for the part), users are suppliers, audit rows and
notifications are events. ``VIEWS`` holds the same mappings as SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day on which time-dependent queries are asked.
AS_OF = "2024-01-31 00:00:00"

OFFER_STATUS = ("active", "active", "closed", "draft")
CONTRACTS = ("CDI", "CDD", "Stage", "Alternance", "Freelance")
MATCH_STATUS = {"A": "accepted", "R": "rejected", "N": "pending"}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


def job_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return scan(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("titre"),
        F.col("p_brand").alias("entreprise"),
        F.col("p_type").alias("domaine"),
        _pick(CONTRACTS, F.col("p_size")).alias("type_contrat"),
        (F.col("p_size") % 3 + 1).cast("int").alias("nb_postes"),
        _pick(OFFER_STATUS, key).alias("status"),
        (key % 100 + 1).alias("recruiter_id"),
        F.when(key % 5 != 0, F.date_add(F.lit("2024-01-01"), (key % 61).cast("int"))).alias("date_limite"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return scan(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("nom"),
        F.when(key % 10 != 0, F.concat(F.lit("user"), (key % 900).cast("string"), F.lit("@example.com"))).alias("email"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nationkey"),
        _pick(("en_attente", "accepte", "refuse"), key).alias("candidature_status"),
        F.col("c_acctbal").alias("balance"),
        F.date_add(F.lit("2024-01-31"), -(key % 40).cast("int")).alias("created_at"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = scan(spark, sf_dir, "lineitem"), scan(spark, sf_dir, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("o_custkey").alias("candidate_id"),
        F.col("l_partkey").alias("offer_id"),
        F.floor(F.col("l_discount") * 1000 + 0.5).cast("long").alias("score_pct"),
        F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending").alias("status"),
        F.col("l_shipdate").alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return scan(spark, sf_dir, "supplier").select(
        key.alias("id"),
        F.col("s_name").alias("nom"),
        _pick(("candidat", "recruteur", "admin"), key).alias("role"),
        (key % 7 != 0).alias("is_active"),
        F.col("s_nationkey").alias("nationkey"),
    )


def access_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.col("ts").alias("created_at"), "value"
    )


VIEWS = {
    "job_offers": """
        SELECT p_partkey AS id, p_name AS titre, p_brand AS entreprise, p_type AS domaine,
               CASE p_size % 5 WHEN 0 THEN 'CDI' WHEN 1 THEN 'CDD' WHEN 2 THEN 'Stage' WHEN 3 THEN 'Alternance' ELSE 'Freelance' END AS type_contrat,
               CAST(p_size % 3 + 1 AS INTEGER) AS nb_postes,
               CASE p_partkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'active' WHEN 2 THEN 'closed' ELSE 'draft' END AS status,
               p_partkey % 100 + 1 AS recruiter_id,
               CASE WHEN p_partkey % 5 <> 0 THEN DATE '2024-01-01' + CAST(p_partkey % 61 AS INTEGER) END AS date_limite
        FROM part""",
    "candidates": """
        SELECT c_custkey AS id, c_name AS nom,
               CASE WHEN c_custkey % 10 <> 0 THEN 'user' || CAST(c_custkey % 900 AS VARCHAR) || '@example.com' END AS email,
               c_mktsegment AS segment, c_nationkey AS nationkey,
               CASE c_custkey % 3 WHEN 0 THEN 'en_attente' WHEN 1 THEN 'accepte' ELSE 'refuse' END AS candidature_status,
               c_acctbal AS balance,
               DATE '2024-01-31' - CAST(c_custkey % 40 AS INTEGER) AS created_at
        FROM customer""",
    "matches": """
        SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS candidate_id, l_partkey AS offer_id,
               CAST(floor(l_discount * 1000 + 0.5) AS BIGINT) AS score_pct,
               CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'pending' END AS status,
               l_shipdate AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "users": """
        SELECT s_suppkey AS id, s_name AS nom,
               CASE s_suppkey % 3 WHEN 0 THEN 'candidat' WHEN 1 THEN 'recruteur' ELSE 'admin' END AS role,
               s_suppkey % 7 <> 0 AS is_active, s_nationkey AS nationkey
        FROM supplier""",
    "access_logs": """
        SELECT event_id AS id, user_id, event_type AS action, ts AS created_at, value FROM events""",
}


def with_views(sql: str) -> str:
    """The query behind the views that it names."""
    named = [f"{name} AS ({body})" for name, body in VIEWS.items() if re.search(rf"\b{name}\b", sql)]
    if not named:
        return sql
    own = re.match(r"\s*WITH\s+(?!RECURSIVE)", sql)
    return f"WITH {', '.join(named)}" + (f", {sql[own.end():]}" if own else f" {sql}")
