"""Streams over whole tables, each beside the SQL of the batch result that it must reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.streaming import kept

from .recruiting import candidates, scan
from .registry import Registry

registry = Registry()
query = registry.query


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # As a pattern, a path may name a single file as well as a folder.
    return spark.readStream.schema(scan(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("""SELECT user_id, count(*) FILTER (WHERE id % 3 <> 0) AS n_unread, count(*) AS n_listed FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM access_logs) x WHERE rn <= 50 GROUP BY user_id""")
def unread_stream(spark: SparkSession, d: str) -> DataFrame:
    """Unread ones of every user's newest 50, events read as a stream."""
    i = F.col("event_id")
    notes = _stream(spark, d, "events").select(i.alias("id"), "user_id", F.col("ts").alias("created_at"), (i % 3 == 0).alias("is_read"))
    return kept.unread_of_newest(kept.replayed(spark, kept.newest(notes)))


@query("""SELECT c.id, CASE WHEN m.candidate_id IS NULL THEN c.candidature_status WHEN m.a THEN 'accepte' WHEN m.r THEN 'refuse' ELSE 'en_attente' END AS status
    FROM candidates c LEFT JOIN (SELECT o_custkey AS candidate_id, bool_or(o_orderstatus = 'F') AS a, bool_or(o_orderstatus = 'O') AS r FROM orders GROUP BY 1) m ON m.candidate_id = c.id""")
def status_stream(spark: SparkSession, d: str) -> DataFrame:
    """The roll-up of every candidate, orders read as a stream of match versions: each is pending first and decided a day later."""
    o = _stream(spark, d, "orders")
    decided = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").otherwise("pending")
    day = F.col("o_orderdate").cast("timestamp")
    versions = F.array(F.struct(decided.alias("status"), (day + F.expr("interval 1 day")).alias("changed_at")), F.struct(F.lit("pending").alias("status"), day.alias("changed_at")))
    changes = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("candidate_id"), F.explode(versions).alias("v")).select("id", "candidate_id", "v.*")
    return kept.rolled_up(candidates(spark, d), kept.replayed(spark, kept.status_changes(changes)))
