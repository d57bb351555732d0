"""Streams of audit rows and uploads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hiresift.operators.transitions import link_rows, missing_links


def counts_by_action(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Audit rows by action in windows of time; rows later than the watermark are left out."""
    return (
        events.withWatermark("created_at", late)
        .groupBy(F.window("created_at", window).alias("w"), "action")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "action", "n")
    )


def first_uploads(uploads: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of repeated upload events of a file within the watermark."""
    return uploads.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["cv_id"])


def link_uploads(uploads: DataFrame, offers: DataFrame, existing: Callable[[], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str, at: str) -> StreamingQuery:
    """Links each uploaded candidate to every open offer that it has no link to; a batch that is repeated adds nothing twice."""

    def link(batch: DataFrame, _: int) -> None:
        people = batch.select(F.col("candidate_id"))
        jobs = offers.where("status = 'active'").select(F.col("id").alias("offer_id"))
        sink(link_rows(missing_links(people, jobs, existing(), "candidate_id", "offer_id"), at))

    return uploads.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).start()
