"""Streams with state: the roll-up of a candidate's matches, and a user's newest notifications.

The last status of a match is kept by match. A user's notifications are spread over
buckets by their ids, so one user with a third of all rows is a number of groups; a
group gives a user's whole result anew, numbered, whenever it changes, and the last
number of each bucket counts. So a batch that is written twice changes nothing. Both
results depend on the events alone: their order, their repetition and how late they
come make no difference, and no watermark drops any.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state store that state of one's own needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
BUCKETS = 8
GROUPS = 64
NEWEST = 50

ITEMS = "user_id long, bucket int, change long, items array<struct<id:long,at:long,is_read:boolean>>"


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


class _Newest(StatefulProcessor):
    """The newest notifications of each user of a group: what is older than all of a user's never counts again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "user_id long", "change long, ids array<long>, ats array<long>, reads array<boolean>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now: defaultdict[int, dict[int, tuple[int, bool]]] = defaultdict(dict)
        for part in rows:
            for user, i, at, read in zip(part["user_id"].tolist(), part["id"].tolist(), part["at"].tolist(), part["is_read"].tolist(), strict=True):
                own = now[user]
                own[i] = max(own.get(i, (at, False)), (at, bool(read)))
                if len(own) >= 4 * NEWEST:
                    now[user] = _latest(own)
        # A group without any user yet needs no look at each of them.
        known = self.held.exists()
        out = []
        for user, own in now.items():
            change, old = 0, {}
            if known and self.held.containsKey((user,)):
                change, ids, ats, reads = self.held.getValue((user,))
                old = {i: (at, bool(read)) for i, at, read in zip(ids, ats, reads, strict=True)}
            own = _latest({i: max(own.get(i, old.get(i)), old.get(i, own.get(i))) for i in own.keys() | old.keys()})
            if own != old:
                items = sorted((at, i, read) for i, (at, read) in own.items())
                self.held.updateValue((user,), (change + 1, [i for _, i, _ in items], [at for at, _, _ in items], [read for _, _, read in items]))
                out.append((user, key[1], change + 1, [{"id": i, "at": at, "is_read": read} for at, i, read in items]))
            if len(out) == 1_000:
                yield pd.DataFrame(out, columns=["user_id", "bucket", "change", "items"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["user_id", "bucket", "change", "items"])

    def close(self) -> None:
        pass


def _latest(own: dict[int, tuple[int, bool]]) -> dict[int, tuple[int, bool]]:
    return own if len(own) <= NEWEST else dict(sorted(own.items(), key=lambda x: (x[1][0], x[0]))[-NEWEST:])


def status_changes(changes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The last status of each match from a stream of match versions (id, candidate_id, status, changed_at), given anew when it changes.

    A match keeps its candidate and has the status of its latest version, of two at one
    moment the one later by name. Rows with a null in id, candidate_id, status or changed_at are left out.
    The state is keyed by match, so a candidate with many is spread over all tasks without ``buckets``.
    """
    rows = changes.select(F.col("id").cast("long").alias("id"), F.col("candidate_id").cast("long").alias("candidate_id"), "status", _micros("changed_at").alias("at")).dropna()
    return rows.groupBy("candidate_id", "id").agg(F.max(F.struct("at", "status")).alias("last"))


def newest(notifications: DataFrame, buckets: int = BUCKETS, groups: int = GROUPS) -> DataFrame:
    """The newest 50 of every user's buckets from a stream of notifications (id, user_id, created_at, is_read).

    A notification that is sent again counts by its latest moment, and of several rows of
    one moment it is read if any is. Moments only grow by that, so what has been left out
    as too old stays so. Rows with a null id, user or moment are left out; a null is_read
    is unread. Users share ``groups`` groups a bucket, each with a state by user, as Python
    is called once a group.
    """
    rows = notifications.select(
        F.col("id").cast("long").alias("id"), F.col("user_id").cast("long").alias("user_id"), _micros("created_at").alias("at"), F.coalesce("is_read", F.lit(False)).alias("is_read")
    ).dropna()
    shared = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    grouped = rows.withColumns({"group": shared("user_id", groups), "bucket": shared("id", buckets)}).groupBy("group", "bucket")
    return grouped.transformWithStateInPandas(statefulProcessor=_Newest(), outputStructType=ITEMS, outputMode="Update", timeMode="None")


def start(spark: SparkSession, kept: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream's groups give to a Parquet folder, once all that is there has been read, and ends then.

    Both folders must be seen by driver and executors alike. The session keeps its state store.
    """
    write = lambda batch, _: batch.write.mode("append").parquet(table)
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        return kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own in the one that spark.checkpoint.dir names, which only in local mode may be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="hiresift-stream-")
    return f"{named}/{uuid.uuid4().hex}"


def replayed(spark: SparkSession, kept: DataFrame) -> DataFrame:
    """What a stream's groups give for all that is there now."""
    folder = shared_folder(spark)
    query = start(spark, kept, f"{folder}/given", f"{folder}/state")
    query.awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{folder}/given")


def rolled_up(candidates: DataFrame, given: DataFrame) -> DataFrame:
    """(id, status) of all candidates from the last statuses given so far: any accepted, else any rejected, else waiting; its own without matches."""
    last = given.groupBy("candidate_id", "id").agg(F.max("last")["status"].alias("status"))
    sums = last.groupBy("candidate_id").agg(F.count_if(F.col("status") == "accepted").alias("a"), F.count_if(F.col("status") == "rejected").alias("r"))
    status = F.when(F.col("candidate_id").isNull(), F.col("candidature_status")).when(F.col("a") > 0, "accepte").when(F.col("r") > 0, "refuse").otherwise("en_attente")
    return candidates.join(sums, candidates["id"] == sums["candidate_id"], "left").select("id", status.alias("status"))


def unread_of_newest(given: DataFrame) -> DataFrame:
    """(user_id, n_unread, n_listed) over each user's newest 50, from what the stream has given so far."""
    last = given.groupBy("user_id", "bucket").agg(F.max_by("items", "change").alias("items"))
    items = last.select("user_id", F.inline("items"))
    order = Window.partitionBy("user_id").orderBy(F.col("at").desc(), F.col("id").desc())
    top = items.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= NEWEST)
    return top.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("n_unread"), F.count("*").alias("n_listed"))
