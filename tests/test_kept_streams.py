"""Streams with state give what the batch operators give, in any order, with repeats, and over a restart."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hiresift.operators import dashboard
from hiresift.streaming import kept

START = datetime(2024, 1, 1)


def replay(spark, folder, rows, schema, make, parts=3, restart=True):
    """The rows as files of a stream, the last file after a restart from the same checkpoint."""
    source, table, checkpoint = (str(folder / n) for n in ("source", "table", "checkpoint"))
    size = -(-len(rows) // parts)
    pieces = [rows[i : i + size] for i in range(0, len(rows), size)]
    for wave in (pieces[:-1], pieces[-1:]) if restart else (pieces,):
        for piece in wave:
            spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = kept.start(spark, make(stream), table, checkpoint)
        assert query.awaitTermination(240) and query.exception() is None
    return spark.read.parquet(table)


def test_roll_up_equals_the_batch(spark, tmp_path):
    draw, versions = random.Random(5), []
    for i in range(150):
        candidate = 1 if i % 3 else i % 17 + 2
        for _ in range(draw.randrange(1, 5)):
            versions.append((i, candidate, draw.choice(["pending", "accepted", "rejected", "pending"]), START + timedelta(minutes=draw.randrange(60))))
    rows = versions + draw.sample(versions, 60) + [(None, 1, "accepted", START), (990, 3, None, START), (991, None, "accepted", START)]
    draw.shuffle(rows)
    schema = "id long, candidate_id long, status string, changed_at timestamp"
    given = replay(spark, tmp_path, rows, schema, lambda s: kept.status_changes(s, 4))
    last = {}
    for i, candidate, status, at in versions:
        last[i] = max(last.get(i, (datetime.min, "", 0)), (at, status, candidate))
    matches = spark.createDataFrame([(i, c, s) for i, (_, s, c) in last.items()], "id long, candidate_id long, status string")
    people = spark.createDataFrame([(i, "own") for i in range(1, 40)], "id long, candidature_status string")
    want = {r.id: r.status for r in dashboard.status_rollup(people, matches).collect()}
    assert {r.id: r.status for r in kept.rolled_up(people, given).collect()} == want
    assert set(want.values()) == {"own", "accepte", "refuse", "en_attente"} or len(set(want.values())) >= 3
    # A batch written twice changes nothing.
    assert {r.id: r.status for r in kept.rolled_up(people, given.unionByName(given)).collect()} == want


def test_newest_notifications_equal_the_batch(spark, tmp_path):
    draw = random.Random(6)
    notes = [(i, 1 if i % 2 else i % 7 + 2, START + timedelta(seconds=draw.randrange(300)), draw.random() < 0.4) for i in range(700)]
    rows = notes + draw.sample(notes, 100) + [(900, None, START, True), (None, 1, START, True), (901, 1, None, True)]
    # Sent again later, or read at the same moment; some of these were too old before.
    rows += [(i, u, at + timedelta(seconds=draw.choice([0, 200])), draw.random() < 0.5) for i, u, at, _ in draw.sample(notes, 150)]
    draw.shuffle(rows)
    last = {}
    for i, user, at, read in rows:
        if None not in (i, user, at):
            last[i] = max(last.get(i, (at, False, user)), (at, read, user))
    given = replay(spark, tmp_path, rows, "id long, user_id long, created_at timestamp, is_read boolean", lambda s: kept.newest(s, 4))
    batch = spark.createDataFrame([(i, user, at, read) for i, (at, read, user) in last.items()], "id long, user_id long, created_at timestamp, is_read boolean")
    want = {tuple(r) for r in dashboard.unread_of_newest(batch, "user_id").select("user_id", "n_unread", "n_listed").collect()}
    assert {tuple(r) for r in kept.unread_of_newest(given).collect()} == want
    assert all(len(r.items_) <= kept.NEWEST for r in given.select(F.col("items").alias("items_")).collect())


def test_status_state_is_kept_by_match_without_python(spark, tmp_path):
    spark.range(1).selectExpr("id", "id AS candidate_id", "'pending' AS status", "timestamp'2024-01-01' AS changed_at").write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("id long, candidate_id long, status string, changed_at timestamp").parquet(str(tmp_path / "m"))
    assert "InPandas" not in kept.status_changes(stream)._jdf.queryExecution().logical().toString()


class _Held(dict):
    """A map state in memory."""

    exists = lambda self: bool(self)
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__


def test_one_call_serves_all_users_of_a_group():
    import pandas as pd

    held = _Held()
    made = kept._Newest()
    made.init(type("Handle", (), {"getMapState": lambda self, *_: held})())
    batch = pd.DataFrame({"user_id": [i % 300 for i in range(3_000)], "id": range(3_000), "at": range(3_000), "is_read": False})
    frames = list(made.handleInputRows((0, 2), iter([batch]), None))
    assert [len(f) for f in frames] == [300] and len(held) == 300
    assert not list(made.handleInputRows((0, 2), iter([batch]), None))
    # Of 400 newer ones of one user 50 stay, of the old one that is read since the reading.
    more = pd.DataFrame({"user_id": 5, "id": [5, *range(9_000, 9_400)], "at": [9_999, *range(9_000, 9_400)], "is_read": [True] + [False] * 400})
    (only,) = [f for f in made.handleInputRows((0, 2), iter([more]), None)]
    assert only["change"].tolist() == [2] and [x["id"] for x in only["items"][0]] == [*range(9_351, 9_400), 5] and only["items"][0][-1]["is_read"]
