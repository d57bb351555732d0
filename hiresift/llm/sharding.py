"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes, groups of equal texts undivided.

A partial partition is a list of as many sums as there are shards. Differencing
takes the two with the largest spread and adds them in opposite orders, the largest
sum of one to the smallest of the other, until one partition is left.

What is differenced are large groups, one by one, and buckets of all other groups by
a hash of their text. Neither can be more than the constants here say, so the driver
holds a bounded number of sums however many documents there are; buckets are so
small beside a shard that whole ones balance to a few bytes. A group's sum is looked
for only where its bucket is itself large. All sums are added up before they travel,
so a group of very many copies costs no more than its rows, and no table of groups
is joined with the documents: a document finds its shard from its own hash.

Slots number the rows of a shard by id. Rows are dealt out by ranges of shard and id,
numbered inside each range, and moved up by the numbers of rows in the ranges before.

Defined results: a null text counts as empty, in size as in its group; null ids come
first in their shard; repeated rows go to one shard, each with a slot of its own. A
group larger than a fair share has a shard to itself as far as differencing finds it
so; it is never divided. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Buckets of groups by hash for each shard, and the share of a shard's bytes from which a group is on its own.
BUCKETS_A_SHARD, OWN_SHARE = 256, 1 / 64
#: Bytes that a document costs besides its text.
OVERHEAD = 16


def differenced(sizes: Iterable[int], shards: int) -> list[int]:
    """The shard of each item by Karmarkar-Karp differencing over as many sums as there are shards; items of size 0 go to the first."""
    heap, count = [], 0
    for item, size in enumerate(sizes):
        count += 1
        if size:
            sums = np.zeros(shards, "int64")
            sums[0] = size
            heap.append((-size, item, sums))
    found = [0] * count
    if not heap:
        return found
    heapq.heapify(heap)
    # Sums stand in falling order. A joined partition remembers where each place of its two parts went.
    parts: dict[int, tuple[int, np.ndarray, int, np.ndarray]] = {}
    number = count
    while len(heap) > 1:
        _, a, first = heapq.heappop(heap)
        _, b, second = heapq.heappop(heap)
        joined = first + second[::-1]
        order = np.argsort(-joined, kind="stable")
        place = np.empty(shards, "int64")
        place[order] = np.arange(shards)
        joined = joined[order]
        # A part common to all sums makes no difference and could only grow.
        joined = joined - joined[-1]
        parts[number] = (a, place, b, place[::-1])
        heapq.heappush(heap, (-int(joined[0]), number, joined))
        number += 1
    open_ = [(heap[0][1], np.arange(shards))]
    while open_:
        node, to = open_.pop()
        if node < count:
            found[node] = int(to[0])
            continue
        a, place_a, b, place_b = parts.pop(node)
        open_ += [(a, to[place_a]), (b, to[place_b])]
    return found


def _lookup(values: list[int], at: Column) -> Column:
    """The value at a place of a bounded list that is a constant of the plan."""
    return F.get(F.from_json(F.lit(json.dumps(values)), "array<int>"), at)


def _listed(values: list[list[dict]], at: Column, name: str, kind: str, own: Column) -> Column:
    """The value listed beside a row's own name at a place of a bounded list of short lists; null if there is none."""
    held = F.from_json(F.lit(json.dumps(values)), f"array<array<struct<{name}:{kind},value:bigint>>>")
    return F.get(F.filter(F.get(held, at), lambda x: x[name] == own), F.lit(0))["value"]


def assigned(slim: DataFrame, shards: int) -> DataFrame:
    """(home, ..., size, group) with the shard of each row; rows of one group share it."""
    buckets = shards * BUCKETS_A_SHARD
    rows = slim.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int"))
    sums = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.sum("size").alias("size")).collect():
        sums[r.bucket] = r["size"]
    least = int(sum(sums) / shards * OWN_SHARE)
    # At most shards / OWN_SHARE groups are that large, and as many buckets.
    own = []
    if any(s > least for s in sums):
        is_large = _lookup([int(s > least) for s in sums], F.col("bucket")) == 1
        groups = rows.where(is_large).groupBy("bucket", "group").agg(F.sum("size").alias("size"))
        own = groups.where(F.col("size") > least).orderBy("group").collect()
    for r in own:
        sums[r.bucket] -= r["size"]
    shard = differenced([*sums, *[r["size"] for r in own]], shards)
    of_bucket = _lookup(shard[:buckets], F.col("bucket"))
    if not own:
        return rows.withColumn("shard", of_bucket)
    # Large groups by their digests, in the list of their bucket.
    listed_groups: list[list] = [[] for _ in range(buckets)]
    for r, to in zip(own, shard[buckets:], strict=True):
        listed_groups[r.bucket].append({"group": r["group"].hex(), "value": to})
    return rows.withColumn("shard", F.coalesce(_listed(listed_groups, F.col("bucket"), "group", "string", F.lower(F.hex("group"))).cast("int"), of_bucket))


def slotted(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with a slot: numbers from 0 without gaps in each shard, in the given order."""
    at = "at"
    dealt = cut(
        rows.repartitionByRange("shard", *order).sortWithinPartitions("shard", *order).withColumn(at, F.monotonically_increasing_id())
    )
    part = F.shiftright(at, 33)
    # A row for each range, and one more wherever a shard begins inside one.
    counts = dealt.groupBy("shard", part.alias("part")).agg(F.min(at).alias("first"), F.count("*").alias("rows")).orderBy("shard", "part").collect()
    moved: list[list] = [[] for _ in range(1 + max((r.part for r in counts), default=0))]
    before, shard = 0, None
    for r in counts:
        before = before if r.shard == shard else 0
        shard = r.shard
        moved[r.part].append({"shard": r.shard, "value": before - r["first"]})
        before += r["rows"]
    return dealt.withColumn("slot", F.col(at) + _listed(moved, part, "shard", "int", F.col("shard"))).drop(at)


def shard_by_bytes(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of all rows: bytes of the shards nearly equal, equal texts together."""
    content = text_or_empty(text)
    slim = cut(
        docs.select(
            F.col(key).alias("id"),
            (F.octet_length(content).cast("long") + OVERHEAD).alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(content, 256)).alias("group"),
            F.monotonically_increasing_id().alias("home"),
        )
    )
    placed = assigned(slim, shards).select("id", "size", "text_crc32", "shard", "home")
    return slotted(placed, ["id", "home"]).select(F.col("id").alias(key), "size", "text_crc32", "shard", "slot")
