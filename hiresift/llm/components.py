"""Connected components of a link table, with nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of all ends of the links (a, b); a component is named by its smallest node.

    Alternates two contractions until nothing changes. The first hangs the larger
    neighbours of every node on its smallest neighbour, the second hangs a node
    and its smaller neighbours on the smallest of them. Both keep components, and
    end in stars around the smallest nodes. Minima are pre-aggregated on the map
    side, so a node with very many neighbours costs no more than its rows.
    """
    edges = cut(_downward(links.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    state = _state(edges)
    while True:
        edges = cut(_downward(_hang_smaller(_downward(_hang_larger(edges)))))
        now = _state(edges)
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, without loops."""
    return (
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def _hang_larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _hang_smaller(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )
