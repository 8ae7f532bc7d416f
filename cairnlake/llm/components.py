"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.session import discard, durable


def met_by_key(rows: DataFrame, keyed: DataFrame, key: str, total: int, least: int = 1_000, most: int = 10_000) -> DataFrame:
    """The inner join of ``rows`` and ``keyed``, which holds each key once with ``n``, its number of rows in ``rows``.

    Keys of more than ``least`` rows and more than a share of 1 / ``most`` of all ``total`` rows, ``most`` keys at most by
    that definition, are broadcast, so that their rows stay where they are; all others take an ordinary join. Null keys
    meet nothing; empty tables give no rows.
    """
    hot = F.col("n") > max(least, total // most)
    often = F.broadcast(keyed.where(hot).drop("n"))
    seldom = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti").join(keyed.where(~hot).drop("n"), key)
    return rows.join(often, key).unionByName(seldom)


def components(edges: DataFrame, hub: int = 1_000) -> DataFrame:
    """(node, component) of every node of the edges (a, b), component being the least node reachable.

    Rounds of large-star and small-star steps (Kiveris et al., 2014): each links neighbours to the least one, so a path of n
    nodes takes about log(n) rounds. The least neighbour is an aggregate that combines before its shuffle, and a join brings it
    back, by broadcast to the rows of hubs (nodes of more than ``hub`` neighbours, 10,000 of them at most), so that no node's
    neighbours are gathered. Each half of a round is a written table, which keeps plans small; rounds end once one changes no
    edge. Edges may repeat, point either way and be loops; a null end is ignored.
    """

    def with_least(rows: DataFrame, total: int) -> DataFrame:
        return met_by_key(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", total, hub)

    held = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, total = None, held.count()
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = durable(with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        joined = with_least(large, 2 * total)
        new = durable(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct())
        discard(held, large)
        held = new
        seen = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == before:
            break
        before, total = seen, seen[0]
    stars = held.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
